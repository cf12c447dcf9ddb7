"""The pipeline's rows: every stage on what its predecessor kept, against plain checks."""

import pytest

import corpus_pipeline as C
from tickframe.llm.common import stored
from tests.conftest import SF
from tests.llm.test_dedup import brute_docs
from tests.llm.test_tokens import check_pieces
from tests.llm.test_urls_secrets import base


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination",
                                        "secret scans", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(stages[1])
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) < 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == {i for i, _, _, kept in brute_docs(rows, 5, 80) if kept}


def test_items_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect() if not any(t in (r.text or "") for t in items)}
    assert ids(stages[3]) == want


def test_secrets_go_and_clean_texts_stay(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        assert (r.text != before[i]) == ("[secret]" in r.text) and (base(before[i]) == [] or r.text != before[i])


def test_packing(stages):
    check_pieces(stages[5].collect(), {r.doc_id: r.text for r in stages[4].collect()})


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(C.run(spark, SF).drop("sequence_id", "offset").collect()) == sorted(
        stages[5].drop("sequence_id", "offset").collect())
