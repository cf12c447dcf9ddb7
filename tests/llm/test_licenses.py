"""License scans against a plain search of the phrases and planted notices."""

import random
import re

import pytest

from tickframe.llm import licenses as L
from tickframe.llm.licenses import license_report, license_spans, template
from tickframe.llm.queries import QUERIES
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def plain(doc_id, text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    places = [(i, label) for phrase, label in L.PHRASES.items() for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return (doc_id, len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def base_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_base_places_against_a_plain_search(spark):
    rnd = random.Random(11)
    words = "gnu general public license apache mit cc by the of é ©2 x".split()
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", "\n", "-", "  "]) for _ in range(
        rnd.choice([0, 1, 2, 3, 30, 300])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "MIT License"), (104, "MIT  \t LICENSE; Apache-License"),
             (105, "mit licenses"), (106, "CC BY" * 3), (107, "cc by " * 5000), (None, "mit license")]
    assert base_rows(license_report(frame(spark, rows))) == sorted((plain(*r) for r in rows), key=str)


def test_query_against_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_license_scan"](spark, SF_SMALL)
    assert base_rows(got) == sorted((plain(*r) for r in docs), key=str)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score == 1.0) if r.n_base else 0 <= r.score <= 1


def notice(label):
    return next(text for name, text in L.NOTICES if name == label)


def test_notices_with_changed_words_and_offsets(spark):
    rnd = random.Random(3)
    mit, bsd = notice("mit").split(), notice("bsd").split()
    changed = [w if i % 12 else "other" for i, w in enumerate(mit)]
    inserted = [w for i, w in enumerate(bsd) for w in ([w, "really"] if i % 20 == 7 else [w])]
    dropped = [w for i, w in enumerate(mit) if i % 15 != 4]
    prose = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    texts = {1: prose(400) + mit + prose(50), 2: prose(20) + changed, 3: inserted + prose(90), 4: dropped,
             5: mit[:len(mit) // 3], 6: prose(500), 7: mit + bsd + prose(10) + mit}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: r for r in license_report(frame(spark, rows)).collect()}
    assert [got[i].labels for i in texts] == ["mit", "mit", "bsd", "mit", "", "", "bsd,mit"]
    assert got[1].score == 1.0 and 0.3 < got[5].score < 0.5 and got[6].score == 0.0
    spans = license_spans(frame(spark, rows)).collect()
    one = next(s for s in spans if s.doc_id == 1)
    assert (one.start, one.end, one.base) == (400, 400 + len(template("mit", notice("mit")).words), False)
    assert sorted(s.label for s in spans if s.doc_id == 7) == ["bsd", "mit", "mit"]


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(1, "mit license", 5), (1, "mit license", 5), (1, "cc by", 6), (2, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    docs = docs.withColumnRenamed("words", "hash").withColumn("key", docs.doc_id).withColumn("template", docs.doc_id)
    got = license_report(docs)
    assert sorted((r.doc_id, r.labels, r.n_base) for r in got.collect()) == [
        (1, "cc-by", 1), (1, "mit", 1), (1, "mit", 1), (2, "", 0)]
    empty = license_report(docs.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns


def test_unhinted_join_gives_the_same_rows(spark, monkeypatch):
    rows = [(1, "x mit license y"), (2, notice("isc")), (3, "nothing")]
    want = sorted(license_report(frame(spark, rows)).collect())
    monkeypatch.setattr(L, "MAX_BROADCAST_GRAMS", 0)
    assert sorted(license_report(frame(spark, rows)).collect()) == want


def test_short_templates_raise():
    with pytest.raises(ValueError):
        template("x", "one two three")
