"""Hard negatives against SQL and against plain loops over all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm import hard_negatives as H
from tickframe.llm.hard_negatives import hard_negatives
from tickframe.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def plain(rows, low=30, high=90):
    usable, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(256 * c) for c in v):
            continue
        if (i, label, tuple(v)) not in seen:
            seen.add((i, label, tuple(v)))
            usable.append((i, [math.floor(256 * c) for c in v], label))
    out = []
    for i, v, label in usable:
        if i % 100:
            continue
        of = sorted((-min(max(sum(a * b for a, b in zip(v, w)), LOW), HIGH), j, other) for j, w, other in usable if j != i)
        for s, j, _ in [x for x in of if x[2] == label][:5]:
            fits = [x for x in of if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:10]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    df = hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, df.collect()))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL["op13_hard_negatives"])
    got = QUERIES["op13_hard_negatives"](spark, SF)
    assert got.columns == want.columns
    rows = want.fetchall()
    assert len(rows) > 100 and sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize("kind", ["dense", "sparse", "small"])
def test_random_vectors_in_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "ANCHORS", 3)
    monkeypatch.setattr(H, "GROUP", 4)
    rng = np.random.default_rng({"dense": 1, "sparse": 2, "small": 3}[kind])
    x = rng.normal(0, {"dense": 0.3, "sparse": 1.0, "small": 0.004}[kind], (700, 18))
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.15
    x[300:360] = x[300]  # copies
    rows = [(int(i), x[k].tolist(), str(rng.integers(3))) for k, i in enumerate(rng.permutation(700))]
    assert mined(spark, rows) == plain(rows)


def test_unusable_rows_ties_repeats_and_lengths(spark):
    v = [0.5, 0.25, -0.1]
    rows = [(0, v, "a"), (100, [0.5], "b"), (1, v, "a"), (2, v, "a"), (3, v, "b"), (4, [0.2, 0.1, 0.0], "b"),
            (5, [0.2, 0.1, 0.0], "c"), (6, None, "a"), (7, [0.5, None, 0.1], "a"), (8, [math.nan, 0.0, 0.0], "a"),
            (9, [math.inf, 0.0, 0.0], "b"), (10, v, None), (None, v, "a"), (11, [], "b"), (12, [0.4], "b"),
            (13, [0.3, 0.3, 0.3, 0.3], "a"), (200, [], "a"), (14, [1e307 * 9], "a"),
            (1, v, "a"), (1, [0.45, 0.2, 0.0], "a"), (0, v, "a"), (0, [0.3, 0.1, 0.0], "b"), (300, [-0.1], "b")]
    assert mined(spark, rows) == plain(rows)
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "anchor", "scores", "i", "wanted")})
    assert sorted(map(tuple, hard_negatives(extra, F.col("vec_id") % 100 == 0).collect())) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, v, "a"), (2, v, "b")]) == []


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    for scale in (1e5, 1e9, 1e40):
        rows = [(i, (rng.normal(0, scale, 3)).tolist(), "ab"[i % 2]) for i in range(90, 130)]
        rows += [(i, [scale, 1.0, 0.0], "ab"[i % 2]) for i in range(6)]
        assert mined(spark, rows) == plain(rows)


def test_index_leaves_out_dimensions_and_loses_no_pair():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(0, 1, (500, 64)) * np.exp(-np.arange(64) / 8))
    q = np.floor(256 * rng.normal(0, 1, (20, 64)) * np.exp(-np.arange(64) / 8))
    edges = [*range(0, 64, H.GROUP), 64]
    rest, score = H.suffix_norms(q, edges), q @ x.T
    for share in (0.6, 0.3, 0.1):
        least = np.full(20, share * score.max())
        index = H.NormIndex(x, rest[:, 0].max(), least.min())
        a, r, s = index.pairs(q, rest, least, np.ones(score.shape, bool))
        assert {(i, j): v for i, j, v in zip(a, r, s)} == {(i, j): score[i, j] for i, j in np.argwhere(score >= least[:, None])}
        assert index.postings[-1] < 500 * (0.2 if share > 0.2 else 1.1)
