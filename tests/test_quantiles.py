"""Percentiles by selection equal Spark's exact percentile."""

import math
import random

from pyspark.sql import functions as F

from tickframe import operators as op
from tickframe.operators.quantiles import exact_percentiles
from tests.test_chunks import _series

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def both(df, keys):
    want = df.filter("v is not null").groupBy(*keys).agg(F.count("v").alias("n"), F.percentile("v", SHARES).alias("q"))
    order = lambda d: sorted((tuple(map(str, r[:-1])), [x + 0.0 for x in r.q]) for r in d.select(*keys, "n", "q").collect())
    return order(exact_percentiles(df, keys, "v", SHARES)), order(want)


def test_against_percentile(spark):
    rnd = random.Random(8)
    rows = [("normal", 1, rnd.gauss(0, 1)) for _ in range(501)]
    rows += [("wide", 1, rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300)) for _ in range(400)]
    rows += [("ties", 2, float(rnd.randint(-2, 2))) for _ in range(300)] + [("same", 2, 7.25)] * 20
    rows += [("one", 3, -0.0), ("two", 3, 1.0), ("two", 3, 2.0), ("null", 4, None), (None, 5, 1.5), (None, None, 2.5)]
    rows += [("close", 6, 1.0 + k * 2.0**-52) for k in range(50)] + [("tiny", 7, 5e-324), ("tiny", 7, -5e-324)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    got, want = both(df, ["k", "j"])
    assert got == want
    got, want = both(df.withColumnsRenamed({"k": "_n"}), ["_n"])
    assert got == want
    assert exact_percentiles(df.limit(0), ["k"], "v", SHARES).collect() == []


def test_a_group_of_most_rows(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(1).alias("k"),
                                     F.hash("id").cast("double").alias("v"))
    got, want = both(df, ["k"])
    assert got == want


def test_operators_with_bounded_quartiles(make_bars):
    bars = _series(make_bars, seed=21)
    order = lambda d: sorted(map(tuple, d.collect()))
    want, got = order(op.returns_boxplot(bars)), order(op.returns_boxplot(bars, bounded=True))
    assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for x, y in zip(got, want) for a, b in zip(x, y))
    assert order(op.flag_outliers(bars, bounded=True)) == order(op.flag_outliers(bars))
