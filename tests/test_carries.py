"""State carried across chunks gives the results of whole-series windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key
from tests.test_chunks import _series
from tickframe import operators as op
from tickframe.plans.inspect import plan_problems
from tickframe.schema import BAR_SCHEMA_WITH_ACTIONS


def with_gaps(make_bars):
    bars = _series(make_bars, seed=13)
    hole = F.day("Date") % 4 == 0
    first = (F.col("symbol") == "B") & (F.col("Date") < dt.date(2020, 3, 1))
    return bars.withColumns({c: F.when(~hole & ~first, F.col(c)) for c in ("Close", "Volume")})


@pytest.mark.parametrize("fn", [
    lambda b, **k: op.rebase(b, **k), lambda b, **k: op.fill_forward(b, **k),
    lambda b, **k: op.normalise(b, method="minmax", **k), lambda b, **k: op.normalise(b, method="zscore", **k)])
def test_chunked_equals_plain(make_bars, fn):
    bars = with_gaps(make_bars)
    want, got = fn(bars), fn(bars, chunk_rows=64)
    assert got.columns == want.columns and plan_problems(got) == []
    got, want = by_key(got), by_key(want)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert same(got[k], w), (got[k], w)


def same(a, b):
    """Equal rows, doubles up to the order of sums."""
    return len(a) == len(b) and all(y == pytest.approx(x, rel=1e-9, abs=1e-12) if isinstance(x, float) and isinstance(
        y, float) else x == y for x, y in zip(a, b))


def actions(spark, seed=3, n=300):
    rnd, rows = random.Random(seed), []
    for symbol in ("A", "B"):
        price = 100.0
        for i in range(n):
            price *= 1 + rnd.uniform(-0.03, 0.03)
            close = None if rnd.random() < 0.02 else price
            dividend = rnd.choice([None, 0.0, 0.0, 0.0, rnd.uniform(0, 2)])
            split = rnd.choice([None, 0.0, 0.0, 0.0, 0.0, 2.0, 0.5])
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), price, price + 1, price - 1, close, 1000,
                         dividend, split))
    return rows


def test_adjustment_against_a_loop(spark):
    rows = actions(spark)
    bars = spark.createDataFrame(rows, BAR_SCHEMA_WITH_ACTIONS)
    want = {}
    for symbol in ("A", "B"):
        factor = split = 1.0
        own = [r for r in rows if r[0] == symbol]
        for i in range(len(own) - 1, -1, -1):
            r = own[i]
            want[(symbol, r[1])] = (factor, None if r[5] is None else r[5] * factor, r[6] / split)
            f = 1 / r[8] if r[8] else 1.0
            split *= f
            if r[7] and i and own[i - 1][5]:
                f *= 1 - r[7] / own[i - 1][5]
            factor *= f
    for df in (op.adjust_prices(bars), op.adjust_prices(bars, chunk_rows=64), op.adjust_prices(bars, chunk_rows=7)):
        assert df.columns == [*bars.columns, "adjust_factor", "adjusted_open", "adjusted_high", "adjusted_low",
                              "adjusted_close", "adjusted_volume"]
        got = {(r.symbol, r.Date): (r.adjust_factor, r.adjusted_close, r.adjusted_volume) for r in df.collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert same(got[k], w), (got[k], w)


def test_adjustment_of_tiny_tables(spark):
    one = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 4.0, 10, 1.0, 2.0)], BAR_SCHEMA_WITH_ACTIONS)
    for rows in (None, 5):
        assert op.adjust_prices(one, chunk_rows=rows).first().adjusted_close == 4.0
        assert op.adjust_prices(one.limit(0), chunk_rows=rows).collect() == []
