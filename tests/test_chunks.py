"""The chunk + halo split gives exactly the unsplit results."""

import datetime as dt
import random

import pytest

from tickframe import operators as op
from tickframe.plans.chunks import merge_series, over_chunks, reach, split_series


def _series(make_bars, seed=7):
    rnd = random.Random(seed)
    rows = []
    for sym, n, step in (("A", 700, 1), ("B", 90, 9), ("C", 3, 200)):  # dense, sparse, tiny
        d, price = dt.date(2019, 11, 1), 100.0
        for _ in range(n):
            price = round(max(1.0, price * (1 + rnd.uniform(-0.05, 0.05))), 2)
            rows.append((sym, d, price, round(price * 0.99, 2), round(price * 1.03, 2), round(price * 0.96, 2),
                         rnd.randint(100, 10_000)))
            d += dt.timedelta(days=step + rnd.randint(0, 2))
    return make_bars(rows)


@pytest.mark.parametrize("scope,chunk_rows", [("month", 55), ("month", 91), ("symbol", 300), ("symbol", 257)])
def test_chunked_chain_equals_plain(make_bars, scope, chunk_rows):
    bars = _series(make_bars)
    plain = sorted(op.technical_indicators(bars, scope=scope).collect())
    chunked = op.technical_indicators(bars, scope=scope, chunk_rows=chunk_rows)
    assert chunked.columns == op.technical_indicators(bars, scope=scope).columns
    assert sorted(chunked.collect()) == plain


def test_split_tags_and_halo(make_bars):
    bars = _series(make_bars)
    split = split_series(bars, lookback=5, chunk_rows=10)
    a = [r for r in split.collect() if r.symbol == "A"]
    own = sorted((r._row, r._chunk) for r in a if not r._halo)
    assert [row for row, _ in own] == list(range(700))  # dense global row numbers across years
    halo = [(r._row, r._chunk) for r in a if r._halo]
    assert all(row // 10 + 1 == chunk and row % 10 >= 5 for row, chunk in halo)
    assert merge_series(split).count() == bars.count()


def test_over_chunks_with_single_operator(make_bars):
    bars = _series(make_bars)
    plain = sorted(op.moving_averages(bars, windows=(5, 50)).collect())
    got = over_chunks(bars, lambda d: op.moving_averages(d, windows=(5, 50), scope="chunk"), lookback=49,
                      chunk_rows=64, materialize=False)
    assert sorted(got.collect()) == plain


@pytest.mark.parametrize("scope,chunk_rows", [("month", 30), ("symbol", 60)])
def test_chunked_rule_signals_equal_plain(make_bars, scope, chunk_rows):
    bars = _series(make_bars, seed=11)
    plain = sorted(op.rule_signals(bars, scope=scope).collect())
    assert sorted(op.rule_signals(bars, scope=scope, chunk_rows=chunk_rows).collect()) == plain


def test_chunked_exploration_equals_plain(make_bars):
    bars = _series(make_bars, seed=3)
    plain = sorted(op.exploration_indicators(bars).collect())
    assert sorted(op.exploration_indicators(bars, chunk_rows=128).collect()) == plain


def test_chunk_groups_are_bounded(make_bars):
    from pyspark.sql import functions as F

    bars = _series(make_bars)
    split = split_series(bars, lookback=20, chunk_rows=64)
    biggest = split.groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 64 + 20
    per_symbol = split.filter(~F.col("_halo")).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in per_symbol} == {"A": 700, "B": 90, "C": 3}


def test_lookback_is_derived_and_checked(make_bars):
    bars = _series(make_bars)
    fn = lambda d: op.moving_averages(d, windows=(300,), scope="chunk")
    assert reach(bars, fn) == 299
    with pytest.raises(ValueError, match="looks back"):
        over_chunks(bars, fn, lookback=20, chunk_rows=512, materialize=False)
    with pytest.raises(ValueError, match="chunk_rows"):
        over_chunks(bars, fn, chunk_rows=64, materialize=False)
    with pytest.raises(ValueError, match="cannot run on chunks"):
        over_chunks(bars, lambda d: op.rebase(d), chunk_rows=64, materialize=False)


@pytest.mark.parametrize("fn", [
    lambda b, **k: op.rsi(b, **k), lambda b, **k: op.macd(b, variant="b", scope="symbol", **k),
    lambda b, **k: op.bollinger_bands(b, **k), lambda b, **k: op.volatility_metrics(b, **k),
    lambda b, **k: op.momentum(b, **k), lambda b, **k: op.period_returns(b, **k)])
def test_single_operators_on_chunks_equal_plain(make_bars, fn):
    bars = _series(make_bars, seed=5)
    assert sorted(fn(bars, chunk_rows=64).collect()) == sorted(fn(bars).collect())


def test_split_numbers_rows_once(make_bars):
    plan = split_series(_series(make_bars), 5, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") <= 1 or plan.count("Window [row_number()") == 1
