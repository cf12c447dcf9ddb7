"""Cases the SQL oracle cannot show: price scale of MACD, missing prices, unnamed checkpoint folder, guards."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, by_key, day
from tickframe import operators as op
from tickframe.plans import session
from tickframe.sources import bars_from_ticks, lookback


def _walk(make_bars, scale, n=120, seed=3):
    rnd, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price = max(1.0, price * (1 + rnd.uniform(-0.04, 0.04)))
        rows.append(("A", day(i), price * scale))
    return make_bars(rows)


@pytest.mark.parametrize("scale", [2.0 ** -20, 2.0 ** -40, 2.0 ** 20])
def test_plain_macd_scales_with_the_price(make_bars, scale):
    one = by_key(op.rule_signals(_walk(make_bars, 1.0)))
    other = by_key(op.rule_signals(_walk(make_bars, scale)))
    for k, a in one.items():
        b = other[k]
        assert a.trade_signal == b.trade_signal and (a.signal_line is None) == (b.signal_line is None)
        assert b.macd_line == pytest.approx(a.macd_line * scale, rel=1e-6, abs=1e-9 * scale)


@pytest.mark.parametrize("scale", [1e-5, 1.0])
def test_robust_macd_equals_the_unrounded_formula(make_bars, scale):
    bars = _walk(make_bars, scale)
    a, b = by_key(op.macd(bars)), by_key(op.macd(bars, noise=False))
    for k in a:
        assert a[k].macd_line == pytest.approx(b[k].macd_line, rel=1e-9, abs=1e-10 * scale)
        assert a[k].signal_line == pytest.approx(b[k].signal_line, rel=1e-4)


def test_missing_prices_name_no_open_or_close(spark):
    rows = [("A", 1, None), ("A", 2, 5.0), ("A", 3, 7.0), ("A", 4, None), ("B", 5, None), (None, 6, 1.0)]
    ticks = spark.createDataFrame(rows, "s string, k long, p double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    bars = by_key(bars_from_ticks(ticks, "s", "ts", "p", F.col("k"), F.count(F.lit(1))), "symbol")
    assert set(bars) == {("A",), ("B",)}
    assert (bars[("A",)].Open, bars[("A",)].Close, bars[("A",)].Volume) == (5.0, 7.0, 4)
    assert bars[("B",)].Open is None and bars[("B",)].Close is None


def test_library_needs_a_named_checkpoint_folder(spark, monkeypatch):
    from tickframe.catalogue import spark_query

    monkeypatch.setattr(session, "_named_checkpoint_dir", lambda s: None)
    for name in ("scored_signals_chunked", "stored_bars_ticker", "export_indicators", "basic_stats_actions"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            spark_query(name)(spark, SF_SMALL)


def test_report_after_scored_signals(make_bars):
    report = op.latest_report(op.scored_signals(_walk(make_bars, 1.0)))
    assert report.collect() == op.latest_report(_walk(make_bars, 1.0)).collect()


def test_long_ranges_and_warmup(make_bars):
    bars = _walk(make_bars, 1.0)
    assert lookback(bars, 5000).count() == 120
    assert lookback(bars, 10, warmup_days=5).count() == 15
    assert lookback(bars, "1 Month").count() == 30


def test_rule_signals_need_what_they_do_not_compute(make_bars):
    with pytest.raises(ValueError, match="rsi"):
        op.rule_signals(_walk(make_bars, 1.0), include_indicators=["macd"])
