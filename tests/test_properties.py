"""Property tests: invariants that hold for any price series."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickframe import operators as op

prices = st.lists(st.floats(min_value=1.0, max_value=1e5, allow_nan=False).map(lambda x: round(x, 2)),
                  min_size=1, max_size=45)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def bars_of(make_bars, closes, symbol="A", start=dt.date(2024, 1, 20)):
    return make_bars([(symbol, start + dt.timedelta(i), c, c * 0.99, c * 1.02, c * 0.97, 100 + i)
                      for i, c in enumerate(closes)])


@SETTINGS
@given(closes=prices)
def test_indicator_ranges(make_bars, closes):
    rows = op.technical_indicators(bars_of(make_bars, closes)).collect()
    assert len(rows) == len(closes)
    for r in rows:
        assert r.rsi is None or -1e-9 <= r.rsi <= 100 + 1e-9
        if r.bb_std is not None:
            assert r.bb_lower <= r.bb_middle + 1e-6 <= r.bb_upper + 2e-6
        assert 0.0 <= r.sentiment_strength <= 1.0
        assert r.signal_line is not None and r.macd_histogram is not None  # variant a never NULL


@SETTINGS
@given(closes=prices)
def test_true_range_bounds(make_bars, closes):
    for r in op.volatility_metrics(bars_of(make_bars, closes)).collect():
        assert r.true_range >= r.High - r.Low - 1e-9 >= -1e-9


@SETTINGS
@given(closes=prices)
def test_rebase_starts_at_100(make_bars, closes):
    rows = sorted(op.rebase(bars_of(make_bars, closes)).collect(), key=lambda r: r.Date)
    assert abs(rows[0].rebased - 100.0) < 1e-9


@SETTINGS
@given(closes=prices)
def test_order_and_partitioning_do_not_matter(make_bars, closes):
    bars = bars_of(make_bars, closes)
    a = sorted(op.technical_indicators(bars).collect())
    b = sorted(op.technical_indicators(bars.orderBy("Date", ascending=False).repartition(3)).collect())
    assert a == b


@SETTINGS
@given(x=prices, y=prices)
def test_correlation_symmetric(spark, make_bars, x, y):
    n = min(len(x), len(y))
    bars = bars_of(make_bars, x[:n], "A").unionByName(bars_of(make_bars, y[:n], "B"))
    pairs = spark.createDataFrame([("A", "B"), ("B", "A")], "symbol_a string, symbol_b string")
    got = {(r.symbol_a, r.symbol_b): r.corr_close for r in op.pair_correlation(bars, pairs).collect()}
    ab, ba = got[("A", "B")], got[("B", "A")]
    assert (ab is None and ba is None) or abs(ab - ba) < 1e-9
    assert ab is None or -1 - 1e-9 <= ab <= 1 + 1e-9
