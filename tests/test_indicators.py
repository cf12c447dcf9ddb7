"""Hand-computed checks on small frames."""

import datetime as dt
import math


from tests.conftest import by_key, day
from tickframe import operators as op
from tickframe.functions.expr import humanize_amount

JAN = dt.date(2024, 1, 1)
FEB = dt.date(2024, 2, 1)


def approx(x, y, tol=1e-9):
    if x is None or y is None:
        return x is None and y is None
    return math.isclose(x, y, rel_tol=tol, abs_tol=tol)


def test_returns(make_bars):
    bars = make_bars([("A", day(0), 10.0, 8.0), ("A", day(1), 11.0, 10.0), ("A", day(2), 9.9, 12.0)])
    got = by_key(op.intraday_return(op.daily_return(bars)))
    assert got[("A", day(0))].daily_return is None
    assert approx(got[("A", day(1))].daily_return, 10.0)
    assert approx(got[("A", day(2))].daily_return, -10.0)
    assert approx(got[("A", day(0))].intraday_return, 25.0)
    assert approx(got[("A", day(2))].intraday_return, (9.9 - 12.0) / 12.0 * 100)


def test_zero_divisor_gives_null(make_bars):
    bars = make_bars([("A", day(0), 0.0, 0.0), ("A", day(1), 5.0, 1.0)])
    got = by_key(op.intraday_return(op.daily_return(bars)))
    assert got[("A", day(0))].intraday_return is None
    assert got[("A", day(1))].daily_return is None


def test_symbols_do_not_leak(make_bars):
    bars = make_bars([("A", day(0), 10.0), ("B", day(0), 100.0), ("A", day(1), 20.0), ("B", day(1), 50.0)])
    got = by_key(op.daily_return(bars))
    assert approx(got[("A", day(1))].daily_return, 100.0)
    assert approx(got[("B", day(1))].daily_return, -50.0)
    assert got[("B", day(0))].daily_return is None


def test_rsi_plus_one_and_month_restart(make_bars):
    closes = [10.0, 11.0, 10.5, 12.0]
    bars = make_bars([("A", JAN + dt.timedelta(i), c) for i, c in enumerate(closes)] + [("A", FEB, 13.0)])
    got = by_key(op.rsi(bars, variant="a"))
    assert got[("A", JAN)].rsi is None  # avg_loss 0
    assert got[("A", day(1))].rsi is None
    assert approx(got[("A", day(2))].rsi, 100 - 100 / 3)
    assert approx(got[("A", day(3))].rsi, 100 - 100 / 6)
    feb = got[("A", FEB)]
    assert feb.price_change is None and feb.gain == 0.0 and feb.rsi is None
    whole = by_key(op.rsi(bars, variant="a", scope="symbol"))
    assert approx(whole[("A", FEB)].price_change, 1.0)


def test_rsi_variants_differ_in_frame(make_bars):
    closes = [100.0 + (i % 3) * (1 if i % 2 else -1) for i in range(20)]
    bars = make_bars([("A", JAN + dt.timedelta(i), c) for i, c in enumerate(closes)])
    a = by_key(op.rsi(bars, variant="a"))
    b = by_key(op.rsi(bars, variant="b"))
    assert "avg_gain" in a[("A", JAN)] and "avg_gain" not in b[("A", JAN)].asDict()
    changes = [None] + [closes[i] - closes[i - 1] for i in range(1, 20)]
    gains = [max(c, 0.0) if c is not None else 0.0 for c in changes]
    losses = [max(-c, 0.0) if c is not None else 0.0 for c in changes]
    i = 19
    for rows, got in ((15, a), (14, b)):
        g = sum(gains[i - rows + 1:i + 1]) / rows
        lo = sum(losses[i - rows + 1:i + 1]) / rows
        assert approx(got[("A", JAN + dt.timedelta(i))].rsi, 100 - 100 / (1 + g / lo))


def test_macd_first_bar_of_month(make_bars):
    bars = make_bars([("A", JAN, 50.0), ("A", day(1), 50.0), ("A", FEB, 60.0)])
    a = by_key(op.macd(bars, variant="a"))
    r = a[("A", JAN)]
    assert approx(r.ema_12, 50.0) and r.macd_line == 0.0
    assert approx(r.signal_line, 1e-5, 1e-14) and r.macd_histogram == -r.signal_line
    assert approx(a[("A", FEB)].ema_26, 60.0)
    b = by_key(op.macd(bars, variant="b"))
    assert b[("A", JAN)].macd_line == 0.0 and b[("A", JAN)].signal_line is None
    assert "ema_fast" not in b[("A", JAN)].asDict()


def test_geometric_mean(make_bars):
    bars = make_bars([("A", JAN, 1.0), ("A", day(1), 4.0)])
    got = by_key(op.macd(bars, variant="a"))
    assert approx(got[("A", day(1))].ema_12, 2.0)


def test_bollinger_and_true_range(make_bars):
    bars = make_bars([("A", day(0), 1.0, 1.0, 1.5, 0.5), ("A", day(1), 2.0, 1.0, 2.0, 1.0),
                      ("A", day(2), 3.0, 6.0, 7.0, 2.5)])
    bb = by_key(op.bollinger_bands(bars))
    r = bb[("A", day(2))]
    assert approx(r.bb_middle, 2.0) and approx(r.bb_std, 1.0)
    assert approx(r.bb_upper, 4.0) and approx(r.bb_lower, 0.0)
    vm = by_key(op.volatility_metrics(bars))
    assert approx(vm[("A", day(0))].true_range, 1.0)  # first bar: High - Low
    assert approx(vm[("A", day(2))].true_range, 5.0)  # |7 - 2|
    assert approx(vm[("A", day(2))].daily_volatility, abs(100.0 - 50.0) / math.sqrt(2))


def test_momentum_rebase_cross(make_bars):
    bars = make_bars([("A", day(i), c) for i, c in enumerate([3.0, 2.0, 1.0, 2.0, 3.0])])
    m = by_key(op.momentum(bars, 2))
    assert m[("A", day(1))].momentum_2d is None
    assert approx(m[("A", day(2))].momentum_2d, (1.0 - 3.0) / 3.0 * 100)
    rb = by_key(op.rebase(bars))
    assert approx(rb[("A", day(0))].rebased, 100.0) and approx(rb[("A", day(4))].rebased, 100.0)
    x = by_key(op.ma_cross(bars, short=1, long=2))
    assert [x[("A", day(i))].ma_cross_signal for i in range(5)] == [
        "No Signal", "Death Cross (Sell)", "No Signal", "Golden Cross (Buy)", "No Signal"]


def test_ma_set_month_frames(make_bars):
    closes = [float(i) for i in range(1, 8)]
    bars = make_bars([("A", JAN + dt.timedelta(i), c) for i, c in enumerate(closes)])
    got = by_key(op.ma_set(bars))
    r = got[("A", day(6))]
    assert approx(r.ma_5, sum(closes[1:]) / 6)  # 5 preceding + current
    assert approx(r.ma_50, sum(closes) / 7) and r.ma_50 == r.ma_200


def test_scored_signals_bounds_and_labels(make_bars):
    closes = [100, 102, 101, 105, 103, 99, 98, 104, 110, 108]
    bars = make_bars([("A", JAN + dt.timedelta(i), float(c), None, None, None, 100 + i) for i, c in enumerate(closes)])
    rows = op.technical_indicators(bars).collect()
    for r in rows:
        votes = (r.signal_short_term + r.signal_medium_term + r.signal_long_term + r.signal_rsi + r.signal_macd)
        assert abs(r.total_signals - votes) <= 2  # price_momentum and volume_trend are dropped
        assert 0.0 <= r.sentiment_strength <= 1.0
        label = ("Strongly Bullish" if r.total_signals > 3 else "Bullish" if r.total_signals > 0 else
                 "Strongly Bearish" if r.total_signals < -3 else "Bearish" if r.total_signals < 0 else "Neutral")
        assert r.sentiment == label
    assert "price_momentum" not in rows[0].asDict()
    rep = op.latest_report(bars).collect()
    assert len(rep) == 1 and rep[0].Date == JAN + dt.timedelta(9)


def test_rule_signals_nulls_hold(make_bars):
    bars = make_bars([("A", JAN + dt.timedelta(i), 10.0 + i) for i in range(5)])
    got = op.rule_signals(bars).collect()
    assert {r.trade_signal for r in got} == {"Hold"}  # rising only: rsi NULL


def test_profile(make_bars):
    bars = make_bars([("A", JAN + dt.timedelta(i), 10.0 + i, None, None, None, 100 * (i + 1)) for i in range(10)]
                     + [("B", JAN + dt.timedelta(7 * i), 5.0) for i in range(5)]
                     + [("C", dt.date(2024, m, 1), 1.0) for m in range(1, 4)])
    freq = by_key(op.data_frequency(bars), "symbol")
    assert (freq[("A",)].gap_days, freq[("A",)].frequency) == (1, "Daily")
    assert freq[("B",)].frequency == "Weekly"
    assert freq[("C",)].frequency is None  # one bar per month: no gap inside a month
    assert by_key(op.data_frequency(bars, scope="symbol"), "symbol")[("C",)].frequency in ("Custom (29 days)", "Custom (31 days)")
    hv = by_key(op.high_volume_ratio(bars), "symbol")[("A",)]
    assert hv.high_volume_days == 2 and approx(hv.high_volume_ratio, 20.0)  # 900, 1000 > 1.5 * 550
    st = by_key(op.basic_stats(bars), "symbol")[("A",)]
    assert approx(st.Close_mean, 14.5) and st.Volume_max == 1000 and approx(st.Close_min, 10.0)
    mc = by_key(op.missing_counts(bars), "symbol")[("A",)]
    assert mc.Close_missing == 0


def test_missing_values(make_bars):
    bars = make_bars([("A", day(0), 1.0), ("A", day(1), None), ("A", day(2), 3.0)])
    assert by_key(op.missing_counts(bars), "symbol")[("A",)].Close_missing == 1
    filled = by_key(op.fill_forward(bars, ["Close"]))
    assert filled[("A", day(1))].Close == 1.0
    assert op.drop_missing(bars).count() == 2


def test_sentiment_card_edges(make_bars):
    closes = [10.0, 11.0, 12.1, 10.89]
    vols = [100, 200, 300, 400]
    bars = make_bars([("A", day(i), c, None, None, None, v) for i, (c, v) in enumerate(zip(closes, vols))])
    last = by_key(op.sentiment_card(bars, "last", return_rows=2, volume_rows=1), "symbol")[("A",)]
    assert approx(last.avg_recent_return, (10.0 - 10.0) / 2)  # +10% and -10%
    assert approx(last.avg_recent_volume, 400.0) and last.volume_trend == "Increasing"
    first = by_key(op.sentiment_card(bars, "first", return_rows=2, volume_rows=1), "symbol")[("A",)]
    assert approx(first.avg_recent_return, 10.0) and first.price_trend == "Bullish"  # NULL first return skipped
    assert first.volume_trend == "Decreasing"


def test_quote_change_and_money(spark, make_bars):
    bars = make_bars([("A", day(0), 100.0), ("A", day(1), 110.0), ("B", day(0), 5.0)])
    q = by_key(op.quote_change(bars), "symbol")
    assert approx(q[("A",)].price_change_pct, 10.0) and q[("B",)].price_change_pct == 0.0
    vals = spark.createDataFrame([(1.25e9,), (999.0,), (1234567.0,), (2.5e12,), (12345.0,)], "x double")
    got = [r[0] for r in vals.select(humanize_amount("x")).collect()]
    assert got == ["$1.3B", "$999", "$1.2M", "$2.5T", "$12,345"]


def test_seasonality(make_bars):
    bars = make_bars([("A", JAN, 10.0), ("A", day(1), 11.0), ("A", FEB, 12.1)])
    got = by_key(op.seasonality(bars, named=True), "symbol", "month")
    assert got[("A", 1)].days_counted == 2 and approx(got[("A", 1)].avg_return, 10.0)
    assert got[("A", 2)].month_name == "February" and got[("A", 2)].return_volatility is None


def test_correlation(spark, make_bars):
    rows = [("A", day(i), float(i + 1)) for i in range(4)] + [("B", day(i), 2.0 * (i + 1)) for i in range(4)]
    rows += [("C", day(i), 7.0) for i in range(4)] + [("D", day(i), float(4 - i)) for i in range(3)]
    bars = make_bars(rows)
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("A", "D")], "symbol_a string, symbol_b string")
    got = by_key(op.pair_correlation(bars, pairs), "symbol_a", "symbol_b")
    assert approx(got[("A", "B")].corr_close, 1.0) and approx(got[("B", "A")].corr_close, 1.0)
    assert got[("A", "B")].correlation_label == "Strong positive"
    assert got[("A", "C")].corr_close is None and got[("A", "C")].correlation_label is None
    assert approx(got[("A", "D")].corr_close, -1.0) and got[("A", "D")].n_days == 3
    zero = by_key(op.pair_correlation(bars, pairs, null_as_zero=True), "symbol_a", "symbol_b")
    assert zero[("A", "C")].corr_close == 0.0 and zero[("A", "C")].correlation_label == "Weak"
    bench = by_key(op.benchmark_correlation(bars, "A"), "symbol_a")
    assert set(bench) == {("B",), ("C",), ("D",)}
    assert approx(bench[("D",)].corr_close, -1.0) and bench[("D",)].n_days == 3


def test_previews_and_latest(make_bars):
    bars = make_bars([(s, day(i), float(i)) for s in ("A", "B") for i in range(50)])
    assert op.preview_first(bars, 40).count() == 80
    last = op.preview_last(bars, 5).collect()
    assert {r.Date for r in last} == {day(i) for i in range(45, 50)}
    rm = op.recent_ma(bars).collect()
    assert len(rm) == 10 and set(rm[0].asDict()) == {"symbol", "Date", "Close", "Close_MA_5", "Close_MA_20", "Close_MA_50"}
    lr = by_key(op.latest_row(bars), "symbol")
    assert lr[("A",)].Date == day(49)


def test_empty_table(make_bars):
    bars = make_bars([])
    assert op.technical_indicators(bars).count() == 0
    assert op.summary_position(bars).count() == 0


def test_cleaning_features(make_bars):
    bars = make_bars([("A", day(i), c, None, None, None, v) for i, (c, v) in
                      enumerate(zip([1.0, 2.0, 3.0, 2.0, 100.0], [10, 20, 30, 40, 50]))])
    n = by_key(op.normalise(bars, method="minmax"))
    assert n[("A", day(0))].Close_norm == 0.0 and n[("A", day(4))].Close_norm == 1.0
    er = by_key(op.efficiency_ratio(bars, n=2))
    assert approx(er[("A", day(2))].efficiency_ratio_2, 100.0)
    assert approx(er[("A", day(3))].efficiency_ratio_2, 0.0)
    rv = by_key(op.relative_volume(bars, rows=1))
    assert approx(rv[("A", day(1))].relative_volume, 20 / 15)
    out = by_key(op.flag_outliers(bars))
    assert out[("A", day(4))].is_outlier is True and out[("A", day(0))].is_outlier is None


def test_keep_columns_and_summary_momentum(make_bars):
    bars = make_bars([("A", day(i), 10.0 + i) for i in range(12)])
    assert op.keep_columns(bars, ["Close", "symbol", "nope"]).columns == ["symbol", "Close"]
    s = by_key(op.summary_position(bars), "symbol")[("A",)]
    assert approx(s.momentum_10d, (21.0 - 11.0) / 11.0 * 100) and s.Date == day(11)
    assert s.price_position == "above" and s.volatility_level in ("low", "moderate", "high")


def test_zero_and_null_prices_are_guarded(make_bars):
    bars = make_bars([("A", JAN, 0.0), ("A", day(1), 0.0), ("A", day(2), 5.0), ("A", day(3), None)])
    a = by_key(op.macd(bars, variant="a"))
    assert a[("A", JAN)].ema_12 == 0.0 and a[("A", JAN)].macd_line == 0.0  # ln(0) skipped, falls back to Close
    assert approx(a[("A", day(2))].ema_12, 5.0)
    b = by_key(op.macd(bars, variant="b"))
    assert b[("A", JAN)].macd_line is None and b[("A", JAN)].signal_line is None
    r = by_key(op.technical_indicators(bars))
    assert r[("A", day(3))].sentiment in ("Bullish", "Bearish", "Neutral", "Strongly Bullish", "Strongly Bearish")
    assert by_key(op.daily_return(bars))[("A", day(1))].daily_return is None  # 0 -> 0: zero divisor


def test_complete_calendar_then_fill(make_bars):
    bars = make_bars([("A", day(0), 1.0), ("A", day(3), 4.0), ("B", day(1), 7.0)])
    cal = by_key(op.complete_calendar(bars))
    assert set(cal) == {("A", day(i)) for i in range(4)} | {("B", day(1))}
    assert cal[("A", day(1))].Close is None and cal[("A", day(1))].Volume is None
    filled = by_key(op.fill_forward(op.complete_calendar(bars)))
    assert filled[("A", day(2))].Close == 1.0 and filled[("A", day(3))].Close == 4.0


def test_constant_price_and_single_bar(spark, make_bars):
    flat = make_bars([("A", day(i), 50.0) for i in range(25)] + [("B", day(i), 10.0 + i) for i in range(25)])
    bb = by_key(op.bollinger_position(flat), "symbol")
    assert bb[("A",)].bb_position is None and bb[("A",)].bb_signal is None  # zero-width band
    assert by_key(op.bollinger_bands(flat))[("A", day(24))].bb_std == 0.0
    pairs = spark.createDataFrame([("A", "B")], "symbol_a string, symbol_b string")
    assert op.pair_correlation(flat, pairs).collect()[0].corr_close is None  # constant side
    vm = by_key(op.volatility_metrics(flat))
    assert vm[("A", day(24))].daily_volatility == 0.0
    one = make_bars([("Z", day(0), 3.0)])
    r = op.technical_indicators(one).collect()[0]
    assert r.rsi is None and r.bb_std is None and r.ma_200 == 3.0
    # variant a MACD: signal exp(ln(0 + 1e-5)) > macd 0 on a first bar, so the MACD vote is -1
    assert r.signal_macd == -1 and r.sentiment_strength == (-1 + 10.5) / 21 and r.sentiment == "Bearish"
    assert op.latest_report(one).collect()[0].bb_position is None
    assert by_key(op.data_frequency(one), "symbol")[("Z",)].frequency is None


def test_boxplot_approx_close_to_exact(spark):
    from tickframe.catalogue import bars_o

    bars = bars_o(spark, "/root/testdata/sf0.001")
    values = {}
    for r in op.period_returns(bars).collect():
        for t in ("intraday_return", "weekly_return", "monthly_return"):
            if r[t] is not None:
                values.setdefault((r.symbol, t), []).append(r[t])
    exact = by_key(op.returns_boxplot(bars), "symbol", "return_type")
    approx_ = by_key(op.returns_boxplot(bars, exact=False, accuracy=100), "symbol", "return_type")
    assert set(exact) == set(approx_) == set(values)
    for k, vals in values.items():
        vals.sort()
        n = len(vals)
        assert approx_[k].n == exact[k].n == n
        for p, col in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            got = approx_[k][col]
            assert got in vals  # the sketch returns a data value
            first, last = vals.index(got), n - 1 - vals[::-1].index(got)  # ties span several ranks
            target = p * (n - 1)
            dist = 0 if first <= target <= last else min(abs(first - target), abs(last - target))
            assert dist <= 1 + n / 100


def test_outlier_flags_exact_and_approx(make_bars):
    closes = [100.0, 101.0, 100.5, 101.5, 100.8, 101.2, 150.0, 101.0, 100.9, 101.1]
    bars = make_bars([("A", day(i), c) for i, c in enumerate(closes)])
    exact = by_key(op.flag_outliers(bars))
    approx_ = by_key(op.flag_outliers(bars, exact=False))
    assert exact[("A", day(6))].is_outlier is True and exact[("A", day(7))].is_outlier is True
    assert {k: r.is_outlier for k, r in exact.items()} == {k: r.is_outlier for k, r in approx_.items()}
