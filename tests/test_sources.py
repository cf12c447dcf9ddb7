import datetime as dt

import pytest

from tests.conftest import SF, by_key, day
from tickframe.sources import (
    bars_from_events, bars_from_orders, category_bars, category_frame, load_bars, lookback,
    lookback_ytd, portfolio_bars, read_table,
)
from tickframe.sources.dimensions import STOCK_CATEGORIES
from tickframe.plans.inspect import formatted_plan


def test_bars_from_orders_open_close_follow_orderkey(spark):
    orders = spark.createDataFrame(
        [(3, 10.0, dt.datetime(2024, 1, 1, 9), "A"), (1, 20.0, dt.datetime(2024, 1, 1, 17), "A"),
         (2, 5.5, dt.datetime(2024, 1, 1, 12), "A"), (4, 7.0, dt.datetime(2024, 1, 2), "A")],
        "o_orderkey bigint, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    )
    got = by_key(bars_from_orders(orders))
    r = got[("A", dt.date(2024, 1, 1))]
    assert (r.Open, r.High, r.Low, r.Close, r.Volume) == (20.0, 20.0, 5.5, 10.0, 35)
    assert got[("A", dt.date(2024, 1, 2))].Volume == 7


def test_bars_from_events_ties_broken_by_event_id(spark):
    ts = dt.datetime(2024, 1, 1, 10)
    events = spark.createDataFrame(
        [(5, ts, "x", 1.0), (2, ts, "x", 2.0), (9, ts + dt.timedelta(hours=1), "x", 3.0), (7, ts + dt.timedelta(hours=1), "x", 4.0)],
        "event_id bigint, ts timestamp, event_type string, value double",
    )
    r = bars_from_events(events).collect()[0]
    assert (r.Open, r.Close, r.High, r.Low, r.Volume) == (2.0, 3.0, 4.0, 1.0, 4)


def test_bars_fixture_counts(spark):
    bars = bars_from_orders(read_table(spark, SF, "orders"))
    assert bars.count() == 8623
    assert bars.select("symbol").distinct().count() == 5


def test_lookback_and_ytd(make_bars):
    bars = make_bars([("A", day(i, dt.date(2023, 12, 20)), 1.0 + i) for i in range(30)])
    last = dt.date(2023, 12, 20) + dt.timedelta(days=29)
    got = sorted(r.Date for r in lookback(bars, 10).collect())
    assert got[0] == last - dt.timedelta(days=9) and got[-1] == last and len(got) == 10
    ytd = sorted(r.Date for r in lookback_ytd(bars).collect())
    assert ytd[0] == dt.date(2024, 1, 1) and ytd[-1] == last
    fixed = lookback(bars, 5, as_of="2024-01-01")
    assert sorted(r.Date for r in fixed.collect()) == [dt.date(2023, 12, d) for d in range(27, 32)]
    with pytest.raises(ValueError):
        lookback(bars, 0)


def test_portfolio_normalises_and_dedups(make_bars):
    bars = make_bars([(s, day(0), 1.0) for s in ("AAPL", "MSFT", "TSLA")])
    got = sorted(r.symbol for r in portfolio_bars(bars, [" msft", "MSFT", "tsla"]).collect())
    assert got == ["MSFT", "TSLA"]
    assert [r.symbol for r in portfolio_bars(bars, []).collect()] == ["AAPL"]


def test_category_join(spark, make_bars):
    bars = make_bars([(s, day(0), 1.0) for s in ("AAPL", "NVDA", "ZZZ")])
    dim = category_frame(spark)
    assert dim.count() == sum(len(v) for v in STOCK_CATEGORIES.values())
    got = {r.symbol: (r.category, r.company) for r in category_bars(bars, dim).collect()}
    assert got == {"AAPL": ("Tech Giants", "Apple Inc."), "NVDA": ("Semiconductors", "NVIDIA Corporation")}
    semis = category_bars(bars, dim, category="Semiconductors").collect()
    assert [r.symbol for r in semis] == ["NVDA"]


def test_load_bars_pushes_symbol_filter(spark, make_bars, tmp_path):
    bars = make_bars([(s, day(i), 1.0 + i) for s in ("A", "B") for i in range(3)])
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    df = load_bars(spark, path, symbols=["B"])
    assert {r.symbol for r in df.collect()} == {"B"}
    plan = formatted_plan(df)
    assert "PushedFilters: [In(symbol, [B])" in plan or "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,B)]" in plan
    assert "ReadSchema: struct<symbol:string,Date:date,Open:double" in plan


def test_exact_order_key_ntz_ties_and_negative_ids(spark):
    ts = dt.datetime(2024, 1, 1, 23, 59, 59, 999999)
    events = spark.createDataFrame(
        [(-9_000_000_000_000_000_000, ts, "x", 1.0), (9_000_000_000_000_000_000, ts, "x", 2.0),
         (5, dt.datetime(2024, 1, 1, 0, 0, 0, 1), "x", 3.0), (6, dt.datetime(2024, 1, 1), "x", 4.0)],
        "event_id bigint, ts timestamp_ntz, event_type string, value double",
    )
    r = bars_from_events(events).collect()[0]
    assert (r.Open, r.Close, r.Volume) == (4.0, 2.0, 4)


def test_event_bars_use_hash_aggregate(spark):
    from tickframe.plans.inspect import physical_plan

    plan = physical_plan(bars_from_events(read_table(spark, SF, "events")))
    assert "SortAggregate" not in plan and "partial_max_by" in plan
