"""Bars and indicators updated in parts equal those built at once."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, SF_SMALL
from tickframe import operators as op
from tickframe.incremental import BarStore
from tickframe.plans.inspect import formatted_plan
from tickframe.sources import bars_from_events, bars_from_orders, read_table
from tickframe.sources.bar_states import bars_from_states, event_states, merge_states, order_states


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("split", [
    lambda k: k % 2 == 0, lambda k: k < 3000, lambda k: k % 97 == 0, lambda k: k < 0])
def test_two_part_load_of_orders(spark, split):
    orders = read_table(spark, SF_SMALL, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    part = split(F.col("o_orderkey"))
    both = merge_states(order_states(orders.filter(part)), order_states(orders.filter(~part)))
    assert rows(bars_from_states(both)) == rows(bars_from_orders(orders))


def test_parts_of_events_merge_in_any_order(spark):
    events = read_table(spark, SF_SMALL, "events")
    parts = [event_states(events.filter(F.col("event_id") % 3 == k)) for k in range(3)]
    want = rows(bars_from_events(events))
    assert rows(bars_from_states(merge_states(*parts))) == want
    assert rows(bars_from_states(merge_states(parts[2], merge_states(parts[1], parts[0])))) == want


def files(path):
    return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f[0] not in "._"}


def test_appending_a_day_rewrites_one_month(spark, tmp_path):
    orders = read_table(spark, SF, "orders").filter("o_orderdate >= '1996-01-01'")
    last = orders.agg(F.max("o_orderdate").cast("date")).first()[0]
    is_last = F.col("o_orderdate").cast("date") == F.lit(last)
    store = BarStore(spark, str(tmp_path / "store"))
    months = store.append(order_states(orders.filter(~is_last)))
    assert len(months) > 20
    before = files(tmp_path / "store" / "indicators")
    assert store.append(order_states(orders.filter(is_last))) == [last.replace(day=1)]
    after = files(tmp_path / "store" / "indicators")
    old = {d for d in os.listdir(tmp_path / "store" / "indicators") if d.startswith("month")}
    changed = [d for d in old if files(tmp_path / "store" / "indicators" / d).keys() - before.keys()]
    assert changed == [f"month={last.replace(day=1)}"] and len(after) >= len(before) - 8
    bars = bars_from_orders(orders)
    assert rows(store.bars()) == rows(bars)
    assert rows(store.indicators()) == rows(op.technical_indicators(bars))
    # a late row in the middle: its month and those that look back on it
    day = dt.datetime(1997, 3, 14)
    late = spark.createDataFrame([(10**9, 5.0, day, "1-URGENT")], "o_orderkey long, o_totalprice double, "
                                 "o_orderdate timestamp_ntz, o_orderpriority string")
    touched = store.append(order_states(late))
    assert touched[0] == dt.date(1997, 3, 1) and 2 <= len(touched) <= 6
    bars = bars_from_orders(orders.select(late.columns).unionByName(late))
    assert rows(store.indicators()) == rows(op.technical_indicators(bars))


def test_updates_read_only_the_months_they_need(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    orders = read_table(spark, SF_SMALL, "orders")
    months = store.append(order_states(orders))
    plan = formatted_plan(store.bars(months[-2:]))
    pruned = re.search(r"PartitionFilters: \[([^\n]*)\]", plan)
    assert pruned and "month" in pruned.group(1)
    assert store._looked_back_on(months) == [] and len(store._looked_back_on(months[-1:])) < len(months) - 1
    assert store.append(order_states(orders.limit(0))) == []


def test_symbol_scope_chains_with_a_long_look_back(spark, tmp_path):
    orders = read_table(spark, SF, "orders").filter("o_orderdate >= '1997-06-01'")
    chain = lambda d, scope: op.ma_set(d, scope=scope)
    store = BarStore(spark, str(tmp_path / "store"), chain, scope="symbol")
    assert store.reach >= 199
    for k in range(3):
        store.append(order_states(orders.filter(F.col("o_orderkey") % 3 == k)))
    assert rows(store.indicators()) == rows(op.ma_set(bars_from_orders(orders), scope="symbol"))
