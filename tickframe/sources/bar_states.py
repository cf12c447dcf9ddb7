"""Mergeable bars (S10): the state of a (symbol, Date) that further raw rows can be added to.

A bar keeps prices only; its state also keeps the order keys of the first and last priced row. States of
the same day merge with the aggregates they were built with, so new files and late rows update
a day without reading its earlier raw rows, in any order and any split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.schema import BAR_COLUMNS
from tickframe.sources.bars import exact_order_key

STATE_SCHEMA = ("symbol string, Date date, open_key decimal(38,0), Open double, close_key decimal(38,0), Close double, "
                "High double, Low double, Volume bigint")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "Date").agg(
        F.min("open_key").alias("open_key"), F.min_by("Open", "open_key").alias("Open"),
        F.max("close_key").alias("close_key"), F.max_by("Close", "close_key").alias("Close"),
        F.max("High").alias("High"), F.min("Low").alias("Low"), F.sum("Volume").cast("bigint").alias("Volume"))


def bar_states(ticks: DataFrame, symbol: str, ts: str, price: str, order_key: Column, volume: Column) -> DataFrame:
    """States of raw rows; arguments as in ``bars_from_ticks``, but ``volume`` is one row's share of Volume.

    Every raw row must be given once: rows delivered twice count twice in Volume.
    """
    price = F.col(price)
    key = F.when(price.isNotNull(), order_key.cast("decimal(38,0)"))
    rows = ticks.filter(F.col(symbol).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(symbol).alias("symbol"), F.col(ts).cast("date").alias("Date"), key.alias("open_key"), price.alias("Open"),
        key.alias("close_key"), price.alias("Close"), price.alias("High"), price.alias("Low"),
        volume.cast("bigint").alias("Volume"))
    return _merged(rows)


def order_states(orders: DataFrame) -> DataFrame:
    """States of fixture O's bars."""
    return bar_states(orders, "o_orderpriority", "o_orderdate", "o_totalprice", F.col("o_orderkey"),
                      F.floor("o_totalprice"))


def event_states(events: DataFrame) -> DataFrame:
    """States of fixture E's bars."""
    return bar_states(events, "event_type", "ts", "value", exact_order_key(events, "ts", "event_id"), F.lit(1))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state per (symbol, Date) of several tables of states."""
    return _merged(reduce(DataFrame.unionByName, states))


def bars_from_states(states: DataFrame) -> DataFrame:
    return states.select(*BAR_COLUMNS)
