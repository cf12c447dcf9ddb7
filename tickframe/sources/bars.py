"""Building and loading the bar table.

The reference downloads ready-made daily bars for one ticker. Here bars are
built from raw rows with one ``groupBy(symbol, Date)``: ``min``/``max`` and
``min_by``/``max_by`` are declarative aggregates, so Spark combines them map
side (partial aggregation) before the shuffle and a hot (symbol, day) key
costs one row per map task, not a third of the input in one reducer.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.plans.windows import cluster_by_symbol
from tickframe.schema import BAR_SCHEMA, BAR_SCHEMA_WITH_ACTIONS
from tickframe.sources.dimensions import normalise_symbol


# Input contracts of the raw tables the bar builders read (only the columns used).
# Declaring them skips schema inference (a footer-reading job per read) and
# fails fast if the source drifts.
ORDERS_COLUMNS = "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
EVENTS_COLUMNS = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars_from_ticks(
    ticks: DataFrame,
    symbol: Column | str,
    ts: Column | str,
    price: Column | str,
    order_key: Column,
    volume: Column,
    clustered: bool = True,
) -> DataFrame:
    """Daily OHLCV bars from raw rows.

    ``order_key`` orders rows inside a day (first row = Open, last = Close)
    and must be unique; ``volume`` is the aggregate used as Volume. Rows
    without a price name no Open or Close (but count in Volume); rows without
    a symbol or time belong to no bar.

    ``clustered=False`` leaves the bars as the aggregate spread them, by
    (symbol, Date): right for per-symbol aggregates, which then combine map
    side; windows want the default, one shuffle by symbol for all of them.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    price = c(price)
    priced = F.when(price.isNotNull(), order_key)  # min_by and max_by skip rows without a key
    ticks = ticks.filter(c(symbol).isNotNull() & c(ts).isNotNull())
    bars = ticks.groupBy(c(symbol).alias("symbol"), c(ts).cast("date").alias("Date")).agg(
        F.min_by(price, priced).alias("Open"),
        F.max(price).alias("High"),
        F.min(price).alias("Low"),
        F.max_by(price, priced).alias("Close"),
        volume.cast("bigint").alias("Volume"),
    )
    return cluster_by_symbol(bars) if clustered else bars


def bars_from_orders(orders: DataFrame, clustered: bool = True) -> DataFrame:
    """Fixture O: one symbol per order priority, turnover as Volume."""
    return bars_from_ticks(
        orders,
        symbol="o_orderpriority",
        ts="o_orderdate",
        price="o_totalprice",
        order_key=F.col("o_orderkey"),
        volume=F.sum(F.floor("o_totalprice").cast("bigint")),
        clustered=clustered,
    )


_SHIFT = Decimal(10**20)


def exact_order_key(df: DataFrame, ts: str, tie_breaker: str) -> Column:
    """One DECIMAL(38,0) that orders rows of a day exactly like ``(ts, tie_breaker)``.

    ``min_by``/``max_by`` with a struct key cannot use a hash aggregate (the
    buffer is not fixed-width), so Spark sorts every map task's rows instead.
    A DECIMAL(38,0) buffer is updatable in place, so this key keeps the bar
    build a hash aggregate. ``key = time * 10^20 + tie_breaker``: any two BIGINT
    tie-breakers differ by less than 10^20, so the order is lexicographic.
    ``time`` is micros since the epoch for TIMESTAMP; for TIMESTAMP_NTZ it is
    micros since midnight, which is exact and time-zone free inside the
    (symbol, day) group the key is used in. Both stay below 10^38.
    """
    t = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        secs = F.date_part(F.lit("SECOND"), t)  # decimal(8,6): seconds with microseconds
        micros = (F.hour(t) * 3600 + F.minute(t) * 60).cast("decimal(38,0)") * 1000000 + (secs * 1000000).cast(
            "decimal(38,0)")
    else:
        micros = F.unix_micros(t).cast("decimal(38,0)")
    shift = F.lit(_SHIFT).cast("decimal(38,0)")
    return (micros * shift + F.col(tie_breaker).cast("decimal(38,0)")).cast("decimal(38,0)")


def bars_from_events(events: DataFrame) -> DataFrame:
    """Fixture E: one symbol per event type, event count as Volume.

    Open/Close are the first/last value by ``(ts, event_id)``.
    """
    return bars_from_ticks(
        events,
        symbol="event_type",
        ts="ts",
        price="value",
        order_key=exact_order_key(events, "ts", "event_id"),
        volume=F.count(F.lit(1)),
    )


def load_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbols=None, actions: bool = False,
              normalise: bool = False) -> DataFrame:
    """Read a stored bar table with the fixed schema.

    A ``symbols`` list becomes an ``isin`` filter that Catalyst pushes into the
    scan (and prunes partitions when the table is partitioned by symbol); the
    few symbols are then read without a shuffle. ``actions`` adds Dividends
    and Stock_Splits; ``normalise`` trims and upper-cases the stored symbols
    (S7), before the ``symbols`` filter.
    """
    schema = BAR_SCHEMA_WITH_ACTIONS if actions else BAR_SCHEMA
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    if normalise:
        df = df.withColumn("symbol", normalise_symbol("symbol"))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return cluster_by_symbol(df) if symbols is None else df
