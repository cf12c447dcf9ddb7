"""Daily bars from an event stream (S10 for Structured Streaming).

The reference refetches finished daily bars on every page load. As a stream,
the same bars are kept up to date from raw events: a watermark on the event
time bounds the state (one row per symbol and open day) and, in ``append``
mode, each day's bar is emitted once, when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.sources.bars import exact_order_key


def stream_daily_bars(
    events: DataFrame,
    symbol: str = "event_type",
    ts: str = "ts",
    price: str = "value",
    tie_breaker: str = "event_id",
    volume: Column | None = None,
    lateness: str = "1 day",
) -> DataFrame:
    """Streaming twin of :func:`tickframe.sources.bars_from_events`.

    ``events`` is a streaming DataFrame (``spark.readStream``). Output columns
    match the bar table: symbol, Date, Open, High, Low, Close, Volume. Start it
    with ``outputMode("append")`` and a ``checkpointLocation`` on shared
    storage: offsets and the aggregation state live there, so a restarted
    query (or a lost executor) resumes without losing or repeating bars.

    Days are epoch-aligned ``window(ts, "1 day")`` buckets, i.e. UTC days; the
    batch builder's ``cast(ts as date)`` uses the session time zone, so the two
    agree under ``spark.sql.session.timeZone=UTC`` (append mode needs the
    window, a plain date key cannot evict state on the watermark).
    """
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    key = exact_order_key(events, ts, tie_breaker)
    vol = F.count(F.lit(1)) if volume is None else volume
    p = F.col(price)
    key = F.when(p.isNotNull(), key)  # rows without a price name no Open or Close
    events = events.filter(F.col(symbol).isNotNull() & F.col(ts).isNotNull())
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.col(symbol).alias("symbol"), F.window(ts, "1 day").alias("_day"))
        .agg(
            F.min_by(p, key).alias("Open"),
            F.max(p).alias("High"),
            F.min(p).alias("Low"),
            F.max_by(p, key).alias("Close"),
            vol.cast("bigint").alias("Volume"),
        )
        .select("symbol", F.to_date(F.col("_day.start")).alias("Date"), "Open", "High", "Low", "Close", "Volume")
    )


def late_rows(query) -> int:
    """Rows of the last micro-batch of a running ``StreamingQuery`` that came after the watermark and were dropped.

    ``lateness`` bounds the state by letting such rows go; this is their count, for monitoring.
    """
    progress = query.lastProgress or {"stateOperators": []}
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in progress["stateOperators"])


def write_bar_stream(events: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None, **kwargs):
    """Start :func:`stream_daily_bars` into a parquet table at ``path``.

    The file sink with a ``checkpoint`` on shared storage is exactly-once:
    each micro-batch commits atomically in the sink's log, and a restart
    replays from the checkpointed offsets. Returns the ``StreamingQuery``.
    """
    writer = (
        stream_daily_bars(events, **kwargs).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    if trigger_seconds is not None:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
