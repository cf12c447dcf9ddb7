"""Exact split of long per-symbol series into bounded chunks.

A ``symbol``-scope window sees one symbol's whole history in one task. All
frames and lags in this library reach back a bounded number of rows, so a
series can be cut into chunks of ``chunk_rows`` consecutive bars and each
chunk extended by a *halo*: copies of the ``lookback`` bars that precede it.
Windows then run per ``(symbol, chunk)`` (scopes ``"chunk"``, ``"chunk_month"``,
``"chunk_week"``) and the halo rows are dropped afterwards. Every kept row
sees exactly the frame it would see over the whole series, so results are
identical, while no task holds more than ``chunk_rows + lookback`` rows of one
symbol.

The halo's length is read from the plan that the operator builds
(:func:`reach`), so it cannot fall behind a changed period. Calendar scopes
count on one bar per (symbol, Date), which the bar builders give.

Row numbers come without a per-symbol window: bars are counted per
(symbol, year) (a small aggregate), a running sum over those counts gives each
year's first row number, and a row number inside (symbol, year) completes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.plans.session import cut_lineage

HELPER_COLUMNS = ("_year", "_row", "_chunk", "_halo")
DEFAULT_CHUNK_ROWS = 4096
# Earlier daily bars that a calendar month can hold (a week holds fewer).
CALENDAR_ROWS = 30
CHUNK_SCOPES = {"symbol": "chunk", "month": "chunk_month", "week": "chunk_week"}


def reach(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> int:
    """How many rows back ``fn``'s windows can see: an upper bound, read from the plan it builds.

    Window operators may read each other's columns, so their frames and lags
    add up; those inside a calendar month or week never leave it together.
    A frame without a bound, or one that looks ahead, raises: such an operator
    cannot run on chunks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_year", T.IntegerType()),
                           T.StructField("_row", T.LongType()), T.StructField("_chunk", T.LongType()),
                           T.StructField("_halo", T.BooleanType())])
    rows, calendar = 0, 0
    todo = [fn(df.sparkSession.createDataFrame([], schema))._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() != "Window":
            continue
        frames = re.findall(r"RowFrame, ([^,]+), ([^)]+)", "".join(
            node.windowExpressions().apply(i).toString() for i in range(node.windowExpressions().size())))
        if not frames or any("unbounded" in low + high or re.match("[1-9]", low) or re.match("[1-9]", high)
                             for low, high in frames):
            raise ValueError("an operator with an unbounded or forward frame cannot run on chunks")
        back = max(-int(low) if low.startswith("-") else 0 for low, _ in frames)
        if node.partitionSpec().size() > 2:  # symbol, chunk and a calendar key
            calendar += back
        else:
            rows += back
    return rows + min(calendar, CALENDAR_ROWS)


def split_series(df: DataFrame, lookback: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Bars tagged with ``_chunk``, plus ``_halo`` copies of the ``lookback`` rows before each chunk.

    One pass: a row among the last ``lookback`` of its chunk is also emitted
    into the next chunk.
    """
    if lookback < 0:
        raise ValueError("lookback must be >= 0")
    if chunk_rows < max(lookback, 1):
        raise ValueError(f"chunk_rows must be at least the {lookback} rows the operator looks back")
    tagged = df.withColumn("_year", F.year("Date"))
    per_year = tagged.groupBy("symbol", "_year").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_year.select("symbol", "_year", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_year = Window.partitionBy("symbol", "_year").orderBy("Date")
    rows = (
        tagged.repartition("symbol", "_year")
        .join(starts, ["symbol", "_year"])
        .withColumn("_row", F.col("_start") + F.row_number().over(in_year) - 1)
        .drop("_start")
        .withColumn("_own", F.floor(F.col("_row") / chunk_rows))
    )
    also_next = F.col("_row") % chunk_rows >= chunk_rows - lookback
    chunks = F.when(also_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    rows = rows.withColumn("_chunk", F.explode(chunks)).withColumn("_halo", F.col("_chunk") > F.col("_own"))
    return rows.drop("_own").repartition("symbol", "_chunk")


def merge_series(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns."""
    return df.filter(~F.col("_halo")).drop(*HELPER_COLUMNS)


def over_chunks(df: DataFrame, fn: Callable[[DataFrame], DataFrame], lookback: int | None = None,
                chunk_rows: int = DEFAULT_CHUNK_ROWS, materialize: bool = True) -> DataFrame:
    """``fn`` (built with a chunk scope) over the split series; same rows as over the whole series.

    ``lookback`` defaults to what ``fn``'s plan reaches; a smaller one raises.
    The split reads the bars twice (per-year counts and the rows); Catalyst
    prunes the count branch to other columns, so without materialising the
    bars Spark would rebuild them, scanning the raw rows again. With
    ``materialize`` (default) the bars are checkpointed once into the shared
    ``spark.checkpoint.dir`` and both branches read the checkpoint.
    """
    needed = reach(df, fn)
    if lookback is not None and lookback < needed:
        raise ValueError(f"lookback={lookback}, but the operator looks back up to {needed} rows")
    if materialize:
        df = cut_lineage(df)
    return merge_series(fn(split_series(df, needed if lookback is None else lookback, chunk_rows)))


def chunked(df: DataFrame, scope: str, chunk_rows: int, fn: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``fn(df, scope)`` over chunks: the operators' ``chunk_rows=`` form."""
    return over_chunks(df, lambda d: fn(d, CHUNK_SCOPES[scope]), chunk_rows=chunk_rows)
