"""Pivots, support and resistance levels, volume divergence (§2.11).

A pivot is a bar whose High (Low) is the highest (lowest) of the bars up to ``span`` before and after it. It is known
only ``span`` bars later: the frame is evaluated on that later bar, looking back, so
the operators run on chunks like any other (``plans.chunks``) and never use a bar that had not
happened yet when the pivot is confirmed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder
from tickframe.plans.chunks import over_chunks
from tickframe.plans.session import cut_lineage
from tickframe.plans.windows import bar_window

SPAN = 5
NEAR_PCT = 1.0


def _with_pivots(df: DataFrame, span: int, scope: str) -> DataFrame:
    """On the bar ``span`` bars after it: ``_pivots`` (kind, price), ``_pivot_date`` and ``_pivot_volume``."""
    w, frame = bar_window(scope), bar_window(scope, 2 * span)
    full = F.count(F.lit(1)).over(frame) == 2 * span + 1
    high, low = F.lag("High", span).over(w), F.lag("Low", span).over(w)
    df = df.withColumns({
        "_pivot_date": F.lag("Date", span).over(w), "_pivot_volume": F.lag("Volume", span).over(w), "_full": full,
        "_high": high, "_low": low, "_top": F.max("High").over(frame), "_bottom": F.min("Low").over(frame)})
    kind = lambda name, at, price: F.when(F.col("_full") & at, F.struct(
        F.lit(name).alias("kind"), F.col(price).alias("price")))
    found = F.array(kind("high", F.col("_high") == F.col("_top"), "_high"),
                    kind("low", F.col("_low") == F.col("_bottom"), "_low"))
    return df.withColumn("_pivots", F.filter(found, lambda x: x.isNotNull())).drop(
        "_full", "_high", "_low", "_top", "_bottom")


def pivots(df: DataFrame, span: int = SPAN, chunk_rows: int | None = None) -> DataFrame:
    """``symbol, Date, kind, price, volume`` of every pivot; ``kind`` is ``high`` or ``low``.

    A bar needs ``span`` bars on both sides. Equal extremes are all pivots; bars without a High (Low) are none.
    ``chunk_rows`` runs over bounded chunks of each series.
    """
    if chunk_rows is None:
        found = _with_pivots(df, span, "symbol")
    else:
        found = over_chunks(df, lambda d: _with_pivots(d, span, "chunk"), chunk_rows=chunk_rows)
    return found.filter(F.size("_pivots") > 0).select(
        "symbol", F.col("_pivot_date").alias("Date"), F.inline("_pivots"), F.col("_pivot_volume").alias("volume"))


def support_resistance(df: DataFrame, span: int = SPAN, near_pct: float = NEAR_PCT,
                       chunk_rows: int | None = None) -> DataFrame:
    """Levels that pivots touched: ``symbol, kind, level, low, high, strength, first_touch, last_touch``.

    ``kind`` is ``resistance`` (pivot highs) or ``support`` (pivot lows). In order of price, a pivot closer than
    ``near_pct`` per cent to the one below joins its level; ``level`` is the mean price, ``strength`` the touches.
    Prices of zero and below name no level.

    Pivots are first summed in price bins of half that width on a log scale (pivots of a bin always belong
    together), so the window that joins levels sees one row per bin: their number depends on the price
    range, not on the length of the history.
    """
    step = math.log1p(near_pct / 100)
    found = pivots(df, span, chunk_rows).filter("price > 0")
    bins = found.groupBy("symbol", "kind", F.floor(F.ln("price") / (step / 2)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price").alias("_sum"), F.min("price").alias("_low"),
        F.max("price").alias("_high"), F.min("Date").alias("_first"), F.max("Date").alias("_last"))
    line = Window.partitionBy("symbol", "kind").orderBy("_bin")
    apart = F.col("_low") >= F.lag("_high").over(line) * (1 + near_pct / 100)
    bins = bins.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1)))
    bins = bins.withColumn("_level", F.sum("_new").over(line))
    levels = bins.groupBy("symbol", "kind", "_level").agg(
        (F.sum("_sum") / F.sum("_n")).alias("level"), F.min("_low").alias("low"), F.max("_high").alias("high"),
        F.sum("_n").alias("strength"), F.min("_first").alias("first_touch"), F.max("_last").alias("last_touch"))
    return levels.withColumn("kind", F.when(F.col("kind") == "high", "resistance").otherwise("support")).drop("_level")


def volume_divergence(df: DataFrame, span: int = SPAN, chunk_rows: int | None = None) -> DataFrame:
    """Every pivot with the previous one of its kind, and what the Volume says about it.

    ``Bearish divergence``: a higher pivot high on lower Volume than the previous high. ``Bullish divergence``: a
    lower pivot low on lower Volume than the previous low. ``Confirmed``: the same move on a Volume at least as high. Else
    ``None``; without a previous pivot or a Volume NULL.

    With ``chunk_rows`` the last pivot of each kind is carried from year to year: a year's pivots are compared inside
    it, its first ones with the last of the years before.
    """
    found = pivots(df, span, chunk_rows)
    now = F.struct("Date", "price", "volume")
    line = Window.partitionBy("symbol", "kind").orderBy("Date")
    if chunk_rows is None:
        found = found.withColumn("_previous", F.lag(now).over(line))
    else:
        found = _previous_over_years(found)
    found = found.withColumns({"previous_date": F.col("_previous.Date"), "previous_price": F.col("_previous.price"),
                               "previous_volume": F.col("_previous.volume")}).drop("_previous")
    further = F.when(F.col("kind") == "high", F.col("price") > F.col("previous_price")).otherwise(
        F.col("price") < F.col("previous_price"))
    less = F.col("volume") < F.col("previous_volume")
    named = ladder([(further & less & (F.col("kind") == "high"), F.lit("Bearish divergence")),
                    (further & less, F.lit("Bullish divergence")), (further, F.lit("Confirmed"))], F.lit("None"))
    known = F.col("previous_price").isNotNull() & F.col("volume").isNotNull() & F.col("previous_volume").isNotNull()
    return found.withColumn("divergence", F.when(known, named))


def _previous_over_years(found: DataFrame) -> DataFrame:
    """``_previous`` as the plain ``lag`` gives it, from windows over one year of a symbol's pivots each.

    The last pivot of a kind in each year is carried on over a table of one row per symbol, kind and year.
    """
    found = cut_lineage(found.withColumn("_year", F.year("Date")))
    now = F.struct("Date", "price", "volume")
    last = found.groupBy("symbol", "kind", "_year").agg(F.max(now).alias("_last"))
    years = Window.partitionBy("symbol", "kind").orderBy("_year")
    carried = last.select("symbol", "kind", "_year", F.lag("_last").over(years).alias("_carried"))
    inside = Window.partitionBy("symbol", "kind", "_year").orderBy("Date")
    return found.join(carried, ["symbol", "kind", "_year"]).select(
        "symbol", "Date", "kind", "price", "volume", F.coalesce(F.lag(now).over(inside), "_carried").alias("_previous"))
