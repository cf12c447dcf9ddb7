"""Look-back ranges.

``as_of`` is the exclusive end date. Left as ``None`` it is each symbol's last
bar + 1 day, so results never depend on the wall clock. The range filter
belongs *before* any indicator, as in the reference (indicators start cold at
the range start).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: preset look-back lengths in days.
PRESET_DAYS = {"1 Month": 30, "3 Months": 90, "6 Months": 180, "1 Year": 365, "2 Years": 730, "5 Years": 1825}


def _end(bars: DataFrame, as_of) -> tuple[DataFrame, Column]:
    if as_of is None:
        # whole-symbol max: one pass over the bars, on the hash(symbol) shuffle of the indicator windows after it
        bars = bars.withColumn("_as_of", F.date_add(F.max("Date").over(Window.partitionBy("symbol")), 1))
        return bars, F.col("_as_of")
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return bars, F.lit(as_of)


def lookback(bars: DataFrame, days: int | str, as_of=None, warmup_days: int = 0) -> DataFrame:
    """Bars with ``as_of - days <= Date < as_of``; ``days`` is a number or the name of a preset.

    ``warmup_days`` keeps that many earlier days as well, for indicators that
    should not start cold; the caller drops them afterwards.
    """
    if isinstance(days, str):
        days = PRESET_DAYS[days]
    if days < 1 or warmup_days < 0:
        raise ValueError("days must be at least 1 and warmup_days at least 0")
    days += warmup_days
    bars, end = _end(bars, as_of)
    out = bars.filter((F.col("Date") >= F.date_sub(end, days)) & (F.col("Date") < end))
    return out.drop("_as_of")


def lookback_ytd(bars: DataFrame, as_of=None) -> DataFrame:
    """Bars from 1 January of the year of the last included day."""
    bars, end = _end(bars, as_of)
    last = F.date_sub(end, 1)
    out = bars.filter((F.col("Date") >= F.trunc(last, "year")) & (F.col("Date") < end))
    return out.drop("_as_of")


def stored_lookback(stored: DataFrame, days: int | str, last: DataFrame | None = None, month: str = "month") -> DataFrame:
    """:func:`lookback` over bars stored by month (``month``: the partition column), reading only months in range.

    Each symbol's last Date comes first: from ``last(symbol, last)`` where a summary table has it
    (``incremental.BarStore.summary``), else from a partial aggregate over the stored symbols and Dates. The months that
    any symbol's range touches (a list bounded by the calendar) are then a filter on the partition column, and
    each symbol's own range a join on its last Date: no window over whole series.
    """
    if isinstance(days, str):
        days = PRESET_DAYS[days]
    if days < 1:
        raise ValueError("days must be at least 1")
    if last is None:
        last = stored.groupBy("symbol").agg(F.max("Date").alias("last"))
    ends = last.groupBy("symbol").agg(F.max("last").alias("_last")).filter(F.col("_last").isNotNull())
    start = F.date_sub("_last", days - 1)
    each = F.explode(F.sequence(F.trunc(start, "month"), F.trunc("_last", "month"), F.expr("INTERVAL 1 MONTH")))
    months = [r[0] for r in ends.select(each).distinct().collect()]
    inside = stored.filter(F.col(month).isin([F.lit(m) for m in months]))
    return inside.join(ends, "symbol").filter((F.col("Date") >= start) & (F.col("Date") <= F.col("_last"))).select(
        *stored.columns)
