"""Split and dividend adjustment (§2.11).

A split of ``s`` on a day multiplies every earlier price by ``1 / s``, a dividend
``d`` by ``1 - d / previous Close``. A bar's factor is the product over all later bars: a
running product from the last bar back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import safe_div
from tickframe.plans.carries import after, over_carried_chunks
from tickframe.plans.windows import bar_window
from tickframe.schema import PRICE_COLUMNS


def _split() -> Column:
    return F.coalesce(safe_div(F.lit(1.0), "Stock_Splits"), F.lit(1.0))


def _day_factor(scope: str) -> Column:
    """What a bar's split and dividend do to the prices before it; 1 where there is none, or no previous Close."""
    dividend = F.lit(1.0) - safe_div("Dividends", F.lag("Close", 1).over(bar_window(scope)))
    return _split() * F.coalesce(F.when(F.col("Dividends") != 0, dividend), F.lit(1.0))


def _adjusted(df: DataFrame, factor: Column, split: Column) -> DataFrame:
    df = df.withColumns({"adjust_factor": factor, "split_factor": split})
    return df.withColumns({f"adjusted_{c.lower()}": F.col(c) * F.col("adjust_factor") for c in PRICE_COLUMNS} | {
        "adjusted_volume": safe_div(F.col("Volume").cast("double"), F.col("split_factor"))}).drop("split_factor")


def adjust_prices(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """``adjust_factor`` and adjusted Open, High, Low, Close and Volume of bars with Dividends and Stock_Splits.

    Prices follow splits and dividends, Volume splits only (more shares, the same money). The last bar keeps its
    prices. Null or zero actions change nothing, nor does a dividend without a previous Close.
    ``chunk_rows`` computes the same on bounded chunks: one factor per chunk, the product of the later chunks'
    factors carried to each.
    """
    line = lambda scope: bar_window(scope, descending=True).rowsBetween(Window.unboundedPreceding, -1)
    later = lambda c, scope: F.coalesce(F.product(c).over(line(scope)), F.lit(1.0))
    factors = lambda scope: lambda d: d.withColumns({"_day": _day_factor(scope), "_split": _split()})
    if chunk_rows is None:
        d = factors("symbol")(df)
        return _adjusted(d, later("_day", "symbol"), later("_split", "symbol")).drop("_day", "_split")
    carried = lambda c: F.coalesce(F.product(c).over(after()), F.lit(1.0))
    return over_carried_chunks(
        df, chunk_rows, prepare=factors("chunk"), lookback=1,
        states={"_days": F.product("_day"), "_splits": F.product("_split")},
        combine=lambda t: t.select("symbol", "_chunk", carried("_days").alias("_days_after"),
                                   carried("_splits").alias("_splits_after")),
        finish=lambda d: _adjusted(d, later("_day", "chunk") * F.col("_days_after"),
                                   later("_split", "chunk") * F.col("_splits_after")))
