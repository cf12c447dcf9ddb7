"""Per-symbol previews and top-k (L1-L4).

``row_number() <= k`` over a per-symbol window plans a ``WindowGroupLimit``
below the shuffle, so each map task forwards at most ``k`` rows per symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.trend import EXPLORE_MA_PERIODS, moving_averages
from tickframe.plans.windows import bar_window


def _edge_rows(df: DataFrame, n: int, descending: bool) -> DataFrame:
    rn = F.row_number().over(bar_window("symbol", descending=descending))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def preview_first(df: DataFrame, n: int = 40) -> DataFrame:
    """L1: the first ``n`` bars of each symbol."""
    return _edge_rows(df, n, descending=False)


def preview_last(df: DataFrame, n: int = 40) -> DataFrame:
    """L2: the last ``n`` bars of each symbol."""
    return _edge_rows(df, n, descending=True)


def recent_ma(df: DataFrame, n: int = 5, periods=EXPLORE_MA_PERIODS) -> DataFrame:
    """L3: Date, Close and Close moving averages of the last ``n`` bars."""
    df = moving_averages(df.select("symbol", "Date", "Close"), "Close", periods)
    return preview_last(df, n)
