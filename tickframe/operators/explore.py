"""The exploration tab's per-bar indicators as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import pct_change
from tickframe.operators.trend import EXPLORE_MA_PERIODS
from tickframe.plans.chunks import over_chunks
from tickframe.plans.stages import apply_stages, merge_stages
from tickframe.plans.windows import bar_window


def _stages(scope: str) -> list[dict]:
    w = bar_window(scope)
    prev = F.lag("Close", 1).over(w)
    volatility = [
        {"daily_change": pct_change("Close", prev),
         "true_range": F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - prev),
                                  F.abs(F.col("Low") - prev))},
        {"daily_volatility": F.stddev_samp("daily_change").over(bar_window(scope, 20))},
    ]
    momentum = [{"momentum_10d": pct_change("Close", F.lag("Close", 10).over(w))}]
    mas = [{f"Close_MA_{n}": F.avg("Close").over(bar_window(scope, n - 1)) for n in EXPLORE_MA_PERIODS}]
    return merge_stages(volatility, momentum, mas)


def exploration_indicators(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """daily_change, true_range, daily_volatility, momentum_10d and Close_MA_5/20/50 per bar.

    Same values as ``volatility_metrics``, ``momentum`` and ``moving_averages``
    (whole-series scope), in 2 projections and one window operator per level.
    ``chunk_rows`` runs it over bounded chunks of each series (``plans.chunks``).
    """
    if chunk_rows is not None:
        return over_chunks(df, lambda d: apply_stages(d, _stages("chunk")), chunk_rows=chunk_rows)
    return apply_stages(df, _stages("symbol"))
