"""Moving averages and crossovers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder
from tickframe.plans.stages import Stage, apply_stages
from tickframe.plans.windows import bar_window

# Fixed values of the reference: MA periods drawn on the exploration tab and
# the MA set used by the scored signals.
EXPLORE_MA_PERIODS = (5, 20, 50)
SIGNAL_MA_PERIODS = (5, 10, 20, 50, 200)


def moving_average(df: DataFrame, column: str = "Close", window: int = 5, scope: str = "symbol") -> DataFrame:
    """``{column}_MA_{window}``, mean of the last ``window`` rows (partial at start)."""
    return df.withColumn(f"{column}_MA_{window}", F.avg(column).over(bar_window(scope, window - 1)))


def moving_averages(df: DataFrame, column: str = "Close", windows: Iterable[int] = EXPLORE_MA_PERIODS,
                    scope: str = "symbol") -> DataFrame:
    return df.withColumns(
        {f"{column}_MA_{n}": F.avg(column).over(bar_window(scope, n - 1)) for n in windows}
    )


def ma_cross(df: DataFrame, short: int = 5, long: int = 20, scope: str = "symbol") -> DataFrame:
    """Golden/Death cross of two Close moving averages -> ``ma_cross_signal``."""
    s, l = f"Close_MA_{short}", f"Close_MA_{long}"
    missing = [n for n, name in ((short, s), (long, l)) if name not in df.columns]
    if missing:
        df = moving_averages(df, "Close", missing, scope)
    w = bar_window(scope)
    ps, pl = F.lag(s, 1).over(w), F.lag(l, 1).over(w)
    sig = ladder(
        [
            ((F.col(s) > F.col(l)) & (ps <= pl), F.lit("Golden Cross (Buy)")),
            ((F.col(s) < F.col(l)) & (ps >= pl), F.lit("Death Cross (Sell)")),
        ],
        F.lit("No Signal"),
    )
    return df.withColumn("ma_cross_signal", sig)


def ma_set(df: DataFrame, periods: Iterable[int] = SIGNAL_MA_PERIODS, scope: str = "month",
           extra_row: bool = True) -> DataFrame:
    """``ma_{n}`` for each period.

    The reference's frame is ``n`` preceding rows plus the current one
    (``extra_row=True``) inside one calendar month (``scope="month"``), so
    ma_50 and ma_200 are month-to-date means there. ``scope="symbol"`` and
    ``extra_row=False`` give textbook n-row averages over the whole series.
    """
    return apply_stages(df, ma_set_stages(periods, scope, extra_row))


def ma_set_stages(periods: Iterable[int] = SIGNAL_MA_PERIODS, scope: str = "month",
                  extra_row: bool = True) -> list[Stage]:
    return [{f"ma_{n}": F.avg("Close").over(bar_window(scope, n if extra_row else n - 1)) for n in periods}]
