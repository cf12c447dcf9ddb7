"""Volatility (W7-W9, W13, W17, A11, A12) and the §2.11 range measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder, pct_change, safe_div
from tickframe.plans.chunks import chunked
from tickframe.plans.stages import Stage, apply_stages
from tickframe.plans.windows import bar_window


def volatility_metrics(df: DataFrame, rows: int = 20, scope: str = "symbol",
                       chunk_rows: int | None = None) -> DataFrame:
    """``daily_change`` (%), ``true_range`` and ``daily_volatility``.

    ``daily_volatility`` is the sample stddev of ``daily_change`` over
    ``rows + 1`` bars. ``true_range`` skips the missing previous close on the
    first bar (``greatest`` ignores NULLs), giving High - Low there.
    """
    if chunk_rows is not None:
        return chunked(df, scope, chunk_rows, lambda d, s: volatility_metrics(d, rows, s))
    w = bar_window(scope)
    prev = F.lag("Close", 1).over(w)
    df = df.withColumns({
        "daily_change": pct_change("Close", prev),
        "true_range": F.greatest(
            F.col("High") - F.col("Low"),
            F.abs(F.col("High") - prev),
            F.abs(F.col("Low") - prev),
        ),
    })
    return df.withColumns({"daily_volatility": F.stddev_samp("daily_change").over(bar_window(scope, rows))})


def volatility_label(col) -> F.Column:
    """``>2`` high, ``>1`` moderate, else low; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), ladder([(c > 2, F.lit("high")), (c > 1, F.lit("moderate"))], F.lit("low")))


def avg_true_range(df: DataFrame) -> DataFrame:
    """Mean true range per symbol over the whole period."""
    return volatility_metrics(df).groupBy("symbol").agg(F.avg("true_range").alias("avg_true_range"))


def rolling_atr(df: DataFrame, rows: int = 13, scope: str = "symbol") -> DataFrame:
    """§2.11: rolling mean true range over ``rows + 1`` bars."""
    if "true_range" not in df.columns:
        df = volatility_metrics(df, scope=scope)
    return df.withColumn(f"atr_{rows + 1}", F.avg("true_range").over(bar_window(scope, rows)))


def bollinger_bands(df: DataFrame, period: int = 20, std_dev: float = 2.0, scope: str = "symbol",
                    extra_row: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """middle = mean, bands = middle +/- ``std_dev`` x sample stddev.

    The reference's frame is ``period + 1`` rows (``extra_row=True``).
    """
    if chunk_rows is not None:
        return chunked(df, scope, chunk_rows, lambda d, s: bollinger_bands(d, period, std_dev, s, extra_row))
    return apply_stages(df, bollinger_stages(period, std_dev, scope, extra_row))


def bollinger_stages(period: int = 20, std_dev: float = 2.0, scope: str = "symbol",
                     extra_row: bool = True) -> list[Stage]:
    w = bar_window(scope, period if extra_row else period - 1)
    mid, sd = F.avg("Close").over(w), F.stddev_samp("Close").over(w)
    return [{"bb_middle": mid, "bb_std": sd, "bb_upper": mid + sd * std_dev, "bb_lower": mid - sd * std_dev}]


def bollinger_position(df: DataFrame) -> DataFrame:
    """Per symbol, latest ``(Close - lower) / (upper - lower) * 100`` and its label."""
    if "bb_upper" not in df.columns:
        df = bollinger_bands(df)
    latest = latest_row(df.select("symbol", "Date", "Close", "bb_lower", "bb_middle", "bb_upper"))
    return latest.withColumn("bb_position", bb_position_expr()).withColumn(
        "bb_signal", bb_signal_expr(F.col("bb_position"))
    )


def bb_position_expr() -> F.Column:
    """``(Close - bb_lower) / (bb_upper - bb_lower) * 100``; NULL for a zero-width band."""
    return safe_div(F.col("Close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")) * 100


def bb_signal_expr(pos: F.Column) -> F.Column:
    """``<20`` Oversold, ``>80`` Overbought, else Neutral; NULL stays NULL."""
    return F.when(
        pos.isNotNull(),
        ladder([(pos < 20, F.lit("Oversold")), (pos > 80, F.lit("Overbought"))], F.lit("Neutral")),
    )


def latest_row(df: DataFrame) -> DataFrame:
    """The last bar of each symbol, all columns kept.

    ``max_by`` over a struct is a per-symbol aggregate with map-side
    combining: no sort of the series and no window buffer.
    """
    others = [c for c in df.columns if c != "symbol"]
    return (
        df.groupBy("symbol")
        .agg(F.max_by(F.struct(*others), F.col("Date")).alias("_last"))
        .select("symbol", "_last.*")
    )
