"""Per-symbol profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder, pct_change, safe_div
from tickframe.operators.oscillators import momentum
from tickframe.operators.returns import daily_return
from tickframe.operators.volatility import volatility_label, volatility_metrics
from tickframe.plans.windows import bar_window
from tickframe.schema import numeric_columns

# Fixed values of the reference: day gaps with a name.
FREQUENCY_NAMES = {1: "Daily", 7: "Weekly", 30: "Monthly", 365: "Yearly"}


def basic_stats(df: DataFrame) -> DataFrame:
    """A1: ``{c}_mean``, ``{c}_stddev`` (sample), ``{c}_min``, ``{c}_max`` per numeric column."""
    aggs = []
    for c in numeric_columns(df.schema):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_stddev"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.groupBy("symbol").agg(*aggs)


def missing_counts(df: DataFrame) -> DataFrame:
    """A2: NULL count of every column, per symbol."""
    return df.groupBy("symbol").agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in df.columns if c != "symbol"]
    )


def data_frequency(df: DataFrame, scope: str = "month") -> DataFrame:
    """A3: most common day gap between consecutive bars, and its name.

    Gaps are taken inside ``scope`` (the reference uses calendar months). The
    missing gap of a scope's first bar is not a candidate; ties go to the
    smaller gap; a symbol with no gap at all gets NULL.
    """
    gaps = df.select(
        "symbol", F.datediff("Date", F.lag("Date", 1).over(bar_window(scope))).alias("gap_days")
    )
    counts = gaps.groupBy("symbol", "gap_days").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("symbol").agg(
        F.max_by(
            "gap_days", F.struct(F.col("gap_days").isNotNull(), F.col("n"), -F.col("gap_days"))
        ).alias("gap_days")
    )
    g = F.col("gap_days")
    name = ladder([(g == k, F.lit(v)) for k, v in FREQUENCY_NAMES.items()],
                  F.concat(F.lit("Custom ("), g.cast("string"), F.lit(" days)")))
    return mode.withColumn("frequency", F.when(g.isNotNull(), name))


def high_volume_ratio(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Percent of bars with Volume above ``factor`` x the symbol's mean Volume.

    The mean comes from a whole-symbol window; the following per-symbol
    aggregate reuses the window's ``hash(symbol)`` partitioning (one shuffle).
    """
    flagged = df.select("symbol", "Volume", F.avg("Volume").over(Window.partitionBy("symbol")).alias("avg_volume"))
    return flagged.groupBy("symbol").agg(
        F.first("avg_volume").alias("avg_volume"),
        F.count_if(F.col("Volume") > F.col("avg_volume") * factor).alias("high_volume_days"),
        F.count(F.lit(1)).alias("total_days"),
    ).withColumn("high_volume_ratio", safe_div(F.col("high_volume_days") * 100.0, F.col("total_days")))


def summary_position(df: DataFrame) -> DataFrame:
    """Period averages, latest bar vs them, latest volatility (and label) and momentum."""
    vm = momentum(volatility_metrics(df), 10)
    out = vm.groupBy("symbol").agg(
        F.max("Date").alias("Date"),
        F.avg("Close").alias("avg_price"),
        F.avg("Volume").alias("avg_volume"),
        F.max_by("Close", "Date").alias("latest_close"),
        F.max_by("Volume", "Date").alias("latest_volume"),
        F.max_by("daily_volatility", "Date").alias("daily_volatility"),
        F.max_by("momentum_10d", "Date").alias("momentum_10d"),
        F.avg("true_range").alias("avg_true_range"),
    )

    def side(c):
        return ladder([(F.col(c) > 0, F.lit("above")), (F.col(c) <= 0, F.lit("below"))])

    return (
        out.withColumn("price_vs_avg", pct_change("latest_close", "avg_price"))
        .withColumn("volume_vs_avg", pct_change("latest_volume", "avg_volume"))
        .withColumn("price_position", side("price_vs_avg"))
        .withColumn("volume_position", side("volume_vs_avg"))
        .withColumn("volatility_level", volatility_label("daily_volatility"))
    )


def sentiment_card(df: DataFrame, edge: str = "last", return_rows: int = 10, volume_rows: int = 5) -> DataFrame:
    """Recent mean return and volume vs the period.

    ``edge="last"`` takes the most recent bars; ``edge="first"`` the oldest,
    which is what the reference's ``head()`` on date-ascending rows returns.
    NULL returns among the taken bars are skipped; no return at all gives 0.
    """
    if edge not in ("first", "last"):
        raise ValueError("edge must be 'first' or 'last'")
    df = daily_return(df)
    rn = F.row_number().over(bar_window("symbol", descending=(edge == "last")))
    df = df.select("symbol", "daily_return", "Volume", rn.alias("_rn"))
    out = df.groupBy("symbol").agg(
        F.coalesce(F.avg(F.when(F.col("_rn") <= return_rows, F.col("daily_return"))), F.lit(0.0))
        .alias("avg_recent_return"),
        F.coalesce(F.avg(F.when(F.col("_rn") <= volume_rows, F.col("Volume"))), F.lit(0.0))
        .alias("avg_recent_volume"),
        F.avg("Volume").alias("avg_volume"),
    )
    return out.withColumn(
        "price_trend", F.when(F.col("avg_recent_return") > 0, "Bullish").otherwise("Bearish")
    ).withColumn(
        "volume_trend", F.when(F.col("avg_recent_volume") > F.col("avg_volume"), "Increasing").otherwise("Decreasing")
    )


def volume_profile(df: DataFrame, bins: int = 10) -> DataFrame:
    """How Volume is spread over price: ``symbol, bin, low, high, days, volume, share, is_peak``.

    ``bins`` equal price ranges from the lowest to the highest Close of a symbol (all in the first one if these are
    equal); ``share`` in per cent, ``is_peak`` the range with most Volume (the lowest of equals). Ranges without a bar
    are left out, as are bars without Close or Volume. One pass over the bars: the price range comes from a window on
    their symbol partitioning, which the aggregate to ``bins`` rows a symbol uses as well.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    series = Window.partitionBy("symbol")
    used = df.withColumns({"_lo": F.min("Close").over(series), "_hi": F.max("Close").over(series)}).filter(
        F.col("Close").isNotNull() & F.col("Volume").isNotNull())
    place = F.floor((F.col("Close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int")
    used = used.withColumn(
        "bin", F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(bins - 1))).otherwise(0))
    out = used.groupBy("symbol", "bin", "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("days"), F.sum("Volume").alias("volume"))
    step, whole = (F.col("_hi") - F.col("_lo")) / bins, Window.partitionBy("symbol")
    return out.select(
        "symbol", "bin", (F.col("_lo") + step * F.col("bin")).alias("low"),
        (F.col("_lo") + step * (F.col("bin") + 1)).alias("high"), "days", "volume",
        (safe_div(F.col("volume").cast("double"), F.sum("volume").over(whole)) * 100).alias("share"),
        (F.row_number().over(whole.orderBy(F.desc("volume"), "bin")) == 1).alias("is_peak"))
