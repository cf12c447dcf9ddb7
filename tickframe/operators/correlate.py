"""Pair correlation.

Pairs are given here (a pair list, or every symbol against one benchmark), and
both forms read the bars once; ``operators.all_pairs`` correlates all pairs on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder, safe_div

METRICS = ("Close", "Volume", "High", "Low")


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; NULL for constant input or fewer than 2 rows.

    Spark's ``corr`` raises on zero variance under ANSI mode, and wrapping it
    in a CASE does not help (aggregates are evaluated first), hence
    ``covar_pop / (stddev_pop * stddev_pop)`` with a NULL-on-zero division.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    x, y = x.cast("double"), y.cast("double")
    # count the rows where both are present: the pairwise-complete sample
    both = x.isNotNull() & y.isNotNull()
    xp, yp = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_pop(xp, yp), F.stddev_pop(xp) * F.stddev_pop(yp))


def correlation_label(c: Column) -> Column:
    """``|c| > 0.7`` Strong, ``> 0.3`` Moderate (with sign), else Weak."""
    sign = F.when(c > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return F.when(
        c.isNotNull(),
        ladder(
            [
                (F.abs(c) > 0.7, F.concat(F.lit("Strong "), sign)),
                (F.abs(c) > 0.3, F.concat(F.lit("Moderate "), sign)),
            ],
            F.lit("Weak"),
        ),
    )


def benchmark_pairs(bars: DataFrame, benchmark: str) -> DataFrame:
    """Every other symbol of ``bars`` paired with ``benchmark`` (a pairs table)."""
    return (
        bars.select(F.col("symbol").alias("symbol_a"))
        .filter(F.col("symbol_a") != benchmark)
        .distinct()
        .withColumn("symbol_b", F.lit(benchmark))
    )


def _correlate(per_day: DataFrame, null_as_zero: bool) -> DataFrame:
    """``per_day``: symbol_a, symbol_b, Date, {m}_a, {m}_b for dates both sides have a bar."""
    out = per_day.groupBy("symbol_a", "symbol_b").agg(
        F.count(F.lit(1)).alias("n_days"),
        *[guarded_corr(f"{m}_a", f"{m}_b").alias(f"corr_{m.lower()}") for m in METRICS],
    )
    return with_strength(out, null_as_zero)


def with_strength(out: DataFrame, null_as_zero: bool) -> DataFrame:
    """Price-range correlation and label of a table of correlations."""
    if null_as_zero:
        for m in METRICS:
            out = out.withColumn(f"corr_{m.lower()}", F.coalesce(f"corr_{m.lower()}", F.lit(0.0)))
    return out.withColumn(
        "price_range_corr", (F.col("corr_high") + F.col("corr_low")) / 2
    ).withColumn("correlation_label", correlation_label(F.col("corr_close")))


def benchmark_correlation(bars: DataFrame, benchmark: str, null_as_zero: bool = False) -> DataFrame:
    """A5-A7 of every symbol against ``benchmark``, in one pass over the bars.

    A window per Date hands the benchmark's bar of that day to every other
    row of the day, so neither a pairs table nor a self-join (a second scan
    of the raw data) is needed. A Date group holds one row per symbol.
    """
    day = Window.partitionBy("Date")
    is_b = F.col("symbol") == benchmark
    tagged = bars.select(
        F.col("symbol").alias("symbol_a"), "Date",
        *[F.col(m).alias(f"{m}_a") for m in METRICS],
        *[F.max(F.when(is_b, F.col(m))).over(day).alias(f"{m}_b") for m in METRICS],
        F.max(is_b).over(day).alias("_has_b"),
        is_b.alias("_is_b"),
    )
    per_day = tagged.filter(F.col("_has_b") & ~F.col("_is_b")).withColumn("symbol_b", F.lit(benchmark))
    return _correlate(per_day, null_as_zero)


def pair_correlation(bars: DataFrame, pairs: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """A5-A7 per requested pair: correlation of Close, Volume, High, Low over common dates.

    ``pairs`` has ``symbol_a``, ``symbol_b``. Each bar is tagged with the
    pairs and side it belongs to (a join with the pair list on ``symbol``,
    which keeps the bars' ``hash(symbol)`` partitioning), then grouped per
    (pair, Date) to line both sides up: one scan, no self-join.

    Output: ``corr_close``, ``corr_volume``, ``corr_high``, ``corr_low``,
    ``price_range_corr`` = (high + low) / 2, ``n_days`` and
    ``correlation_label`` of Close. ``null_as_zero=True`` turns undefined
    correlations into 0 as the reference does.
    """
    sides = pairs.select(F.col("symbol_a").alias("symbol"), F.lit("a").alias("_side"), "symbol_a", "symbol_b").union(
        pairs.select(F.col("symbol_b").alias("symbol"), F.lit("b").alias("_side"), "symbol_a", "symbol_b")
    ).distinct()
    # Spread the (small) bars over (symbol, Date) first: a symbol that sits in
    # many pairs then explodes into its pair rows across all tasks, not in the
    # one task that holds its whole series.
    tagged = bars.repartition("symbol", "Date").join(sides, "symbol")
    aggs = [F.max(F.col("_side") == side).alias(f"_has_{side}") for side in ("a", "b")]
    for side in ("a", "b"):
        aggs += [F.max(F.when(F.col("_side") == side, F.col(m))).alias(f"{m}_{side}") for m in METRICS]
    per_day = tagged.groupBy("symbol_a", "symbol_b", "Date").agg(*aggs).filter(F.col("_has_a") & F.col("_has_b"))
    return _correlate(per_day, null_as_zero)
