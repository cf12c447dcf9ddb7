"""Returns (W1-W4, W7, W16, A4, A16, A17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import pct_change, safe_div
from tickframe.operators.quantiles import exact_percentiles
from tickframe.plans.carries import every, over_carried_chunks
from tickframe.plans.chunks import over_chunks
from tickframe.plans.session import cut_lineage
from tickframe.plans.windows import bar_window, running_window

RETURN_COLUMNS = ("intraday_return", "weekly_return", "monthly_return")


def intraday_return(df: DataFrame) -> DataFrame:
    """``(Close - Open) / Open * 100`` (the reference's first ``daily_return``)."""
    return df.withColumn("intraday_return", pct_change("Close", "Open"))


def daily_return(df: DataFrame, scope: str = "symbol", name: str = "daily_return") -> DataFrame:
    """Close-to-close change in percent vs the previous bar."""
    prev = F.lag("Close", 1).over(bar_window(scope))
    return df.withColumn(name, pct_change("Close", prev))


def period_returns(df: DataFrame, week_rows: int = 5, month_rows: int = 21, chunk_rows: int | None = None,
                   chunk: str = "") -> DataFrame:
    """Intraday, weekly and monthly return.

    Weekly/monthly compare Close with the first Close of a frame of
    ``rows + 1`` bars that stays inside the ISO week / calendar month.
    ``chunk_rows`` runs over bounded chunks of each series (``plans.chunks``).
    """
    if chunk_rows is not None:
        return over_chunks(df, lambda d: period_returns(d, week_rows, month_rows, chunk="chunk_"),
                           chunk_rows=chunk_rows)
    first_w = F.first("Close").over(bar_window(f"{chunk}week", week_rows))
    first_m = F.first("Close").over(bar_window(f"{chunk}month", month_rows))
    return (
        intraday_return(df)
        .withColumn("weekly_return", pct_change("Close", first_w))
        .withColumn("monthly_return", pct_change("Close", first_m))
    )


def returns_summary(df: DataFrame) -> DataFrame:
    """A4: mean and sample stddev of each return per symbol."""
    df = period_returns(df)
    aggs = []
    for c in RETURN_COLUMNS:
        kind = c.split("_")[0]
        aggs += [F.avg(c).alias(f"avg_{kind}_return"), F.stddev_samp(c).alias(f"{kind}_return_volatility")]
    return df.groupBy("symbol").agg(*aggs)


def returns_boxplot(df: DataFrame, whisker: float = 1.5, exact: bool = True, accuracy: int = 10_000,
                    bounded: bool = False) -> DataFrame:
    """Box-plot numbers per symbol and return type.

    Exact quartiles (linear interpolation), Tukey fences at ``whisker`` x IQR,
    whiskers at the most extreme values inside the fences, outlier count.
    The quartiles come from a window over (symbol, return type), which the
    bars' ``hash(symbol)`` partitioning already satisfies, so neither the
    window nor the final aggregate shuffles. A group is one symbol's daily
    series of one return type: its size is bounded by the days in range.

    ``exact=False`` uses ``percentile_approx`` (a sketch of ``accuracy``, rank
    error about 1/accuracy), whose buffer has bounded size, in the same window:
    one scan, no extra shuffle.

    ``bounded=True`` finds the same exact quartiles by selection (``quantiles.exact_percentiles``): no task holds a
    group, at the price of several counting passes.
    """
    long = (
        period_returns(df)
        .select("symbol", F.explode(F.array(*[
            F.struct(F.lit(c).alias("return_type"), F.col(c).alias("value")) for c in RETURN_COLUMNS
        ])).alias("r"))
        .select("symbol", "r.return_type", "r.value")
        .filter(F.col("value").isNotNull())
    )
    shares = [0.25, 0.5, 0.75]
    if bounded:
        long = cut_lineage(long)
        quartiles = exact_percentiles(long, ["symbol", "return_type"], "value", shares).select(
            "symbol", "return_type", F.col("q").alias("_q"))
        long = long.join(quartiles, ["symbol", "return_type"])
    else:
        quartiles = F.percentile("value", shares) if exact else F.percentile_approx("value", shares, accuracy)
        long = long.withColumn("_q", quartiles.over(Window.partitionBy("symbol", "return_type")))
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    iqr = q3 - q1
    lo, hi = q1 - whisker * iqr, q3 + whisker * iqr
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    return long.groupBy("symbol", "return_type").agg(
        F.count("value").alias("n"),
        F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
        F.first(iqr).alias("iqr"), F.first(lo).alias("lower_fence"), F.first(hi).alias("upper_fence"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def rebase(df: DataFrame, base: float = 100.0, chunk_rows: int | None = None) -> DataFrame:
    """``Close / first Close of the symbol * base``.

    ``chunk_rows`` hands the first chunk's first Close to the others (``plans.carries``).
    """
    done = lambda d, first: d.withColumn("rebased", safe_div("Close", first) * base)
    if chunk_rows is None:
        return done(df, F.first("Close").over(running_window("symbol")))
    return over_carried_chunks(
        df, chunk_rows, states={"_first": F.min_by("Close", "_row")},
        combine=lambda t: t.select("symbol", "_chunk", F.first("_first").over(every()).alias("_base")),
        finish=lambda d: done(d, F.col("_base")))


def quote_change(df: DataFrame) -> DataFrame:
    """Last bar per symbol with its change vs the bar before (0 if none or 0)."""
    w = bar_window("symbol", descending=True)
    last2 = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    out = last2.groupBy("symbol").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("Date"))).alias("Date"),
        F.max(F.when(F.col("_rn") == 1, F.col("Close"))).alias("current_price"),
        F.max(F.when(F.col("_rn") == 2, F.col("Close"))).alias("previous_close"),
        F.max(F.when(F.col("_rn") == 1, F.col("Volume"))).alias("volume"),
    )
    return out.withColumn(
        "price_change_pct",
        F.coalesce(pct_change("current_price", "previous_close"), F.lit(0.0)),
    )
