"""Features the reference promises in its text.

Missing values (fill / drop), normalisation, outlier flags, relative volume
and the efficiency ratio. All are per-symbol windows or aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.expr import safe_div
from tickframe.operators.quantiles import exact_percentiles
from tickframe.operators.returns import daily_return
from tickframe.plans.carries import before, every, over_carried_chunks
from tickframe.plans.session import cut_lineage
from tickframe.plans.windows import bar_window, running_window
from tickframe.schema import PRICE_COLUMNS


def keep_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P5: keep only the listed columns that exist, in the frame's order."""
    keep = set(columns)
    return df.select(*[c for c in df.columns if c in keep])


def complete_calendar(df: DataFrame) -> DataFrame:
    """One row per symbol and calendar day between its first and last bar.

    Days without a bar get NULL in every other column. Each bar emits its own
    day and the empty days before the next bar (``lead`` over the symbol
    window, then ``explode(sequence)``): one pass, no join back to the bars,
    so the raw rows behind them are never read twice.
    """
    values = [c for c in df.columns if c not in ("symbol", "Date")]
    last_day = F.coalesce(F.date_sub(F.lead("Date").over(bar_window("symbol")), 1), F.col("Date"))
    spread = df.withColumn("_last", last_day).select(
        "symbol", "Date", *values, F.explode(F.sequence(F.col("Date"), F.col("_last"))).alias("_day"))
    own = F.col("_day") == F.col("Date")
    return spread.select("symbol", F.col("_day").alias("Date"), *[F.when(own, F.col(c)).alias(c) for c in values])


def fill_forward(df: DataFrame, columns: Iterable[str] = (*PRICE_COLUMNS, "Volume"),
                 chunk_rows: int | None = None) -> DataFrame:
    """Replace a NULL by the symbol's last non-NULL value before it.

    ``chunk_rows`` hands each chunk the last non-NULL values before it (``plans.carries``).
    """
    columns = list(columns)
    last = lambda c, scope: F.last(c, ignorenulls=True).over(running_window(scope))
    if chunk_rows is None:
        for c in columns:
            df = df.withColumn(c, last(c, "symbol"))
        return df
    carried = lambda t: t.select("symbol", "_chunk", *[
        F.last(f"_last_{c}", ignorenulls=True).over(before()).alias(f"_before_{c}") for c in columns])
    return over_carried_chunks(
        df, chunk_rows, states={f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_row"))) for c in columns},
        combine=carried,
        finish=lambda d: d.withColumns({c: F.coalesce(last(c, "chunk"), f"_before_{c}") for c in columns}))


def drop_missing(df: DataFrame, columns: Iterable[str] = (*PRICE_COLUMNS, "Volume")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def normalise(df: DataFrame, columns: Iterable[str] = ("Close", "Volume"), method: str = "minmax",
              chunk_rows: int | None = None) -> DataFrame:
    """``{c}_norm`` per symbol: min-max to [0, 1] or z-score (sample stddev).

    ``chunk_rows`` combines minima and maxima, or counts, means and squared deviations, of the chunks
    (``plans.carries``) instead of holding a whole series in one window.
    """
    if method not in ("minmax", "zscore"):
        raise ValueError("method must be 'minmax' or 'zscore'")
    columns = list(columns)
    x = lambda c: F.col(c).cast("double")
    if chunk_rows is not None:
        return _normalise_chunks(df, columns, method, chunk_rows)
    w = Window.partitionBy("symbol")
    for c in columns:
        if method == "minmax":
            lo, hi = F.min(x(c)).over(w), F.max(x(c)).over(w)
            df = df.withColumn(f"{c}_norm", safe_div(x(c) - lo, hi - lo))
        else:
            df = df.withColumn(f"{c}_norm", safe_div(x(c) - F.avg(x(c)).over(w), F.stddev_samp(x(c)).over(w)))
    return df


def _normalise_chunks(df: DataFrame, columns: list[str], method: str, chunk_rows: int) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    if method == "minmax":
        states = {f"_{k}_{c}": f(x(c)) for c in columns for k, f in (("min", F.min), ("max", F.max))}

        def combine(t: DataFrame) -> DataFrame:
            return t.select("symbol", "_chunk", *[e.over(every()).alias(f"_{k}_of_{c}") for c in columns for k, e in (
                ("min", F.min(f"_min_{c}")), ("max", F.max(f"_max_{c}")))])
        norm = {c: safe_div(x(c) - F.col(f"_min_of_{c}"), F.col(f"_max_of_{c}") - F.col(f"_min_of_{c}")) for c in columns}
    else:
        states = {f"_{k}_{c}": e for c in columns for k, e in (
            ("n", F.count(x(c))), ("mean", F.avg(x(c))), ("square", F.var_pop(x(c)) * F.count(x(c))))}

        def combine(t: DataFrame) -> DataFrame:
            total = lambda e: F.sum(e).over(every())
            for c in columns:
                t = t.withColumn(f"_n_of_{c}", total(F.col(f"_n_{c}")))
                t = t.withColumn(f"_mean_of_{c}", safe_div(total(F.col(f"_n_{c}") * F.col(f"_mean_{c}")),
                                                           F.col(f"_n_of_{c}")))
                away = F.col(f"_mean_{c}") - F.col(f"_mean_of_{c}")
                t = t.withColumn(f"_sd_of_{c}", F.when(F.col(f"_n_of_{c}") > 1, F.sqrt(
                    total(F.col(f"_square_{c}") + F.col(f"_n_{c}") * away * away) / (F.col(f"_n_of_{c}") - 1))))
            return t.select("symbol", "_chunk", *[f"_{k}_of_{c}" for c in columns for k in ("mean", "sd")])
        norm = {c: safe_div(x(c) - F.col(f"_mean_of_{c}"), F.col(f"_sd_of_{c}")) for c in columns}
    return over_carried_chunks(df, chunk_rows, states, combine,
                               lambda d: d.withColumns({f"{c}_norm": e for c, e in norm.items()}))


def flag_outliers(df: DataFrame, column: str = "daily_return", whisker: float = 1.5, exact: bool = True,
                  accuracy: int = 10_000, bounded: bool = False) -> DataFrame:
    """``is_outlier``: value outside the symbol's Tukey fences.

    Exact quartiles by default; ``exact=False`` uses a bounded-memory
    ``percentile_approx`` sketch in the same window, ``bounded=True`` exact selection, as in
    :func:`returns_boxplot`.
    """
    if column not in df.columns and column == "daily_return":
        df = daily_return(df)
    shares = [0.25, 0.75]
    if bounded:
        df = cut_lineage(df)
        quartiles = exact_percentiles(df, ["symbol"], column, shares).select("symbol", F.col("q").alias("_q"))
        df = df.join(quartiles, "symbol", "left")
    else:
        quartiles = F.percentile(column, shares) if exact else F.percentile_approx(column, shares, accuracy)
        df = df.withColumn("_q", quartiles.over(Window.partitionBy("symbol")))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    lo, hi = F.col("_q")[0] - whisker * iqr, F.col("_q")[1] + whisker * iqr
    return df.withColumn(
        "is_outlier", F.when(F.col(column).isNotNull(), (F.col(column) < lo) | (F.col(column) > hi))
    ).drop("_q")


def relative_volume(df: DataFrame, rows: int = 19, scope: str = "symbol") -> DataFrame:
    """Volume / mean Volume of the last ``rows + 1`` bars."""
    return df.withColumn(
        "relative_volume", safe_div(F.col("Volume").cast("double"), F.avg("Volume").over(bar_window(scope, rows)))
    )


def efficiency_ratio(df: DataFrame, n: int = 10, scope: str = "symbol") -> DataFrame:
    """``|Close - Close[n]| / sum(|dClose|) over the last n moves * 100``."""
    w = bar_window(scope)
    step = F.abs(F.col("Close") - F.lag("Close", 1).over(w))
    df = df.withColumn("_step", step)
    path = F.sum("_step").over(bar_window(scope, n - 1))
    net = F.abs(F.col("Close") - F.lag("Close", n).over(w))
    return df.withColumn(f"efficiency_ratio_{n}", safe_div(net, path) * 100).drop("_step")
