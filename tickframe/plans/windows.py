"""The one place window specifications are made.

A *scope* names the rows a window may see:

``symbol``  the whole series of one symbol;
``month``   one calendar month of one symbol (every month starts cold, which
            is how the reference's indicators behave);
``week``    one ISO week (Monday start) of one symbol;
``chunk``   one chunk of a symbol's series plus its halo rows
            (``plans.chunks.split_series``): same results as ``symbol`` for
            frames and lags within the halo, with bounded groups;
``chunk_month`` a calendar month inside one chunk (the month's earlier bars
            are in the same chunk or its halo when the halo holds >= 30 bars);
``chunk_week`` an ISO week inside one chunk.

Every spec is partitioned by ``symbol`` first, so no window ever plans a
``SinglePartition`` exchange. All specs of one scope share partition and
order expressions, which lets Catalyst fuse their frames into one ``Window``
operator per scope; and because ``hashpartitioning(symbol)`` also satisfies a
clustering on ``(symbol, month)``, a month-scope window placed after a
symbol-scope one needs a local sort but no new shuffle.

Group size: bars are daily, so a ``symbol`` group holds at most one row per
calendar day of the loaded range (about 366 per year) and a ``month`` group
at most 31, whatever the volume of the raw orders or events behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SCOPES = ("symbol", "month", "week", "chunk", "chunk_month", "chunk_week")


def cluster_by_symbol(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition bars by ``symbol`` once, before any window.

    ``hashpartitioning(symbol)`` satisfies the clustering of every scope
    (``symbol``, ``(symbol, month)``, ``(symbol, week)``), so all later window
    and per-symbol aggregate operators plan a local sort and no exchange.
    Without it each month-scope window keys on a freshly aliased
    ``trunc(Date, 'month')`` and Spark shuffles again for every one of them.
    Bars are already reduced (one row per symbol and day), so this is a small
    shuffle; the raw rows behind them are combined map side first.
    """
    if num_partitions is None:
        return df.repartition("symbol")
    return df.repartition(num_partitions, "symbol")


def scope_keys(scope: str) -> list[Column]:
    if scope == "symbol":
        return [F.col("symbol")]
    if scope == "month":
        return [F.col("symbol"), F.trunc("Date", "month")]
    if scope == "week":
        return [F.col("symbol"), F.date_trunc("week", "Date")]
    if scope == "chunk":  # a symbol's series split by plans.chunks.split_series
        return [F.col("symbol"), F.col("_chunk")]
    if scope == "chunk_month":
        return [F.col("symbol"), F.col("_chunk"), F.trunc("Date", "month")]
    if scope == "chunk_week":
        return [F.col("symbol"), F.col("_chunk"), F.date_trunc("week", "Date")]
    raise ValueError(f"unknown scope {scope!r}; expected one of {SCOPES}")


def bar_window(scope: str = "symbol", rows: int | None = None, descending: bool = False) -> WindowSpec:
    """Window over ``scope`` ordered by Date.

    ``rows=n`` gives the frame ``n`` preceding rows through the current row
    (``n + 1`` rows); ``rows=None`` leaves the frame unset (for ``lag``,
    ``row_number`` and running frames).
    """
    order = F.col("Date").desc() if descending else F.col("Date")
    spec = Window.partitionBy(*scope_keys(scope)).orderBy(order)
    if rows is not None:
        if rows < 0:
            raise ValueError("rows must be >= 0")
        spec = spec.rowsBetween(-rows, Window.currentRow)
    return spec


def running_window(scope: str = "symbol") -> WindowSpec:
    """From the first row of the scope through the current row."""
    return bar_window(scope).rowsBetween(Window.unboundedPreceding, Window.currentRow)
