"""State that crosses chunk borders: running results over a whole series, chunk by chunk.

``plans.chunks`` cuts series whose frames reach back a bounded number of rows.
Running totals, first or last values and whole-series extremes have no such bound. Here
every chunk is reduced to a small state (one aggregate, combined map side), the states
of a symbol are combined in chunk order (a window over the small chunk table, one
row per ``chunk_rows`` bars), and the result is joined back to the chunk's rows on
``(symbol, chunk)``. No task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickframe.plans.chunks import HELPER_COLUMNS, merge_series, split_series
from tickframe.plans.session import cut_lineage


def before() -> WindowSpec:
    """The chunks before this one."""
    return Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    """The chunks after this one, the last first (a growing frame, so combining them is linear)."""
    return Window.partitionBy("symbol").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)


def every() -> WindowSpec:
    """All chunks of the symbol, in order."""
    return Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def over_carried_chunks(
    df: DataFrame,
    chunk_rows: int,
    states: Mapping[str, Column],
    combine: Callable[[DataFrame], DataFrame],
    finish: Callable[[DataFrame], DataFrame],
    prepare: Callable[[DataFrame], DataFrame] = lambda d: d,
    lookback: int = 0,
) -> DataFrame:
    """``finish`` over the rows of each chunk joined with what the other chunks hand on.

    ``prepare`` adds columns per chunk (``lookback`` rows of the chunk before are there, and gone afterwards);
    ``states`` are aggregates over a chunk's rows (``_row`` orders them); ``combine`` turns the table
    ``symbol, _chunk, *states`` into the carried columns, with the frames of this module; ``finish`` sees both and
    may use windows of scope ``chunk``. Columns that ``prepare`` and ``combine`` add are dropped unless
    ``finish`` renames them away.
    """
    own = df.columns
    chunks = split_series(cut_lineage(df), lookback, chunk_rows)
    chunks = prepare(chunks).filter(~F.col("_halo"))
    table = combine(chunks.groupBy("symbol", "_chunk").agg(*[c.alias(name) for name, c in states.items()]))
    done = merge_series(finish(chunks.join(table, ["symbol", "_chunk"])))
    helpers = {*table.columns, *chunks.columns, *HELPER_COLUMNS} - set(own)
    return done.drop(*helpers)
