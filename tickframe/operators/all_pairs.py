"""Correlation of all pairs of symbols (J1 on request), in tiles.

Symbols are dealt to blocks; a tile is a pair of blocks. Every bar is sent to the tiles of
its block, and a task accumulates a tile's co-moments day batch by day batch as matrix
products: counts, sums, squares and cross products over the days where both
symbols have a value. No row per (pair, day) ever exists: the shuffle holds bars x blocks
rows, a task one batch of days and a few ``block x block`` matrices.

Values are centred and scaled per symbol first, so the sums don't cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.correlate import METRICS, with_strength
from tickframe.plans.session import cut_lineage

BLOCK = 256
DAYS = 256
# A series counts as constant over a pair's common days below this share of its mean square.
CONSTANT = 1e-13
_OUT = ("i int, j int, a int, b int, n_days long, " + ", ".join(f"corr_{m.lower()} double" for m in METRICS))


class _Tile:
    """Co-moments of ``block`` symbols against ``block`` others, over the days added so far."""

    def __init__(self, block: int, metrics: int):
        self.both = np.zeros((block, block))
        # per metric: days, sums of either side, squares of either side, cross products
        self.sums = np.zeros((metrics, 6, block, block))

    def add(self, here: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray]) -> None:
        """Days x symbols of both sides: whether there is a bar, and the metrics (NaN where missing)."""
        self.both += here[0].T @ there[0]
        for k, s in enumerate(self.sums):
            x, y = here[1][k], there[1][k]
            p, q = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
            x, y = np.where(p > 0, x, 0.0), np.where(q > 0, y, 0.0)
            for at, (left, right) in enumerate(((p, q), (x, q), (p, y), (x * x, q), (p, y * y), (x, y))):
                s[at] += left.T @ right

    def correlations(self) -> np.ndarray:
        """Metrics x block x block; NaN where either series is constant over the common days."""
        n, sx, sy, sxx, syy, sxy = np.moveaxis(self.sums, 1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            flat = (vx <= CONSTANT * sxx / n) | (vy <= CONSTANT * syy / n)
            return np.where(flat, np.nan, (sxy / n - sx / n * (sy / n)) / np.sqrt(vx * vy))


def _side(side: int, batch: dict[str, np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    day = np.unique(batch["day"], return_inverse=True)[1]
    days = day.max() + 1
    here = batch["side"] == side
    bar, values = np.zeros((days, block)), np.full((len(METRICS), days, block), np.nan)
    bar[day[here], batch["idx"][here]] = 1.0
    for k, m in enumerate(METRICS):
        values[k, day[here], batch["idx"][here]] = batch[m][here]
    return bar, values


def _tiles(block: int, k: int | None):
    """Rows ``i, j, day, side, idx, metrics`` in tile and day order -> pairs of each tile (the ``k`` best a symbol)."""
    def finished(key: tuple[int, int], tile: _Tile) -> pa.RecordBatch:
        corr, n = tile.correlations(), tile.both
        own = key[0] == key[1]
        keep = n > 0
        if own:
            keep &= np.triu(np.ones_like(keep), 1)
        if k is not None:
            keep &= _best(corr[METRICS.index("Close")], keep, k, own)
        a, b = np.nonzero(keep)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), key[0], np.int32)), pa.array(np.full(len(a), key[1], np.int32)),
             pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[a, b].astype(np.int64)),
             *[pa.array(c[a, b], from_pandas=True) for c in corr]],
            names=["i", "j", "a", "b", "n_days", *[f"corr_{m.lower()}" for m in METRICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, held = None, None, None
        for b in batches:
            data = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "day", "side", "idx")}
            data |= {m: b.column(m).to_numpy(zero_copy_only=False).astype(float) for m in METRICS}
            if held is not None:
                data = {c: np.concatenate([held[c], x]) for c, x in data.items()}
            cuts = np.flatnonzero((np.diff(data["i"]) != 0) | (np.diff(data["j"]) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(data["i"])]):
                if lo == hi:
                    continue
                if key is not None and key != (data["i"][lo], data["j"][lo]):
                    yield finished(key, tile)
                    tile = None
                key = int(data["i"][lo]), int(data["j"][lo])
                tile = tile or _Tile(block, len(METRICS))
                # the last day of the batch may go on in the next one
                end = hi if hi < len(data["i"]) else lo + int(np.searchsorted(data["day"][lo:hi], data["day"][hi - 1]))
                _added(tile, key, {c: x[lo:end] for c, x in data.items()}, block)
                held = {c: x[end:hi] for c, x in data.items()}
        if key is not None:
            _added(tile, key, held, block)
            yield finished(key, tile)
    return run


def _added(tile: _Tile, key: tuple[int, int], rows: dict[str, np.ndarray], block: int) -> None:
    """Adds rows in day order, ``DAYS`` days at a time."""
    day = np.cumsum(np.r_[0, np.diff(rows["day"]) != 0]) if len(rows["day"]) else rows["day"]
    cuts = np.searchsorted(day, np.arange(0, int(day[-1]) + 1, DAYS)) if len(day) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(day)]):
        part = {c: x[lo:hi] for c, x in rows.items()}
        here = _side(0, part, block)
        tile.add(here, here if key[0] == key[1] else _side(1, part, block))


def _best(corr: np.ndarray, keep: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Pairs among the ``k`` strongest of either symbol in this tile (ties all stay)."""
    strength = np.where(keep, np.nan_to_num(np.abs(corr), nan=-1.0), -2.0)
    if own:
        strength = np.maximum(strength, strength.T)
    k = min(k, strength.shape[0])
    bar = lambda x: np.partition(x, -k, axis=1)[:, -k][:, None]
    return (strength >= bar(strength)) | (strength.T >= bar(strength.T)).T


def all_pairs_correlation(bars: DataFrame, top: int | None = None, block: int = BLOCK,
                          null_as_zero: bool = False) -> DataFrame:
    """A5-A7 of every pair of symbols with a common day; the columns of ``pair_correlation``, ``symbol_a < symbol_b``.

    ``top`` keeps, for each symbol, its ``top`` partners of largest ``|corr_close|`` (undefined ones last, then by
    name); a pair stays if it is among the best of either symbol. Rows without a symbol or Date take no part.
    """
    bars = bars.filter(F.col("symbol").isNotNull() & F.col("Date").isNotNull())
    value = {m: F.col(m).cast("double") for m in METRICS}
    series = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"),
        *[e.alias(f"_{k}_{m}") for m, v in value.items() for k, e in (("mean", F.avg(v)), ("sd", F.stddev_pop(v)))])
    # blocks by hash, places inside a block by name: no window over all symbols
    blocks = max(1, -(-bars.select(F.approx_count_distinct("symbol", 0.02)).first()[0] * 5 // (4 * block)))
    series = series.withColumn("_block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    in_block = Window.partitionBy("_block").orderBy("symbol")
    series = series.withColumn("_place", F.row_number().over(in_block) - 1).withColumns({
        "_block": (F.col("_block") + F.floor(F.col("_place") / block) * blocks).cast("int"),  # an overfull block goes on
        "_idx": (F.col("_place") % block).cast("int")})
    series = cut_lineage(series)
    total = (series.agg(F.max("_block")).first()[0] or 0) + 1
    scaled = [((value[m] - F.col(f"_mean_{m}")) / F.when(F.col(f"_sd_{m}") > 0, F.col(f"_sd_{m}")).otherwise(1.0)).alias(m)
              for m in METRICS]
    other = F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("_other")
    rows = bars.join(series, "symbol").select("Date", "_block", "_idx", *scaled, other).select(
        F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"),
        F.unix_date("Date").alias("day"), (F.col("_block") > F.col("_other")).cast("int").alias("side"),
        F.col("_idx").alias("idx"), *METRICS)
    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", "day")
    pairs = dealt.mapInArrow(_tiles(block, top), _OUT)
    name = lambda side, b, p: series.select(
        F.col("symbol").alias(f"_{side}"), F.col("_block").alias(b), F.col("_idx").alias(p))
    pairs = pairs.join(name("x", "i", "a"), ["i", "a"]).join(name("y", "j", "b"), ["j", "b"])
    pairs = pairs.select(F.least("_x", "_y").alias("symbol_a"), F.greatest("_x", "_y").alias("symbol_b"), "n_days",
                         *[f"corr_{m.lower()}" for m in METRICS])
    if top is not None:
        sides = pairs.withColumn("_of", F.explode(F.array("symbol_a", "symbol_b")))
        best = Window.partitionBy("_of").orderBy(F.desc_nulls_last(F.abs("corr_close")), "symbol_a", "symbol_b")
        pairs = sides.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top).drop(
            "_of", "_rank").dropDuplicates(["symbol_a", "symbol_b"])
    return with_strength(pairs, null_as_zero)
