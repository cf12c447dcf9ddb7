"""Operator 4, embedding near-duplicates by E8 lattice hashing.

Vectors of one label are projected at random into 8-dimensional blocks, each
decoded to its nearest E8 lattice point; the points of a table's blocks name
a cell. A vector is filed in its own cell of every table and probes the
neighbouring cells closest to it. Vectors that meet are compared by cosine in
double precision.

Scale: exact copies become one class first (map-side combined). Cells are
found on 8-byte keys; vectors are fetched only for cells where two classes
meet. A crowded cell is dealt out in blocks (``HOME_BLOCK`` x ``QUERY_BLOCK``)
that are compared by matrix products, so no task holds a whole group and no
pairs are emitted: a block returns per class its number of links (each pair
counted only at the first place where it meets) and one tree link to the
block's smallest class.

* null label, null / zero / empty vector, null or non-finite component: links with nothing;
* vectors of different length are never compared;
* equal vectors under several ids are linked to each other; ties at the threshold are links;
* repeated rows of one id are separate vectors, whatever they hold; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import component_ids, named_classes, smallest_reachable, stored
from tickframe.llm.lattice import LatticeHash

TABLES, BLOCKS, PROBES, SCALE, SEED = 12, 2, 8, 0.62, 20240607
HOME_BLOCK, QUERY_BLOCK = 1024, 4096
PAIRS_AT_ONCE = 200_000


def _hash_of(dim: int, cache: dict = {}) -> LatticeHash:  # noqa: B006 (one table per worker)
    if dim not in cache:
        cache[dim] = LatticeHash(dim, TABLES, BLOCKS, PROBES, SCALE, SEED)
    return cache[dim]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for huge or tiny components."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key, cells, label salt and vector of every usable row; nulls for the others."""
    for b in batches:
        n = b.num_rows
        key, home, near, salt, raw = ([None] * n for _ in range(5))
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (label, v) in enumerate(zip(b.column("label").to_pylist(), b.column("v").to_pylist())):
            if label is None or not v or any(c is None for c in v):
                continue
            x = np.array(v, np.float64) + 0.0
            if np.isfinite(x).all() and x.any():
                raw[i] = x.tobytes()
                name = f"{label}/{len(x)}".encode()
                key[i] = hashlib.md5(name + b"\0" + raw[i]).digest()
                salt[i] = int.from_bytes(hashlib.md5(name).digest()[:8], "little", signed=True)
                by_dim.setdefault(len(x), []).append((i, x))
        for dim, rows in by_dim.items():
            own, probed = _hash_of(dim).keys(_unit(np.stack([x for _, x in rows])))
            for (i, _), h, p in zip(rows, own, probed):
                home[i], near[i] = (h ^ salt[i]).tolist(), (p ^ salt[i]).ravel().tolist()
        cells = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(key, pa.binary()), pa.array(home, cells), pa.array(near, cells),
             pa.array(salt, pa.int64()), pa.array(raw, pa.binary())],
            names=["id", "key", "home", "near", "salt", "raw"])


class _Block:
    """Rows of whole units, compared unit by unit: ``links`` and a tree of links per class."""

    def __init__(self, t: pa.Table, threshold: float):
        unit = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")], 1)
        rep, home = t.column("rep").to_numpy(), t.column("home").to_numpy()
        self.names, first, self.of = np.unique(rep, return_index=True, return_inverse=True)
        self.m, self.salt = t.column("m").to_numpy()[first], t.column("salt").to_numpy()[first]
        self.cell, self.threshold = unit[:, 0], threshold
        raw = b"".join(t.column("raw").take(first).to_pylist())
        self.x = _unit(np.frombuffer(raw).reshape(len(first), -1))
        self.links = np.zeros(len(first), np.int64)
        self.linked = np.zeros(len(first), bool)
        self.parent = list(range(len(first)))
        # rows are sorted by unit, home rows first
        start = np.flatnonzero(np.r_[True, (np.diff(unit, axis=0) != 0).any(1)])
        size = np.diff(np.r_[start, len(t)])
        homes = np.add.reduceat(home.astype(np.int64), start)
        crowded = homes * (size - homes) > 20_000
        for lo, h, n in zip(start[crowded], homes[crowded], size[crowded]):
            close = np.argwhere(self.x[self.of[lo + h:lo + n]] @ self.x[self.of[lo:lo + h]].T >= threshold - 1e-9)
            self._pairs(lo + h + close[:, 0], lo + close[:, 1])
        unit_of = np.repeat(np.arange(len(start)), size)
        query = np.flatnonzero(~home & ~crowded[unit_of])  # each meets all home rows of its unit
        times = homes[unit_of[query]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self._pairs(np.repeat(query, times), np.repeat(start[unit_of[query]], times) + within)

    def _pairs(self, q: np.ndarray, h: np.ndarray) -> None:
        keep = self.of[q] != self.of[h]
        q, h = q[keep], h[keep]
        for k in range(0, len(q), PAIRS_AT_ONCE):
            self._verify(self.of[q[k:k + PAIRS_AT_ONCE]], self.of[h[k:k + PAIRS_AT_ONCE]],
                         self.cell[h[k:k + PAIRS_AT_ONCE]])

    def _verify(self, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> None:
        """Cosine of the pairs that met in ``cell``, the own cell of ``b``."""
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x = self.x[used]
        ia, ib = at[:len(a)], at[len(a):]
        ok = np.einsum("ij,ij->i", x[ia], x[ib]) >= self.threshold
        a, b, cell, ia, ib = a[ok], b[ok], cell[ok], ia[ok], ib[ok]
        if not len(a):
            return
        # each pair counts where it meets first: tables in order, own cells before probed ones
        own, near = _hash_of(x.shape[1]).keys(x)
        own, near = own ^ self.salt[used][:, None], near ^ self.salt[used][:, None, None]
        same = own[ia] == own[ib]
        probe = (near[ia] == own[ib][:, :, None]).any(2)
        back = (near[ib] == own[ia][:, :, None]).any(2)
        t, row = (same | probe | back).argmax(1), np.arange(len(a))
        first = (own[ib][row, t] == cell) & np.where(same[row, t], a < b, probe[row, t] & (~back[row, t] | (b < a)))
        np.add.at(self.links, a[first], self.m[b[first]])
        np.add.at(self.links, b[first], self.m[a[first]])
        self.linked[a] = self.linked[b] = True
        for u, v in set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())):
            u, v = self.root(u), self.root(v)
            self.parent[max(u, v)] = min(u, v)

    def root(self, u: int) -> int:
        while self.parent[u] != u:
            self.parent[u] = u = self.parent[self.parent[u]]
        return u


def _batches_of_units(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Re-cut a stream that is sorted by unit so that no unit is split; a unit's size is bounded."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        unit = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")], 1)
        change = np.flatnonzero((np.diff(unit, axis=0) != 0).any(1)) + 1
        if len(t) >= least and len(change):
            yield t.slice(0, change[-1])
            t = t.slice(change[-1])
        rest = t
    if rest is not None and len(rest):
        yield rest


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label: str = "label",
                     embedding: str = "embedding") -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``."""
    data = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"),
                          F.col(embedding).alias("v"))
    filed = stored(data.mapInArrow(
        _cells, "id long, key binary, home array<long>, near array<long>, salt long, raw binary"), "vectors")
    classes = stored(filed.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    classes, by_id = named_classes(classes, "classes")
    # one row per class: the copies of a class have equal cells; from here on a class goes by its node
    reps = stored(filed.filter("key is not null").withColumnRenamed("key", "k").join(
        classes, (F.col("k") == F.col("key")) & (F.col("id") == F.col("rep"))).dropDuplicates(["node"])
        .select(F.col("node").alias("rep"), "m", "home", "near", "salt", "raw"), "class-vectors")
    rows = reps.select("rep", F.explode("home").alias("cell"), F.lit(True).alias("own")).unionByName(
        reps.select("rep", F.explode(F.array_except("near", "home")).alias("cell"), F.lit(False).alias("own")))
    met = stored(rows.groupBy("cell").agg(F.count_if("own").alias("h"), F.count("*").alias("n"))
                 .filter("h >= 1 and n >= 2"), "cells")
    hb, qb = f"int(ceil(h / {HOME_BLOCK}))", f"int(ceil(n / {QUERY_BLOCK}))"
    members = rows.join(met, "cell")
    placed = members.filter("own").selectExpr(
        "cell", "rep", "true as home", f"int(pmod(xxhash64(rep, 1), {hb})) as i",
        f"explode(sequence(0, {qb} - 1)) as j").unionByName(members.selectExpr(
            "cell", "rep", "false as home", f"explode(sequence(0, {hb} - 1)) as i",
            f"int(pmod(xxhash64(rep, 2), {qb})) as j"))
    units = placed.join(reps.select("rep", "m", "salt", "raw"), "rep")
    units = units.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units in _batches_of_units(batches):
            size = pc.binary_length(units.column("raw"))
            for n in size.unique().to_pylist():  # a unit holds vectors of one length
                block = _Block(units.filter(pc.equal(size, n)), threshold)
                found = np.flatnonzero(block.linked)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.names[found]), pa.array(block.links[found]),
                         pa.array(block.names[[block.root(k) for k in found]])], names=["rep", "links", "root"])

    found = stored(units.mapInArrow(compare, "rep long, links long, root long"), "links")
    component = smallest_reachable(found.selectExpr("rep as a", "root as b"), "vector-components")
    links = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    placed_in = classes.join(component, "node", "left") if by_id else component_ids(classes, component)
    per_class = placed_in.join(links, "node", "left").select(
        "key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    per_class = stored(per_class, "class-results")
    out = filed.select("id", "key").join(per_class, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))

