"""Operator 10, near-duplicate documents by fast similarity sketching.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round ``i`` every element is
placed in one hashed bin with the value ``i`` plus a random fraction, and a
bin keeps its least value; the rounds stop when all bins are filled. From
round ``t`` on, round ``t + k`` offers every element to bin ``k``, so ``2t``
rounds always fill them all. A document of n shingles costs O(n + t log t),
not n times t, and the bins estimate the Jaccard similarity as sharply as
independent hash functions.

Steps, each a Spark job over tables in the shared folder:

1. sketch every document; documents with equal shingle sets form a class
   (map-side combined), represented by the smallest id;
2. the sketch is cut into bands; classes that share a band meet in a bucket.
   Every member is checked against the bucket's leader on the full sets;
3. classes connected by buckets form a cluster. In clusters that still hold
   several components, every pair of different components is checked on the
   full sets, in blocks of bounded size, by products of 0/1 incidence
   matrices. A block returns one tree link per class, never its pairs;
4. components of all confirmed links.

* null or empty text, or white space only: empty set, linked with nothing;
* fewer words than a shingle: the whole word sequence is the one shingle;
* very long texts are used whole; ties at the threshold are links;
* rows that share an id but not the text are documents of their own: each has its class's component;
* an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import by_size, component_ids, named_classes, smallest_reachable, stored
from tickframe.llm.shingles import scramble, shingle_set

BANDS, BAND_SIZE, SEED = 32, 5, 0x5EED
BLOCK = 512
# A cluster above this size is compared bucket by bucket instead of as a whole.
CLUSTER_LIMIT = 50_000
# Ids of documents that met another one: broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 2_000_000


def sketch(elements: np.ndarray, bins: int, seed: int = SEED) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit elements: (round, fraction) packed per bin."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    done, rounds = 0, max(1, bins // len(elements))  # several rounds of a small set at once
    while done < bins:
        i = np.arange(done, min(done + rounds, bins), dtype=np.uint64)
        h = scramble(elements[None, :] + scramble(i + np.uint64(seed))[:, None])
        value = (i << np.uint64(40))[:, None] | (h >> np.uint64(24))
        np.minimum.at(out, ((h & np.uint64(0xFFFFFF)) % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
        done += len(i)
        # bins filled in a round are final after it: later rounds only hold larger values
        if (out != np.iinfo(np.uint64).max).all():
            return out
    for k in np.flatnonzero(out == np.iinfo(np.uint64).max):  # rounds t .. 2t-1
        h = scramble(elements + scramble(np.uint64([bins + k + seed])))
        out[k] = (np.uint64(bins + k) << np.uint64(40)) | (h.min() >> np.uint64(24))
    return out


def band_keys(s: np.ndarray, bands: int, size: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in s.reshape(bands, size).T:
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.astype(np.int64)


def sketch_table(docs: DataFrame, words: int, bands: int, size: int, text: str, id_col: str) -> DataFrame:
    """``(id, n, key, bands)``: size and digest of the shingle set, and its band keys."""
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "t"):
            n, key, keys = [], [], []
            for t in b.column("t"):
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                key.append(set_key(s))
                keys.append(band_keys(sketch(s, bands * size), bands, size) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "key", "bands"])

    return data.mapInArrow(run, "id long, n long, key binary, bands array<long>")


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def full_sets(docs: DataFrame, ids: DataFrame, words: int, text: str, id_col: str) -> DataFrame:
    """``(rep, key, s)``: the shingle sets of the documents in ``ids(rep)``, with their class key."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    data = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).cast("binary").alias("t"))
    data = data.join(ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "t"):
            sets = [shingle_set(t.as_py(), words) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array(list(map(set_key, sets)), pa.binary()),
                 pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "key", "s"])

    return data.mapInArrow(run, "rep long, key binary, s array<long>")


def _compare(rep: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Tree links between different components of one block, confirmed on the full sets."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # an element of one set only is in no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    at, width = at[shared], int(column.max()) + 1 if shared.any() else 0
    parent = {int(c): int(c) for c in set(component.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    names, number = np.unique(component, return_inverse=True)
    largest = np.bincount(number).argmax()
    rows = np.flatnonzero(number != largest)  # pairs inside the largest component need no check
    both = np.zeros((len(rows), len(sets)), np.float32)
    for k in range(0, width, 4096):
        m = np.zeros((len(sets), min(4096, width - k)), np.float32)
        inside = (column >= k) & (column < k + 4096)
        m[at[inside], column[inside] - k] = 1
        both += m[rows] @ m.T
    both = np.rint(both).astype(np.int64)
    close = 100 * both >= percent * (size[rows][:, None] + size[None, :] - both)
    close &= (both > 0) & (component[rows][:, None] != component[None, :])
    for i, j in zip(*np.nonzero(close)):
        u, v = root(int(component[rows[i]])), root(int(component[j]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            links.append((int(rep[rows[i]]), int(rep[j])))
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, size: int = BAND_SIZE,
                    text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``percent``: documents are linked at 100 * intersection >= percent * union.
    """
    out = grouped(docs, words, percent, bands, size, text, id_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def grouped(docs: DataFrame, words: int, percent: int, bands: int, size: int, text: str, id_col: str) -> DataFrame:
    """``(id, n, key, component, root)``: size and digest of every row's shingle set, smallest id of its component.

    Components of different roots are different ones, even where repeated ids give them the same smallest id.
    """
    sketched = stored(sketch_table(docs, words, bands, size, text, id_col), "sketches")
    classes = stored(sketched.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    classes, by_id = named_classes(classes, "classes")
    # from here on a class goes by its node
    rows = sketched.join(classes, ["key"]).filter("id = rep").select(
        F.col("node").alias("rep"), F.explode("bands").alias("bucket"))
    buckets = stored(rows.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min_by("rep", F.xxhash64("rep")).alias("leader")).filter("members > 1"),
        "buckets")
    met = stored(rows.join(buckets, "bucket").select("bucket", "rep", "leader"), "met")
    nodes = met.select("rep").distinct()
    if by_id:
        sets = full_sets(docs, nodes, words, text, id_col).drop("key")
    else:  # an id may stand for several classes: their keys tell the sets apart
        wanted = stored(classes.join(nodes.withColumnRenamed("rep", "node"), "node", "left_semi"), "wanted")
        sets = full_sets(docs, wanted.select("rep").distinct(), words, text, id_col).drop("rep").join(
            wanted.select("key", F.col("node").alias("rep")), "key").select("rep", "s")
    sets = stored(sets.dropDuplicates(["rep"]), "sets")

    pairs = met.filter("rep <> leader").select(
        F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    pairs = pairs.join(sets.withColumnsRenamed({"rep": "a", "s": "sa"}), "a").join(
        sets.withColumnsRenamed({"rep": "b", "s": "sb"}), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    # components of the confirmed links (odd nodes) and clusters of all candidates (even nodes), found together
    graph = links.selectExpr("2 * a + 1 as a", "2 * b + 1 as b").unionByName(
        met.selectExpr("2 * rep as a", "2 * leader as b"))
    parts = smallest_reachable(graph, "near-parts")
    first = parts.filter("node % 2 <> 0").selectExpr("shiftright(node, 1) as rep", "shiftright(component, 1) as component")
    cluster = parts.filter("node % 2 = 0").selectExpr("shiftright(node, 1) as rep", "shiftright(component, 1) as cluster")
    known = stored(cluster.join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "known")
    mixed = known.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.count("*").alias("members"))
    mixed = stored(mixed.filter("low < high").select("cluster", "members"), "mixed")
    members = known.join(mixed, "cluster")
    units = members.filter(F.col("members") <= CLUSTER_LIMIT).selectExpr(
        "xxhash64('cluster', cluster) as unit", "rep", "component").unionByName(
        members.filter(F.col("members") > CLUSTER_LIMIT).join(met.select("bucket", "rep"), "rep").selectExpr(
            "xxhash64('bucket', bucket) as unit", "rep", "component"))
    units = stored(units, "units")
    sized = stored(units.groupBy("unit").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "sized")
    units = units.join(sized, "unit").selectExpr(
        "unit", "rep", "component", "int(pmod(xxhash64(rep, 3), blocks)) as own",
        "explode(sequence(0, blocks - 1)) as other").selectExpr(
        "unit", "rep", "component", "least(own, other) as i", "greatest(own, other) as j")
    units = units.join(sets, "rep").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "rep")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches, ["unit", "i", "j"]):
            links = _compare(t.column("rep").to_numpy(), t.column("component").to_numpy(),
                             [np.array(s.as_py(), np.int64) for s in t.column("s")], percent)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = units.mapInArrow(check, "a long, b long")
    # links of the first round stand as links to their component
    component = smallest_reachable(first.selectExpr("rep as a", "component as b").unionByName(more), "near-components")
    placed_in = classes.join(component, "node", "left") if by_id else component_ids(classes, component)
    component = F.coalesce("component", "rep")
    per_class = stored(placed_in.select("key", component.alias("component"), (
        component if by_id else F.col("root")).alias("root")), "class-results")
    return sketched.select("id", "n", "key").join(per_class, "key", "left").select(
        "id", "n", "key", F.coalesce("component", "id").alias("component"), "root")


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text",
                      id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents whose group has a smaller id, and without repeats of the one that stays.

    Documents without words and rows without an id all stay. Only the ids to
    go are joined with the table: broadcast up to ``BROADCAST_IDS``, beyond
    that by a shuffle. Rows that share an id but not the text are told apart by their shingle set: one row
    of each group stays.
    """
    groups = stored(grouped(docs, words, percent, BANDS, BAND_SIZE, text, id_col), "groups")
    repeated = groups.filter("id is not null").groupBy(F.col("id").alias("again__")).count()
    repeated = stored(repeated.filter("count > 1").select("again__"), "repeated")
    gone = groups.filter("id <> component").select(F.col("id").alias("gone__")).distinct()
    own = F.col(id_col).cast("long")
    if repeated.isEmpty():
        return docs.join(_bounded(gone), own == F.col("gone__"), "left_anti")
    gone = gone.join(repeated, F.col("gone__") == F.col("again__"), "left_anti")
    once = docs.join(_bounded(gone), own == F.col("gone__"), "left_anti").join(
        repeated, own == F.col("again__"), "left_anti")
    # of a group's rows with repeated ids the one with the smallest id and set stays, if its id is the group's
    first = groups.filter("n > 0").groupBy("root").agg(F.min(F.struct("id", "key")).alias("x")).select(
        F.col("x.id").alias("first__"), F.col("x.key").alias("set__"))
    keys = F.pandas_udf(lambda texts: texts.map(lambda t: set_key(shingle_set(bytes(t or b""), words))), "binary")
    several = docs.join(repeated, own == F.col("again__"), "left_semi").withColumn(
        "key__", keys(F.col(text).cast("binary")))
    stays = several.filter("key__ is not null").join(
        first, (own == F.col("first__")) & (F.col("key__") == F.col("set__")), "left_semi").dropDuplicates(
        [id_col, "key__"])
    return once.unionByName(stays.unionByName(several.filter("key__ is null")).drop("key__"))


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def whole_units(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The units of a stream sorted by the columns ``by``, one table each; a unit's size is bounded."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = np.stack([t.column(c).to_numpy() for c in by], 1).astype(np.int64)
        at = 0
        for end in np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1:
            yield t.slice(at, end - at)
            at = end
        rest = t.slice(at).combine_chunks()
    if rest is not None and len(rest):
        yield rest
