"""Operator 13, hard-negative mining by threshold joins over an inverted index with norm bounds.

For each anchor: its best rows of the same label (positives), then for each
positive the best rows of other labels whose score lies within a share of the
positive's score. Scores are exact integer inner products.

Method (after L2AP): the components of a block of rows are filed by dimension,
the dimensions with most energy first. For a threshold ``t`` a row's last
dimensions are left out of the index while the norm of what is left out,
times the largest anchor norm, stays below ``t``: a pair that reaches ``t``
cannot lie there alone. Anchors accumulate partial scores dimension group by
dimension group; a pair is dropped once its partial score plus the product of
both remaining norms falls short of ``t``; what remains is verified on whole
vectors. Thresholds start high and are lowered, for the anchors whose
windows are not filled yet, until they are filled or the window's floor is
reached.

Scale: rows and anchors are spread by hash into blocks (``ROWS``, ``ANCHORS``); a task
joins one block of each, so neither labels nor groups of copies decide its
size. Row blocks are sent once per anchor block and anchors once per row block;
no pairs leave a task but the best few of each anchor, and these are ranked
by a window with a group limit below its shuffle. Exact repeats of a row are
dropped first, map-side combined.

* null id, label or vector, null or non-finite component (also after scaling): the row takes no part;
* vectors of different length: the shorter one counts as filled up with zeros (so an empty one scores 0);
* very large components: exact Python integers instead of doubles; scores are clipped to 64 bits;
* ties in score go to the smaller id; a window under a negative positive score is empty;
* rows that repeat id, label and vector count once; rows that share only an id are rows of their own,
  and an anchor's partners never carry its own id;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import stored

SCALE = 256
# Rows and anchors of a unit at most, and components of either.
ROWS, ANCHORS, COMPONENTS = 8192, 16384, 1 << 23
# Anchors that accumulate at once, dimensions added between two prunings, components verified at once.
AT_ONCE, GROUP, VERIFIED = 64, 16, 1 << 22
# Shares of the largest possible score tried for positives, of the smallest positive score for negatives.
POSITIVE_STEPS = (0.8, 0.5, 0.3, 0.15, 0.0)
NEGATIVE_STEPS = (0.8, 0.6, 0.45)
# Below this, sums of products (and a hundred of them) are exact in doubles.
EXACT = 2.0**46
LOW, HIGH = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- vectors as bytes

def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec``: floor(SCALE * x) of every component, packed; rows that take no part are left out.

    The first byte names the width: 2 or 8 bytes an integer, ``f`` for whole doubles beyond.
    """
    for b in batches:
        v = b.column("v")
        flat, start = pc.list_flatten(v), pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):  # null components come out as NaN
            x = np.floor(SCALE * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        ends = np.cumsum(start)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        ok = (bad[ends] == bad[ends - start]) & pc.is_valid(v).to_numpy(zero_copy_only=False)
        for c in ("id", "label"):
            ok &= pc.is_valid(b.column(c)).to_numpy(zero_copy_only=False)
        packed = []
        for lo, hi in zip((ends - start)[ok], ends[ok]):
            part = x[lo:hi]
            most = np.abs(part).max(initial=0.0)
            packed.append(b"\2" + part.astype(np.int16).tobytes() if most < 32768 else
                          b"\10" + part.astype(np.int64).tobytes() if most < 2.0**62 else b"f" + part.tobytes())
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("label").filter(keep),
                                          pa.array(packed, pa.binary())], names=["id", "label", "vec"])


def matrix(vecs: list[bytes]) -> np.ndarray:
    """Unpacked rows, filled up with zeros: doubles, or Python integers where a double may not hold the value."""
    kinds = {2: np.int16, 8: np.int64, 102: np.float64}
    rows = [np.frombuffer(v, kinds[v[0]], offset=1) for v in vecs]
    dim = max((len(r) for r in rows), default=0)
    plain = all(v[0] == 2 or v[0] == 8 and np.abs(r).max(initial=0) < 2**53 for v, r in zip(vecs, rows))
    out = np.zeros((len(rows), dim), np.float64 if plain else object)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r if plain else [int(c) for c in r]
    return out


def same_width(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(x.shape[1], q.shape[1])
    wide = lambda m: np.hstack([m, np.zeros((len(m), dim - m.shape[1]), m.dtype)]) if m.shape[1] < dim else m
    return wide(x), wide(q)


def exact_in_doubles(x: np.ndarray, q: np.ndarray) -> bool:
    if x.dtype == object or q.dtype == object:
        return False
    return x.shape[1] * np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) < EXACT


# ---------------------------------------------------------------- the index

class NormIndex:
    """Rows of ``x`` by dimension, for pairs of score ``least`` and more with anchors of norm ``longest`` at most.

    ``x`` and the anchors come with their dimensions in one common order.
    Rows are sorted by how many dimension groups they are filed under, so a group's postings are the first
    ``postings[g]`` rows.
    """

    def __init__(self, x: np.ndarray, longest: float, least: float):
        self.edges = [*range(0, x.shape[1], GROUP), x.shape[1]]
        rest = suffix_norms(x, self.edges)
        filed = (rest[:, :-1] * longest * (1 + 1e-9) >= least).sum(1)
        self.order = np.argsort(-filed, kind="stable")
        self.x, self.rest, self.filed = x[self.order], rest[self.order], filed[self.order]
        self.postings = [int((filed > g).sum()) for g in range(len(self.edges) - 1)]

    def pairs(self, q: np.ndarray, rest: np.ndarray, least: np.ndarray,
              allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of every allowed pair that reaches its anchor's threshold.

        ``rest`` has the anchors' norms from each group on; ``allowed`` is (anchors, rows as given).
        """
        allowed = allowed[:, self.order]
        partial = np.zeros(allowed.shape)
        alive = allowed
        for g, n in enumerate(self.postings):
            if not n:
                break
            lo, hi = self.edges[g], self.edges[g + 1]
            partial[:, :n] += q[:, lo:hi] @ self.x[:n, lo:hi].T
            # what a row has after this group, or after the groups it is filed under
            after = self.rest[np.arange(len(self.x)), np.minimum(self.filed, g + 1)]
            norm = rest[:, np.minimum(self.filed, g + 1)] if g + 1 > self.filed.min(initial=g + 1) else rest[:, [g + 1]]
            alive = allowed & (partial + norm * after * (1 + 1e-9) + 1e-6 >= least[:, None])
            if alive.mean() < 0.1:
                break
        if not any(self.postings):  # nothing can reach a threshold but by what was left out: nothing at all
            alive = allowed & (rest[:, [0]] * self.rest[:, 0] * (1 + 1e-9) + 1e-6 >= least[:, None])
        a, r = np.nonzero(alive)
        score = np.empty(len(a))
        size = VERIFIED // max(q.shape[1], 1)
        for k in range(0, len(a), size):
            part = slice(k, k + size)
            score[part] = np.einsum("ij,ij->i", q[a[part]], self.x[r[part]])
        reached = score >= least[a]
        return a[reached], self.order[r[reached]], score[reached]


def suffix_norms(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of each row's dimensions from every edge on; the last column is 0."""
    squares = np.add.reduceat(x * x, edges[:-1], axis=1) if x.shape[1] else np.zeros((len(x), 1))
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([rest, np.zeros((len(x), 1))]))


class Block:
    """One block of rows joined with one block of anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        x, q = same_width(matrix(rows.column("vec").to_pylist()), matrix(anchors.column("vec").to_pylist()))
        self.ids, self.own = rows.column("id").to_numpy(), anchors.column("id").to_numpy()
        names = pc.dictionary_encode(pa.chunked_array(
            [*rows.column("label").chunks, *anchors.column("label").chunks])).combine_chunks().indices.to_numpy()
        self.labels, self.own_label = names[:len(x)], names[len(x):]
        self.doubles = exact_in_doubles(x, q)
        if self.doubles:
            energy = np.argsort(-(x * x).sum(0), kind="stable")
            x, q = np.ascontiguousarray(x[:, energy]), np.ascontiguousarray(q[:, energy])
            edges = [*range(0, x.shape[1], GROUP), x.shape[1]]
            self.rest = suffix_norms(q, edges)
            self.longest = float(self.rest[:, 0].max(initial=0.0))
            self.most = float(suffix_norms(x, edges)[:, 0].max(initial=0.0))  # the largest row norm
        self.x, self.q = x, q

    def allowed(self, who: np.ndarray, same: bool) -> np.ndarray:
        out = (self.own_label[who][:, None] == self.labels[None]) == same
        return out & (self.own[who][:, None] != self.ids[None])

    def search(self, who: np.ndarray, least: list[np.ndarray], same: bool,
               filled: Callable[[int, np.ndarray, np.ndarray, bool], list | None]) -> Iterator[tuple[int, list]]:
        """What ``filled(anchor, ids, scores, last)`` makes of each anchor's rows, lowering thresholds while it says None.

        ``least[step]`` has a threshold per anchor of ``who``; at the last one ``filled`` has to answer. Rows come
        by score and id.
        """
        if not self.doubles:
            for a in who:
                ok = np.flatnonzero(self.allowed(np.array([a]), same)[0])
                score = np.array([min(max(int(s), LOW), HIGH) for s in self._whole(a, ok)], object)
                order = sorted(range(len(ok)), key=lambda k: (-score[k], self.ids[ok[k]]))
                yield a, filled(a, self.ids[ok[order]], score[order], True)
            return
        todo = np.arange(len(who))
        for step, bound in enumerate(least):
            last, left = step == len(least) - 1, []
            index = NormIndex(self.x, self.longest, float(bound[todo].min())) if len(todo) else None
            for k in range(0, len(todo), AT_ONCE):
                part = todo[k:k + AT_ONCE]
                a, r, score = index.pairs(self.q[who[part]], self.rest[who[part]], bound[part],
                                          self.allowed(who[part], same))
                order = np.lexsort((self.ids[r], -score, a))
                a, r, score = a[order], r[order], score[order].astype(np.int64)
                cuts = np.searchsorted(a, np.arange(len(part) + 1))
                for i, lo, hi in zip(part, cuts, cuts[1:]):
                    made = filled(who[i], self.ids[r[lo:hi]], score[lo:hi], last)
                    if made is None:
                        left.append(i)
                    else:
                        yield who[i], made
            todo = np.array(left, np.int64)

    def _whole(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Scores in Python integers."""
        x, q = (m if m.dtype == object else m.astype(np.int64).astype(object) for m in (self.x[rows], self.q[a]))
        return x @ q if len(q) else np.zeros(len(rows), object)

    def best(self, count: int) -> Iterator[tuple[int, list]]:
        """Per anchor the ``count`` best rows of its label: ``[(ids, scores)]``."""
        def filled(a, ids, score, last):
            return [(ids[:count], score[:count])] if last or len(ids) >= count else None
        who = np.arange(len(self.q))
        if not self.doubles:
            return self.search(who, [], True, filled)
        top = self.rest[:, 0] * self.most
        lowest = -top * (1 + 1e-9) - 1.0  # nothing scores less
        return self.search(who, [top * s for s in POSITIVE_STEPS] + [lowest], True, filled)

    def within(self, scores: list[list[int]], low: int, high: int, count: int) -> Iterator[tuple[int, list]]:
        """Per anchor and positive score the ``count`` best rows of other labels from ``low`` to ``high`` per cent of it."""
        def filled(a, ids, score, last):
            out = []
            for p in scores[a]:
                if isinstance(score, np.ndarray) and score.dtype == object:
                    pick = [k for k, s in enumerate(score) if low * p <= 100 * s <= high * p][:count]
                else:
                    at = int(np.searchsorted(-100 * score, -high * p))
                    pick = np.arange(at, min(at + count, len(score)))
                    pick = pick[100 * score[pick] >= low * p]
                if not last and p >= 0 and len(pick) < count:
                    return None
                out.append((ids[pick], score[pick]))
            return out
        who = np.array([a for a, s in enumerate(scores) if s and max(s) >= 0], np.int64)
        if not self.doubles:
            return self.search(who, [], False, filled)
        floor = np.array([min(p for p in scores[a] if p >= 0) for a in who], np.float64)
        steps = [floor * s for s in NEGATIVE_STEPS if 100 * s > low]
        return self.search(who, [*steps, np.floor(floor * low / 100) - 1.0], False, filled)


# ---------------------------------------------------------------- Spark side

def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole units ``(i, j)`` of rows that arrive in that order."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if held and key != (i[lo], j[lo]):
                yield pa.Table.from_batches(held)
                held = []
            key = (i[lo], j[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _joined(found: Callable[[Block, pa.Table], Iterator[tuple[int, list]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in blocks(batches):
            anchor = pc.is_valid(unit.column("anchor"))
            rows, anchors = unit.filter(pc.invert(anchor)), unit.filter(anchor)
            if not rows.num_rows or not anchors.num_rows:
                continue
            keys = anchors.column("anchor").to_pylist()
            out = [(keys[a], k, ids, s) for a, made in found(Block(rows, anchors), anchors)
                   for k, (ids, s) in enumerate(made) if len(ids)]
            for k in range(0, len(out), 4096):
                part = out[k:k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in part], pa.binary()), pa.array([o[1] for o in part], pa.int32()),
                     pa.array([o[2] for o in part], pa.list_(pa.int64())),
                     pa.array([[int(s) for s in o[3]] for o in part], pa.list_(pa.int64()))],
                    names=["anchor", "window", "ids", "scores"])
    return run


def _units(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Rows and anchors dealt to units: block ``i`` of rows with block ``j`` of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    columns = ["i", "j", "id", "label", "vec", "anchor", "scores"]
    a = rows.select("id", "label", "vec", F.lit(None).cast("binary").alias("anchor"),
                    F.lit(None).cast("array<long>").alias("scores"),
                    dealt(F.xxhash64("id", "vec"), row_blocks).alias("i"), every(anchor_blocks).alias("j"))
    b = anchors.select("id", "label", "vec", "anchor", "scores",
                       dealt(F.xxhash64("anchor"), anchor_blocks).alias("j"), every(row_blocks).alias("i"))
    both = a.select(*columns).unionByName(b.select(*columns))
    return both.repartition("i", "j").sortWithinPartitions("i", "j")


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` best of what the blocks found, per anchor and window, with their rank."""
    each = found.select("anchor", "window", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "anchor", "window", F.col("x.ids").alias("found_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("found_id"))
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, id_col: str = "vec_id", label: Column | str = "label",
                   vector: str = "embedding") -> DataFrame:
    """Negatives of every (anchor, positive): ids, rank from 1, and both scores.

    ``is_anchor`` and ``label`` are expressions over the columns of ``vectors``; a negative scores from
    ``low`` to ``high`` per cent of the positive.
    """
    label = F.col(label) if isinstance(label, str) else label
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                            F.col(vector).cast("array<double>").alias("v"), is_anchor.alias("wanted"))
    packed = usable.select("id", "label", "v").mapInArrow(scaled, "id long, label string, vec binary")
    wanted = usable.filter("wanted").select("id").distinct()
    rows = stored(packed.dropDuplicates(), "negatives-rows")
    anchors = rows.join(wanted, "id", "left_semi").withColumn(
        "anchor", F.unhex(F.md5(F.concat_ws("/", F.col("id"), F.hex("vec"), "label"))))
    anchors = stored(anchors.withColumn("scores", F.lit(None).cast("array<long>")), "negatives-anchors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    most = max(1, COMPONENTS // max(size["bytes"] or 1, 1))
    blocks_of = lambda n, limit: max(1, -(-n // min(limit, most)))
    row_blocks, anchor_blocks = blocks_of(size["n"], ROWS), blocks_of(anchors.count(), ANCHORS)
    schema = "anchor binary, window int, ids array<long>, scores array<long>"

    units = _units(rows, anchors, row_blocks, anchor_blocks)
    near = _ranked(units.mapInArrow(_joined(lambda block, _: block.best(positives)), schema), positives)
    near = stored(near.select("anchor", "found_id", "score", "rank"), "negatives-positives")
    # at most `positives` rows of an anchor, in rank order
    own = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("best"))
    asked = anchors.drop("scores").join(own, "anchor").select(
        "id", "label", "vec", "anchor", F.col("best.score").alias("scores"))
    units = _units(rows, asked, row_blocks, anchor_blocks)
    far = units.mapInArrow(_joined(lambda block, t: block.within(
        t.column("scores").to_pylist(), low, high, negatives)), schema)
    far = _ranked(far, negatives)
    named = near.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", (F.col("rank") - 1).alias("window"), "anchor_id", F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    return far.join(named, ["anchor", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
