"""Operator 9, language-model scores: a hierarchical Pitman-Yor model of words.

Tokens are the words of a text (A-Z lower-cased) and one end token. The root
of the hierarchy is the uniform distribution over the training vocabulary and
one unknown word; its child is the unigram restaurant; below it stand the
context restaurants, which all share that parent: one for every previous word
and one for the start of a text. A customer of a context restaurant that opens
a table sends a customer to the unigram restaurant.

Seating is sampled by blocked Gibbs: in a sweep all customers of one dish in
one restaurant get up, with their tables, and are seated again one after
another by the Chinese-restaurant weights, given everyone else (in growing
groups once many sit). Random numbers are hashes of dish, sweep and step, so a rerun task or
another partitioning seats alike. A dish with one customer always has one table, so only
pairs (word, context) seen more often are sampled, and of the words only those
that have more than one customer or are such a pair's context. Counts are keyed by pair;
the tables per context and the customers per word are summed up after a sweep,
stored, and joined back, so that the join can split a frequent word. The
predictive probabilities of the kept sweeps are averaged.

Counting: a chunk (one input split) sends its distinct pairs and words once, as
packed columns dealt to hash buckets; a frequent word's pairs are spread over
``SALTS`` keys. A bucket adds up the counts and stores the repeated pairs,
the words, and by chunk which of them it asked for, as places in the bucket's lists.

Scoring: after the sweeps a bucket answers the chunks' lists, in their order
and without names. The probability of a pair is its own share plus what the
context leaves to the parent times the word's unigram probability, so pairs and
words are answered apart. The chunk is read again, and its pairs, sorted as
before, say which answer is whose: its texts go out as places in its list of
pairs and meet the answers in one shuffle, sorted so that answers come first.
No count, vocabulary or model table passes the driver or is broadcast.

* null or empty text: the end token only;
* very long texts are scored whole; repeated rows score alike;
* null ids are held out; without training text every token has probability 1;
* an empty table gives no rows; other columns, whatever their names, are not read;
* words are told apart by 64-bit hashes, pairs by those of both words.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import by_size, dropped, stored
from tickframe.llm.shingles import scramble

CONTEXTS = 17  # restaurants of the small models that tests add up; the operator has one for every previous word
START = 0x51A27B3D09  # the context of a text's first word, among the word hashes
BURN_IN, KEPT = 1, 3
STRENGTH = 1.0
END = 0x1E5D0F7E47  # the end token's number among the word hashes
SEED = 97
TRIALS = 4096  # of a dish at once, drawn one by one
PAIR, WORD, NAMES, TEXT = range(4)  # kinds of answers; after them the words of a chunk's pairs, and its texts
REPEATED, LEXICON, ASKED = range(3)  # kinds of a bucket's stored rows: its pairs or its words, then what chunks asked
BUCKETS, BUCKETS_A_CHUNK, SALTS = 4096, 16, 8
AT_ONCE = 1 << 22  # tokens of a chunk that are sorted together before their pairs are merged with earlier ones
PACKED = 1 << 19  # tokens of texts that are packed together
SEATED = 1 << 17  # dishes that are seated together
HASHED = 1 << 20  # bytes of texts that are hashed together


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint64) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint64)
_PLACES = 64  # places of a word whose random numbers are kept
_NUMBERS = scramble((np.arange(_PLACES, dtype=np.uint64)[:, None] << np.uint64(8)) | _LOWER)
_NUMBERS[:, _SPACE] = 0  # the spaces after a word add nothing
_NUMBERS = _NUMBERS.ravel()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, end to end and each text closed by ``END``; contexts; tokens per text.

    A word's hash adds up one random number per (place, lower-cased byte), for
    all words of the batch at once.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    cut = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0]:cut[-1]]
    cut = cut - cut[0]
    space = _SPACE[data]
    first = np.ones(len(data) + 1, bool)  # bytes after a space or at the start of a text
    first[1:-1] = space[:-1]
    first[cut] = True
    start = np.flatnonzero(first[:-1] & ~space)
    words = np.empty(0, np.uint64)
    if len(start):
        long = np.diff(np.r_[start, len(data)])  # with the spaces behind
        at = np.arange(start[0] << 8, len(data) << 8, 256)  # place in the word and byte
        at -= np.repeat(start << 8, long)
        at += data[start[0]:]
        x = _NUMBERS.take(at, mode="clip")
        if long.max() > _PLACES:
            far = np.flatnonzero(at >= len(_NUMBERS))
            byte = at[far] & 255
            x[far] = np.where(_SPACE[byte], np.uint64(0), scramble((at[far] - byte).view(np.uint64) | _LOWER[byte]))
        words = scramble(np.add.reduceat(x, start - start[0]))
    sizes = np.diff(np.searchsorted(start, cut)) + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = words.astype(np.int64)
    return out, contexts(out, sizes), sizes


def contexts(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, ``START`` for a text's first."""
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = START
    return context


def squeezed(x: np.ndarray, kind="<i8") -> bytes:
    """Small numbers in few bytes: compressed, all lowest bytes first."""
    x = np.ascontiguousarray(x, kind)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True) if planes else b""


def unsqueezed(data: bytes, kind="<i8") -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    planes = pa.decompress(pa.py_buffer(data)[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of the columns change."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def pair_buckets(word: np.ndarray, context: np.ndarray, buckets: int) -> np.ndarray:
    salted = word.view(np.uint64) + (context.view(np.uint64) & np.uint64(SALTS - 1))
    return scramble(salted) % np.uint64(buckets)


def word_buckets(word: np.ndarray, buckets: int) -> np.ndarray:
    return scramble(word.view(np.uint64)) % np.uint64(buckets)


def _order(key: np.ndarray) -> np.ndarray:
    """Sorts 64-bit keys as ``argsort`` does. Numbers alone sort faster than places do: twice, by the key's lower 24 bits,
    then by the others, each with the place behind it."""
    if len(key) > 1 << 24:
        return np.argsort(key)
    low, bits = np.uint64((1 << 24) - 1), np.uint64(24)
    places = np.arange(len(key), dtype=np.uint64)
    order = (np.sort((key & low) << bits | places) & low).view(np.int64)
    return order[(np.sort(key[order] & ~low | places) & low).view(np.int64)]


def pair_order(word: np.ndarray, context: np.ndarray, buckets: int) -> np.ndarray:
    """Sorts pairs by bucket, in it by word and context; equal pairs come together, and any rows are sorted alike.

    The key holds parts of the hashes; different pairs of one key are sorted by the whole hashes.
    """
    key = (pair_buckets(word, context, buckets) << np.uint64(52)) | (
        word.view(np.uint64) >> np.uint64(36) << np.uint64(24)) | (context.view(np.uint64) >> np.uint64(40))
    order = _order(key)
    key = key[order]
    tied = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[tied], order[tied + 1]
    mixed = tied[(word[a] != word[b]) | (context[a] != context[b])]
    if len(mixed):
        keys = np.unique(key[mixed])
        lo, hi = np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")
        at = np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)
        own = order[at]
        order[at] = own[np.lexsort((context[own], word[own], key[at]))]
    return order


def _pairs(word: np.ndarray, context: np.ndarray, n: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The different pairs in ``pair_order`` with summed ``n``."""
    order = pair_order(word, context, buckets)
    word, context, n = word[order], context[order], n[order]
    first = _runs(word, context)
    return word[first], context[first], np.add.reduceat(n, first) if len(n) else n


def _lexicon(word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of pairs and ``START``, by bucket and hash; by pair the place of its word, and that of ``START``.

    Other contexts are words too: each is the word of the pair before.
    """
    first = _runs(word)  # the pairs lie by word inside their buckets
    h, place = np.unique(np.r_[word[first], START], return_inverse=True)
    order = np.argsort(word_buckets(h, buckets), kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    place = rank[place]
    return h[order], np.repeat(place[:-1], np.diff(np.r_[first, len(word)])), int(place[-1])


def _by_chunk(b: pa.RecordBatch, *columns: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """A batch's chunks: the chunk, its rows and its tokens' columns."""
    chunk = b.column("chunk").to_numpy()
    names = np.unique(chunk)
    for c in names.tolist():
        rows = slice(None) if len(names) == 1 else chunk == c
        own = rows if len(names) == 1 else np.repeat(rows, sizes)
        yield c, rows, [x[own] for x in columns]


REQUESTS = "bucket int, chunk long, w binary, ctx binary, n binary"


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """A chunk's rows by bucket: its pairs with their numbers in training texts; in the buckets from ``buckets`` on, its
    words with their numbers as words and as contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by chunk its merged pairs, then tokens still to be merged

        def merged(parts: list) -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            return _pairs(*columns, buckets)

        for b in by_size(batches, "t", HASHED):
            word, context, sizes = tokens(b.column("t"))
            n = np.repeat(b.column("train").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            for c, _, columns in _by_chunk(b, word, context, n, sizes=sizes):
                parts = held.setdefault(c, [])
                parts.append(columns)
                if sum(len(x[0]) for x in parts[1:]) > max(AT_ONCE, len(parts[0][0])):
                    parts[:] = [merged(parts)]
        for c in list(held):
            w, ctx, n = merged(held.pop(c))
            yield from rows(c, pair_buckets(w, ctx, buckets), w, ctx, n, np.ndarray.tobytes)
            h, place, start = _lexicon(w, buckets)
            n = np.bincount(place, n, len(h)).astype(np.int64)
            m = np.where(h == END, 0, n)  # a word is the context of what follows it; as many texts start as end
            m[start] = n[h == END].sum()
            yield from rows(c, word_buckets(h, buckets) + np.uint64(buckets), h, m, n, squeezed)

    def rows(chunk: int, bucket: np.ndarray, w: np.ndarray, ctx: np.ndarray, n: np.ndarray,
             of_ctx: Callable) -> Iterator[pa.RecordBatch]:
        first = _runs(bucket)
        ends = np.r_[first[1:], len(bucket)]
        for k in range(0, len(first), 64):
            lo = first[k:k + 64]
            cut = list(zip(lo.tolist(), ends[k:k + 64].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[lo].astype(np.int32)), pa.array(np.full(len(lo), chunk, np.int64)),
                 *(pa.array([of(x[i:j]) for i, j in cut], pa.binary())
                   for x, of in ((w, np.ndarray.tobytes), (ctx, of_ctx), (n, squeezed)))],
                names=["bucket", "chunk", "w", "ctx", "n"])

    return docs.select("chunk", "train", "t").mapInArrow(run, REQUESTS)


COUNTED = "bucket int, kind int, chunk long, a binary, b binary, c binary, x long, y long"


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one bucket after another; they come sorted by bucket."""
    held, bucket = [], None
    for b in batches:
        own = b.column("bucket").to_numpy()
        first = _runs(own)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
            if held and own[lo] != bucket:
                yield bucket, pa.Table.from_batches(held)
                held = []
            bucket = int(own[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield bucket, pa.Table.from_batches(held)


def _hashes(rows: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), "<i8")


def _counts(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.empty(0, "<i8"), *map(unsqueezed, rows.column(name).to_pylist())])


def counted(asked: DataFrame, buckets: int) -> DataFrame:
    """A bucket's rows: ``REPEATED``: the pairs counted more than once (``a, b, c``: word, context, count; ``x``: how
    many have count 2, ``y``: all their counts), ``LEXICON``: its words (hash, numbers as word and as context; ``x``: how
    many are counted as words, ``y``: their counts), and by chunk ``ASKED``: places in these lists (``a``); for every
    pair it holds whether it is counted never, once or more often (``b``: 0, 1, 2), places only for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            w, n = _hashes(rows, "w"), _counts(rows, "n")
            chunks = rows.column("chunk").to_pylist()
            cut = np.cumsum([len(x) // 8 for x in rows.column("w").to_pylist()])
            out = []
            if bucket < buckets:
                ctx = _hashes(rows, "ctx")
                order = pair_order(w, ctx, buckets)
                first = _runs(w[order], ctx[order])
                c = np.add.reduceat(n[order], first)
                repeated = c > 1
                group = np.empty(len(w), np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
                place, often = (np.cumsum(repeated) - 1)[group], np.minimum(c, 2)[group]
                first = order[first[repeated]]
                c = c[repeated]
                out.append((REPEATED, None, w[first].tobytes(), ctx[first].tobytes(), squeezed(c),
                            int((c == 2).sum()), int(c.sum())))
                for chunk, lo, hi in zip(chunks, [0, *cut[:-1]], cut):
                    own = place[lo:hi][often[lo:hi] == 2]
                    out.append((ASKED, chunk, squeezed(np.diff(own, prepend=0)), squeezed(often[lo:hi], "u1"), b"", 0, 0))
            else:
                h, place = np.unique(w, return_inverse=True)
                n, m = (np.bincount(place, x, len(h)).astype(np.int64) for x in (n, _counts(rows, "ctx")))
                out.append((LEXICON, None, h.tobytes(), squeezed(n), squeezed(m),
                            int((n > 0).sum()), int(n.sum())))
                for chunk, lo, hi in zip(chunks, [0, *cut[:-1]], cut):
                    out.append((ASKED, chunk, squeezed(np.diff(place[lo:hi], prepend=0)), b"", b"", 0, 0))
            kind, chunk, a, b, c, x, y = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(out), bucket, np.int32)), pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()),
                 *(pa.array(v, pa.binary()) for v in (a, b, c)), pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                names=["bucket", "kind", "chunk", "a", "b", "c", "x", "y"])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, COUNTED)


def rows_of(lists: DataFrame, kind: int, *names: str, least: int = 0) -> DataFrame:
    """``(bucket, *names)``: the stored lists of a kind as rows; those whose last two numbers are less than ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                a, m = np.frombuffer(row["a"], "<i8"), unsqueezed(row["c"])
                n = np.frombuffer(row["b"], "<i8") if kind == REPEATED else unsqueezed(row["b"])
                some = np.flatnonzero((n >= least) | (m >= least)) if least else np.arange(len(a))
                for lo in range(0, len(some), 50_000):
                    at = some[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), row["bucket"], np.int32)), *(pa.array(v[at]) for v in (a, n, m))],
                        names=["bucket", *names])

    return lists.filter(F.col("kind") == kind).select("bucket", "a", "b", "c").mapInArrow(
        run, "bucket int, " + ", ".join(f"{c} long" for c in names))


@dataclass
class Totals:
    """What restaurants share: customers and tables of the contexts at hand, of the unigram restaurant, and discounts."""

    customers: np.ndarray
    tables: np.ndarray
    customers1: int
    tables1: int
    words: int
    discount: float
    discount1: float

    @property
    def floor(self) -> float:
        return 1.0 / (self.words + 1)

    def unigram(self, c1: np.ndarray, t1: np.ndarray) -> np.ndarray:
        if not self.customers1:
            return np.ones(len(c1))
        new = (STRENGTH + self.discount1 * self.tables1) * self.floor
        return (c1 - self.discount1 * t1 + new) / (self.customers1 + STRENGTH)

    def in_context(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        new = (STRENGTH + self.discount * self.tables[ctx]) * parent
        return (c - self.discount * t + new) / (self.customers[ctx] + STRENGTH)


NONE = np.zeros(0)


def discount_of(once: int | None, twice: int | None) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def totals(words: DataFrame, discount: float, vocabulary: int) -> Totals:
    """Of the ``words`` at hand and the rest of the vocabulary, words with one customer."""
    c1, t1, n, once, twice = words.agg(
        F.sum("c1"), F.sum("t1"), F.sum((F.col("c1") > 0).cast("long")), F.sum((F.col("c1") == 1).cast("long")),
        F.sum((F.col("c1") == 2).cast("long"))).first()
    rest = vocabulary - (n or 0)
    return Totals(NONE, NONE, (c1 or 0) + rest, (t1 or 0) + rest, vocabulary, discount,
                  discount_of((once or 0) + rest, twice or 0))


class Draws:
    """Random numbers that depend on a dish and the sweep only, not on the task or place where it is seated."""

    def __init__(self, sweep: int, *names: np.ndarray):
        key = np.full(len(names[0]), SEED, np.uint64) + _spread(sweep)
        for name in names:
            key = scramble(scramble(key) + np.ascontiguousarray(name).astype(np.int64).view(np.uint64))
        self.key = key

    def binomial(self, at: np.ndarray, step: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Successes among ``n`` trials of the dishes ``at``: counted up to ``TRIALS``, else by the normal limit."""
        key = scramble(self.key[at] + _spread(step))
        out = np.zeros(len(at), np.int64)
        many = n > TRIALS
        if many.any():
            a, b = (_uniform(scramble(key[many] + np.uint64(k))) for k in (1, 2))
            z = np.sqrt(-2 * np.log(1 - a)) * np.cos(2 * np.pi * b)
            mean = n[many] * p[many]
            out[many] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[many]))), 0, n[many])
        few = np.flatnonzero(~many)
        for lo in range(0, len(few), 1 << 20):
            rows = few[lo:lo + (1 << 20)]
            once = rows[n[rows] == 1]
            out[once] = _uniform(key[once]) < p[once]
            for k in range(0, len(more := rows[n[rows] > 1]), 4096):
                own = more[k:k + 4096]
                first = np.cumsum(n[own]) - n[own]
                trial = np.arange(n[own].sum()) - np.repeat(first, n[own])
                hit = _uniform(scramble(np.repeat(key[own], n[own]) + trial.astype(np.uint64))) < np.repeat(p[own], n[own])
                out[own] = np.add.reduceat(hit.astype(np.int64), first)
        return out


def _spread(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits >> np.uint64(11)) * 2.0**-53


def seat(c: np.ndarray, weight: np.ndarray | Callable, discount: float, draws: Draws) -> np.ndarray:
    """Tables after ``c`` customers of a dish sat down in turn; ``weight``: that of a new table, or a function of
    the dishes and their tables so far."""
    t, n = np.minimum(c, 1), np.minimum(c, 1)
    todo, step = np.flatnonzero(c > 1), 0
    while len(todo):
        group = np.minimum(np.maximum(n[todo] // 16, 1), c[todo] - n[todo])
        new = weight(todo, t[todo]) if callable(weight) else weight[todo]
        new = new / (new + n[todo] - discount * t[todo])
        step += 1
        t[todo] += draws.binomial(todo, step, group, new)
        n[todo] += group
        todo = todo[n[todo] < c[todo]]
    return t


def seat_pairs(c: np.ndarray, t: np.ndarray, tables: np.ndarray, c1: np.ndarray, t1: np.ndarray, shared: Totals,
               draws: Draws) -> np.ndarray:
    """New tables of pairs with ``t`` tables of their context's ``tables``, whose words have ``c1`` customers and
    ``t1`` tables in the unigram restaurant: a pair's own seats are removed first."""
    others, others1 = tables - t, c1 - t
    rest1 = np.minimum(t1, others1)  # the unigram restaurant has no more tables than customers

    def weight(at: np.ndarray, own: np.ndarray) -> np.ndarray:
        root = (STRENGTH + shared.discount1 * (shared.tables1 - t1[at] + rest1[at])) * shared.floor
        parent = (others1[at] + own - shared.discount1 * np.maximum(rest1[at], 1) + root) / (
            shared.customers1 - t[at] + own + STRENGTH)
        return (STRENGTH + shared.discount * (others[at] + own)) * parent

    return seat(c, weight, shared.discount, draws)


def _numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False) for n in names]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SEATED``: a frequent dish takes many steps, which a batch takes together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SEATED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


PAIRS = "bucket int, w long, ctx long, c long, t long, sum long"


def sweep(pairs: DataFrame, words: DataFrame, shared: Totals, number: int, keep: bool) -> DataFrame:
    """The pairs seated anew; ``sum``: their tables in the kept sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches):
            c, t, total, tables, c1, t1 = _numbers(b, "c", "t", "sum", "tables", "c1", "t1")
            t = seat_pairs(c, t, tables, c1, t1, shared, Draws(2 * number, *_numbers(b, "w", "ctx")))
            yield pa.RecordBatch.from_arrays(
                [b.column("bucket"), b.column("w"), b.column("ctx"), b.column("c"), pa.array(t),
                 pa.array(total + t if keep else total)], names=["bucket", "w", "ctx", "c", "t", "sum"])

    small = lambda *c: words.select(*c).hint("shuffle_hash")  # noqa: E731  # a word's row stands once
    met = pairs.join(small(F.col("w").alias("ctx"), "tables"), "ctx").join(small("w", "c1", "t1"), "w")
    return met.select("bucket", "w", "ctx", "c", "t", "sum", "tables", "c1", "t1").mapInArrow(run, PAIRS)


def with_tables(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Words with their customers ``c1`` and, as contexts, ``tables``: those of pairs counted once and of ``pairs``."""
    ends = F.explode(F.array(F.struct(F.col("w").alias("w"), F.col("t").alias("more1"), F.lit(0).cast("long").alias("more")),
                             F.struct(F.col("ctx").alias("w"), F.lit(0).cast("long").alias("more1"), F.col("t").alias("more"))))
    more = pairs.select(ends.alias("e")).groupBy("e.w").agg(F.sum("e.more1").alias("more1"), F.sum("e.more").alias("more"))
    add = lambda c, old: F.coalesce(F.col(c), F.lit(0)) + F.col(old)
    return words.join(more.hint("shuffle_hash"), "w", "left").withColumns(
        {"c1": add("more1", "once1"), "tables": add("more", "once")}).drop("more1", "more")


def seat_words(words: DataFrame, shared: Totals, number: int) -> DataFrame:
    """The customers ``c1`` of the unigram restaurant seated anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches):
            c1, t1 = _numbers(b, "c1", "t1")
            weight = lambda at, own: (STRENGTH + shared.discount1 * (shared.tables1 - t1[at] + own)) * shared.floor  # noqa: B023, E731
            t1 = pa.array(seat(c1, weight, shared.discount1, Draws(2 * number + 1, *_numbers(b, "w"))))
            yield b.set_column(b.schema.get_field_index("t1"), "t1", t1)

    return words.mapInArrow(run, words.schema)


def answers(lists: DataFrame, pairs: DataFrame, words: DataFrame, kept: int, buckets: int) -> DataFrame:
    """``(chunk, kind, bucket, a, b)``, packed in the order of the chunk's list. Of pairs: their customers, and for the
    repeated ones their tables in the kept sweeps; of words: their numbers as a word and as a context, then customers,
    tables, and tables as a context in each."""
    k = kept
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    final = lambda df, ctx, *v: df.select(
        "bucket", F.lit(-1).alias("kind"), empty("chunk", "long"), *[empty(c, "binary") for c in "abc"], "w", ctx,
        F.array(*v).alias("v"))
    rows = lists.filter(F.col("kind") != REPEATED).select(
        "bucket", "kind", "chunk", "a", "b", "c", empty("w", "long"), empty("ctx", "long"), empty("v", "array<long>"))
    rows = rows.unionByName(final(pairs, "ctx", "c", "sum")).unionByName(final(
        words, empty("ctx", "long"), *[f"{c}_{i}" for c in ("c1", "t1", "tables") for i in range(k)]))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            kind = held.column("kind").to_numpy()
            seated, asked = held.filter(pa.array(kind == -1)), held.filter(pa.array(kind == ASKED))
            w, width = seated.column("w").to_numpy(), 2 if bucket < buckets else 3 * k
            v = seated.column("v").combine_chunks()
            v = (v.flatten().to_numpy() if len(w) else np.empty(0, np.int64)).reshape(-1, width).T
            if bucket < buckets:
                v = v[:, pair_order(w, seated.column("ctx").to_numpy().astype(np.int64), buckets)]
            else:
                listed = held.filter(pa.array(kind == LEXICON))
                key, n, m = _hashes(listed, "a"), _counts(listed, "b"), _counts(listed, "c")
                # a word that took no part has one customer at most, and as a context one table
                whole = np.stack([n, m, *[x for x in (n, np.minimum(n, 1), m) for _ in range(k)]])
                whole[2:, np.searchsorted(key, w)] = v
                v = whole
            out = []
            for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
                at = np.cumsum(unsqueezed(a))
                if bucket < buckets:
                    c = unsqueezed(b, "u1").astype(np.int64)
                    c[c == 2] = v[0, at]
                    out.append((squeezed(c), squeezed(v[1, at])))
                else:
                    out.append((squeezed(v[:, at].ravel()), b""))
            if out:
                a, b = zip(*out)
                fill = lambda x: pa.array(np.full(len(out), x, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [asked.column("chunk").combine_chunks(), fill(PAIR if bucket < buckets else WORD), fill(bucket),
                     pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["chunk", "kind", "bucket", "a", "b"])

    return rows.mapInArrow(run, "chunk long, kind int, bucket int, a binary, b binary")


PLACED = "chunk long, kind int, bucket int, a binary, b binary, ids array<long>"


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """A chunk's texts, packed: ``TEXT``: ids, tokens of each (``a``) and by token the place of its pair in the chunk's
    list (``b``); ``NAMES``: by pair the place of its word in the chunk's words (``a``), and how many pairs and words
    there are, and the place of ``START`` (``b``)."""

    def row(c: int, kind: int, a: bytes, b: bytes, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c], pa.int64()), pa.array([kind], pa.int32()), pa.array([0], pa.int32()), pa.array([a], pa.binary()),
             pa.array([b], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
            names=["chunk", "kind", "bucket", "a", "b", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in by_size(batches, "t", HASHED):
            word, _, sizes = tokens(b.column("t"))
            for c, rows, (own,) in _by_chunk(b, word, sizes=sizes):
                ids = b.column("id") if isinstance(rows, slice) else b.column("id").filter(pa.array(rows))
                held.setdefault(c, []).append((own, sizes[rows], ids))
        for c in list(held):
            word, sizes, ids = zip(*held.pop(c))
            word, sizes, ids = np.concatenate(word), np.concatenate(sizes), pa.concat_arrays(ids)
            context = contexts(word, sizes)
            order = pair_order(word, context, buckets)
            sorted_word = word[order]
            first = _runs(sorted_word, context[order])
            place = np.empty(len(word), np.int32)
            place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(word)]))
            h, of_pair, start = _lexicon(sorted_word[first], buckets)
            yield row(c, NAMES, squeezed(np.diff(of_pair, prepend=0), "<i4"), squeezed(np.array([len(first), len(h), start])),
                      ids[:0])
            ends = np.cumsum(sizes)
            part = _runs((ends - 1) // PACKED)
            for lo, hi in zip(part.tolist(), [*part[1:].tolist(), len(sizes)]):
                own = slice(ends[lo] - sizes[lo], ends[hi - 1])
                yield row(c, TEXT, squeezed(sizes[lo:hi]), squeezed(place[own], "<i4"), ids[lo:hi])

    return docs.select("chunk", "id", "t").mapInArrow(run, PLACED)


def score_texts(docs: DataFrame, told: DataFrame, n_train: int, kept: list[Totals], buckets: int) -> DataFrame:
    """Texts meet the answers of their chunk: one shuffle, answers first and by bucket, as the chunk's lists lie."""
    rows = told.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(placed(docs, buckets))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    k, discount, base = len(kept), kept[-1].discount, n_train + 0.5 * (kept[-1].words + 1)

    def shares(told: list) -> np.ndarray:
        """Of pairs: their customers less discounts."""
        c, tables = (np.concatenate([np.empty(0, np.int64), *map(unsqueezed, x)]) for x in zip(*told))
        often = c > 1
        out = np.where(c == 1, 1.0 - discount, 0.0)
        out[often] = c[often] - discount / k * tables
        return out

    def of_words(told: list) -> np.ndarray:
        """A word's part of the base, its unigram probability in each kept sweep; as a context, 1 over its customers and
        the strength, and what it leaves to the parent in each; last, whether it is known."""
        v = np.concatenate([unsqueezed(a).reshape(2 + 3 * k, -1) for a, _ in told], 1)
        n, m = v[:2]
        return np.stack(
            [np.log10((n + 0.5) / base), *[x.unigram(v[2 + i], v[2 + k + i]) for i, x in enumerate(kept)],
             1 / (m + STRENGTH), *[(STRENGTH + discount * v[2 + 2 * k + i]) / (m + STRENGTH) for i in range(k)], n > 0], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, waiting, tables = None, None, None
        for b in batches:
            for c, kind, a, v, ids in zip(*(b.column(x).to_pylist() for x in ("chunk", "kind", "a", "b")), b.column("ids")):
                if c != chunk:
                    chunk, waiting, tables = c, ([], []), None
                if kind in (PAIR, WORD):
                    waiting[kind].append((a, v))
                    continue
                if kind == NAMES:
                    *many, start = unsqueezed(v).tolist()
                    tables = shares(waiting[PAIR]), of_words(waiting[WORD]), np.cumsum(unsqueezed(a, "<i4")), start
                    waiting = None
                    if many != [len(x) for x in tables[:2]]:
                        raise RuntimeError("a text meets a chunk that did not ask for its words")
                    continue
                share, of_word, names, start = tables
                sizes, pair = unsqueezed(a), unsqueezed(v, "<i4")
                first = np.cumsum(sizes) - sizes
                w = names[pair]
                x = np.r_[0, w[:-1]]  # a context is the word before
                x[first] = start
                p = sum(of_word[w, i] * of_word[x, k + 1 + i] for i in range(1, k + 1)) / k
                p += share[pair] * of_word[x, k + 1]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(sizes), pa.array(np.add.reduceat(of_word[w, 2 * k + 2] > 0, first, dtype=np.int64)),
                     pa.array(np.add.reduceat(of_word[w, 0], first)), pa.array(np.add.reduceat(np.log10(p), first))],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def training_part(id_col: Column, parts: int, part: int) -> Column:
    """Whether a document is learned from: crc32 of its id's text does not leave ``part``; null ids do not train."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts != part, F.lit(False))


def scans_files(df: DataFrame) -> bool:
    """Whether the rows come straight from files, so that each knows its input split."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation"):
            if not node.nodeName().startswith("Relation"):
                return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", parts: int = 5,
                    part: int = 1) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``."""
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"),
                       training_part(F.col(id_col), parts, part).alias("train"))
    if not scans_files(docs):
        data = stored(data, "lm-texts")
    # a chunk is an input split, so that a task asks once for all its texts
    data = data.withColumn("chunk", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    buckets = min(BUCKETS, BUCKETS_A_CHUNK * max(data.rdd.getNumPartitions(), 1))
    lists = stored(counted(requests(data, buckets), buckets), "lm-lists")
    release(spark)
    found = {r.kind: r for r in lists.filter(F.col("kind") != ASKED).groupBy("kind").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    of = lambda kind, c: found[kind][c] if kind in found else 0
    n_train, vocabulary = of(LEXICON, "y"), of(LEXICON, "x")
    discount = discount_of(n_train - of(REPEATED, "y"), of(REPEATED, "x"))
    # a restaurant's tables start as one for every dish; those of dishes with one customer stay
    pairs = stored(rows_of(lists, REPEATED, "w", "ctx", "c").withColumns(
        {"t": F.lit(1).cast("long"), "sum": F.lit(0).cast("long")}), "lm-pairs-0")
    words = rows_of(lists, LEXICON, "w", "n", "m", least=2)  # the others have one customer at most, and no repeated pair
    words = with_tables(words.select("bucket", "w", F.col("n").alias("once1"), F.col("m").alias("once")),
                        pairs.select("w", "ctx", (-F.col("c")).alias("t")))
    words = words.select("bucket", "w", F.col("c1").alias("once1"), F.col("tables").alias("once"))
    words = stored(with_tables(words, pairs).withColumn("t1", F.least(F.lit(1).cast("long"), "c1")), "lm-words-0")
    release(spark)
    shared, kept = totals(words, discount, vocabulary), []
    for k in range(1, BURN_IN + KEPT + 1):
        after = stored(sweep(pairs, words, shared, k, k > BURN_IN), f"lm-pairs-{k}")
        dropped(spark, pairs)
        pairs = after
        release(spark)
        new = with_tables(words.drop("c1", "tables"), pairs)
        new = seat_words(new.withColumn("t1", F.least("t1", "c1")), shared, k)
        if k > BURN_IN:
            new = new.withColumns({f"{c}_{len(kept)}": F.col(c) for c in ("c1", "t1", "tables")})
        after = stored(new, f"lm-words-{k}")
        dropped(spark, words)
        words = after
        release(spark)
        shared = totals(words, shared.discount, vocabulary)
        if k > BURN_IN:
            kept.append(replace(shared))
    told = stored(answers(lists, pairs, words, len(kept), buckets), "lm-answers")
    dropped(spark, lists, pairs, words)
    release(spark)
    scored = score_texts(data, told, n_train, kept, buckets)
    return scored.select(
        F.col("id").alias(id_col), (~training_part(F.col("id"), parts, part)).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
