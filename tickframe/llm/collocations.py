"""Operator 12, phrase collocations: exact n-gram counts in counting quotient filters, per language.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at
spaces and tabs. Word ids are 64-bit hashes of language and word that no two words of the corpus share (checked over
all words; another seed is taken otherwise), so an n-gram of ids names language and words.
Each task counts its n-grams, permutes the packed ids and sends
one sorted quotient filter per bucket (``quotient_filter``); filters of a bucket are merged.

Only n-grams whose words are all frequent can be frequent, and only phrases whose pairs are: words are
counted first, then pairs, then three and four words at once. What is known to be
frequent is handed on in tables of fixed size that may say yes too often but
never no, so no phrase is lost at any size. Up to ``DENSE`` frequent words their ids are ranks
of ``DENSE_BITS`` bits, found by binary search in the sorted hashes (at most 16 MB, broadcast after
counting them); beyond that the hashes themselves are packed and a table of
``2 ** MARK_BITS`` bits (4 MB) stands for the frequent words.

Scale: three passes over the texts, none of which shuffles them. Words and n-grams are
added up in the task first; a frequent n-gram is one entry of a task, and
permuted entries fill all buckets evenly, whatever is frequent. Buckets grow in
number with the words of the corpus. Scores come from joins on phrase keys.

* null language: ``und``; null or empty text, texts without words: nothing counted;
* very long texts are read whole; a task's tables are flushed at a fixed size;
* ties in score are broken by count, then by the phrase's UTF-8 bytes;
* repeated rows count every time; ids are not read, nor are other columns;
* an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import LOWER, UPPER, by_size, stored, worker_state
from tickframe.llm.quotient_filter import Limbs, by_bucket, from_filter, merged, permute, restore, summed
from tickframe.llm.shingles import scramble

MIN_COUNT, TOP, CONTAINED = 30, 2000, 80
DENSE, DENSE_BITS = (1 << 21) - 1, 21
MARK_BITS = 25
# A task's tables: words before a flush, entries merged at once, words remembered with their id.
WORDS, ENTRIES, REMEMBERED = 200_000, 1 << 21, 400_000
# Words of the corpus per bucket, at most.
BUCKET_WORDS = 1 << 20
_END = b"\xff"  # in no UTF-8 text: ends a piece
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + _END * 10)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text and ``_END`` after each piece."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


def word_id(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) or 1


def language_seed(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


# ---------------------------------------------------------------- words

def _word_counts(seed: int):
    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            of.pop(_END, None)
            by = language_seed(lang, seed)
            ids = np.fromiter((word_id(w, by) for w in of), np.uint64, len(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(of), pa.string()), pa.array(list(of), pa.binary()).cast(pa.string()),
                 pa.array(ids.view(np.int64)), pa.array(list(of.values()), pa.int64())],
                names=["lang", "word", "id", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in by_size(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(b.column("lang").to_pylist(), texts):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > WORDS:
                yield from rows(counts)
        yield from rows(counts)
    return run


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """``(id, lang, word, n)`` of every word, and the seed under which no two words share an id."""
    seed = 0
    while True:
        found = texts.mapInArrow(_word_counts(seed), "lang string, word string, id long, n long")
        words = stored(found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def mark_table(marks: DataFrame, column: str = "mark") -> np.ndarray:
    """A bit table of ``2 ** MARK_BITS`` bits with the leading bits of every 64-bit ``column`` set.

    At most ``2 ** MARK_BITS / 64`` rows come to the driver.
    """
    place = f"shiftrightunsigned({column}, {64 - MARK_BITS})"
    words = marks.select(F.expr(f"{place} >> 6").alias("at"),
                         F.expr(f"shiftleft(1L, CAST({place} & 63 AS INT))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def marked(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = marks >> np.uint64(64 - MARK_BITS)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def pair_marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(scramble(a * _MULTIPLIER + np.uint64(1)) + b)


# ---------------------------------------------------------------- packed n-grams

class Packing:
    """How ids become limbs: ranks of ``DENSE_BITS`` bits two to a limb, or one 64-bit hash to a limb."""

    def __init__(self, dense: bool):
        self.dense = dense

    def widths(self, n: int) -> tuple[int, ...]:
        if not self.dense:
            return (64,) * n
        return {2: (DENSE_BITS,) * 2, 3: (DENSE_BITS, 2 * DENSE_BITS), 4: (2 * DENSE_BITS,) * 2}[n]

    def limbs(self, ids: list[np.ndarray]) -> Limbs:
        if not self.dense:
            return ids
        both = lambda a, b: (a << np.uint64(DENSE_BITS)) | b
        return {2: lambda a, b: [a, b], 3: lambda a, b, c: [a, both(b, c)],
                4: lambda a, b, c, d: [both(a, b), both(c, d)]}[len(ids)](*ids)

    def ids(self, limbs: Limbs, n: int) -> list[np.ndarray]:
        if not self.dense:
            return limbs
        low = np.uint64((1 << DENSE_BITS) - 1)
        out = []
        for x, w in zip(limbs, self.widths(n)):
            out += [x] if w == DENSE_BITS else [x >> np.uint64(DENSE_BITS), x & low]
        return out


class Ids(dict):
    """Word -> id of a frequent word of one language, else 0 (hashed ids: now and then also another word's)."""

    def __init__(self, seed: int, known: array | None, table: np.ndarray | None):
        super().__init__()
        self.seed, self.known, self.table = seed, known, table
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        h = word_id(word, self.seed)
        if self.known is not None:
            i = bisect_left(self.known, h)
            h = i + 1 if i < len(self.known) and self.known[i] == h else 0
        elif not marked(self.table, np.array([h], np.uint64))[0]:
            h = 0
        self[word] = h
        return h


class Vocabulary:
    """The frequent words as a task needs them: sorted hashes (dense) or a bit table."""

    def __init__(self, seed: int, known: np.ndarray | None, table: np.ndarray | None):
        self.seed, self.table = seed, table
        self.known = None if known is None else array("Q", known.tobytes())
        self.of: dict[str, Ids] = {}

    def encode(self, lang: str, text: bytes) -> np.ndarray:
        """Ids of a text's words, 0 for other words and where a piece ends."""
        if sum(map(len, self.of.values())) > REMEMBERED:
            self.of.clear()
        if lang not in self.of:
            self.of[lang] = Ids(language_seed(lang, self.seed), self.known, self.table)
        words = tokens(text)
        return np.fromiter(map(self.of[lang].__getitem__, words), np.uint64, len(words))


class Shard:
    """A task's counter of the n-grams of one length; sends filters when it has grown to ``ENTRIES``."""

    def __init__(self, n: int, packing: Packing, bucket_bits: int):
        self.n, self.packing, self.widths, self.bits = n, packing, packing.widths(n), bucket_bits
        self.parts: list[tuple[Limbs, np.ndarray]] = []
        self.held = 0

    def add(self, ids: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        if not len(ids[0]):
            return
        self.parts.append(summed(self.packing.limbs(ids), self.widths))
        self.held += len(self.parts[-1][1])
        if self.held > 2 * ENTRIES:
            self.parts = [merged(self.parts, self.widths)]
            self.held = len(self.parts[0][1])
            if self.held > ENTRIES:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if self.parts:
            limbs, counts = merged(self.parts, self.widths)
            limbs, counts = summed(permute(limbs, self.widths), self.widths, counts)
            for bucket, data in by_bucket(limbs, counts, self.widths, self.bits):
                yield self.n, bucket, data
        self.parts, self.held = [], 0


def _grams(x: np.ndarray, lengths: tuple[int, ...], pairs: np.ndarray | None) -> Iterator[list[np.ndarray]]:
    """Ids of the n-grams of each length that may be frequent, in text order."""
    near = (x[:-1] != 0) & (x[1:] != 0)
    if pairs is not None:
        at = np.flatnonzero(near)
        near[at] = marked(pairs, pair_marks(x[at], x[at + 1]))
    for n in lengths:
        ok = near[:len(near) - n + 2].copy()
        for k in range(1, n - 1):
            ok &= near[k:len(near) - n + 2 + k]
        at = np.flatnonzero(ok)
        yield [x[at + k] for k in range(n)]


def _filters(lengths: tuple[int, ...], packing: Packing, bucket_bits: int, seed: int, known, table, pairs):
    """Filters of every n-gram that may be frequent; ``known``, ``table``, ``pairs``: broadcast or None."""
    name = ("phrases", uuid.uuid4().hex)
    value = lambda shared: None if shared is None else shared.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(name, lambda: Vocabulary(seed, value(known), value(table)))
        shards = [Shard(n, packing, bucket_bits) for n in lengths]
        full: list[tuple[int, int, bytes]] = []
        gap = np.zeros(1, np.uint64)
        for b in by_size(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            parts = [p for lang, text in zip(b.column("lang").to_pylist(), texts) for p in (words.encode(lang, text), gap)]
            x = np.concatenate([*parts, gap, gap, gap])
            for shard, ids in zip(shards, _grams(x, lengths, value(pairs))):
                full += shard.add(ids)
            if full:
                yield _filter_rows(full)
                full = []
        for shard in shards:
            yield _filter_rows(list(shard.flush()))
    return run


def _filter_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.binary())], names=["n", "bucket", "filter"])


def _merge(packing: Packing, bucket_bits: int, min_count: int, known):
    """Merged filters' n-grams that reach ``min_count``, as word hashes."""
    def grams(n: int, parts: list[tuple[Limbs, np.ndarray]]) -> pa.RecordBatch:
        widths = packing.widths(n)
        limbs, counts = merged(parts, widths)
        often = counts >= min_count
        ids = packing.ids(restore([x[often] for x in limbs], widths), n)
        mark = pair_marks(ids[0], ids[1]) if n == 2 else np.zeros(int(often.sum()), np.uint64)
        if packing.dense:
            ids = [known.value[(x - np.uint64(1)).astype(np.int64)] for x in ids]
        ids += [np.zeros(len(mark), np.uint64)] * (4 - n)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(mark), n, np.int32)), *[pa.array(x.view(np.int64)) for x in ids],
             pa.array(counts[often]), pa.array(mark.view(np.int64))], names=["n", "w1", "w2", "w3", "w4", "a", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], 0
        for b in batches:
            for n, bucket, data in zip(*[b.column(c).to_pylist() for c in ("n", "bucket", "filter")]):
                if parts and key != (n, bucket):
                    yield grams(key[0], parts)
                    parts, held = [], 0
                key = n, bucket
                parts.append(from_filter(data, packing.widths(n), bucket, bucket_bits))
                held += len(parts[-1][1])
                if held > 2 * ENTRIES:
                    parts = [merged(parts, packing.widths(n))]
                    held = len(parts[0][1])
        if parts:
            yield grams(key[0], parts)
    return run


# ---------------------------------------------------------------- phrases

def phrase_counts(texts: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(words, phrases)``: every word, and the phrases of 2 to 4 words found ``min_count`` times in a language.

    ``words(id, lang, word, n)``; ``phrases(n, w1, w2, w3, w4, a)`` with word ids, 0 after the last word.
    ``texts(lang, text)`` without nulls.
    """
    sc = texts.sparkSession.sparkContext
    words, seed = word_counts(texts)
    frequent = words.filter(F.col("n") >= min_count)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                     F.count_if(F.col("n") >= min_count).alias("frequent")).first()
    bucket_bits = max(5, (size["n"] // BUCKET_WORDS).bit_length())
    packing = Packing(dense=size["frequent"] <= DENSE and bucket_bits < DENSE_BITS)
    known = table = None
    if packing.dense:
        known = sc.broadcast(np.sort(frequent.select("id").toArrow().column("id").to_numpy().view(np.uint64)))
    else:
        table = sc.broadcast(mark_table(frequent, "id"))

    def count(lengths: tuple[int, ...], pairs) -> DataFrame:
        filters = texts.mapInArrow(_filters(lengths, packing, bucket_bits, seed, known, table, pairs),
                                   "n int, bucket long, filter binary")
        dealt = filters.repartition("n", "bucket").sortWithinPartitions("n", "bucket")
        found = dealt.mapInArrow(_merge(packing, bucket_bits, min_count, known),
                                 "n int, w1 long, w2 long, w3 long, w4 long, a long, mark long")
        return stored(found, "phrases")

    two = count((2,), None)
    longer = count((3, 4), sc.broadcast(mark_table(two)))
    return words, two.unionByName(longer).drop("mark")


def scored(words: DataFrame, phrases: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``phrases`` with ``score, k, l, r`` of their lowest-scoring cut."""
    single = words.filter(F.col("n") >= min_count).select(
        F.col("id").alias("w1"), F.lit(0).cast("long").alias("w2"), F.lit(0).cast("long").alias("w3"), F.col("n").alias("f"))
    parts = single.unionByName(phrases.filter("n < 4").select("w1", "w2", "w3", F.col("a").alias("f")))
    part = lambda side: parts.select(*[F.col(f"w{i}").alias(f"{side}{i}") for i in (1, 2, 3)], F.col("f").alias(side))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumn("w", F.array("w1", "w2", "w3", "w4", *[F.lit(0).cast("long")] * 3))
    cuts = cuts.select("n", "w1", "w2", "w3", "w4", "a", "k",
                       *[F.when(F.col("k") >= i, F.col(f"w{i}")).otherwise(0).alias(f"l{i}") for i in (1, 2, 3)],
                       *[F.element_at("w", F.col("k") + i).alias(f"r{i}") for i in (1, 2, 3)])
    cuts = cuts.join(part("l"), ["l1", "l2", "l3"]).join(part("r"), ["r1", "r2", "r3"])
    score = F.expr("CAST(2000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(38,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("n", "w1", "w2", "w3", "w4", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("n", "w1", "w2", "w3", "w4", "a", "cut.*")


def contained_in(phrases: DataFrame) -> DataFrame:
    """``(w1, w2, w3, longer)``: the largest count of a longer phrase that holds these words."""
    w = ["w1", "w2", "w3", "w4"]
    zero = F.lit(0).cast("long")
    inner = [(n, at, size) for n in (3, 4) for size in range(2, n) for at in range(n - size + 1)]
    subs = F.array(*[F.when(F.col("n") == n, F.struct(*[
        (F.col(w[at + i]) if i < size else zero).alias(f"w{i + 1}") for i in range(3)])) for n, at, size in inner])
    each = phrases.filter("n > 2").select("a", F.explode(subs).alias("s")).filter("s is not null")
    return each.groupBy("s.w1", "s.w2", "s.w3").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the two sides of its lowest-scoring cut, ``n`` the words of the
    language. A phrase that a longer one of ``contained`` per cent of its count holds is left out.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, phrases = phrase_counts(texts, min_count)
    kept = scored(words, phrases, min_count).join(contained_in(phrases), ["w1", "w2", "w3"], "left")
    kept = kept.filter((F.col("n") == 4) | F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    named = words.filter(F.col("n") >= min_count)
    word = lambda i: named.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
    own = kept.drop("n").join(named.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1")), "w1")
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    own = own.withColumn("place", F.rank().over(line)).filter(F.col("place") <= top)  # ties at the end stay
    for i in (2, 3, 4):
        own = own.join(word(i), f"w{i}", "left")
    own = own.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3", "word4"))
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    own = own.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return own.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("long").alias("score"))
