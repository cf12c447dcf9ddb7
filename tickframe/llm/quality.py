"""Operator 7, quality classifier: random-indexing word vectors, pooled, and a two-layer network.

* Tokens: a word's lower-cased core, the marks it ends with and its letter
  case are tokens of their own, hashed to ``BUCKETS`` buckets.
* Random indexing: a bucket has a fixed sparse +-1 index vector; its word
  vector is the sum of its neighbours' index vectors over the whole corpus.
  Tasks add up their part in one bounded matrix; parts are summed in two
  rounds, streamed, so no task holds more than a few blocks of the matrix.
* A document's vector pools the unit vectors of its tokens (mean, spread) and how much it repeats itself.
* A two-layer numpy network is trained on the driver from at most
  ``MAX_SAMPLE`` labelled documents (those with the smallest hashed ids); its
  probabilities are calibrated by a temperature on documents left out.

Labels, language, source and id are no inputs of a score.

* null and empty texts: the zero vector, scored like any other;
* very long texts are pooled whole; repeated rows score alike;
* several labels of one document: their majority (ties count as good);
* no labels: every score is 0.5; labels of one kind only: their smoothed share;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import by_size, worker_state

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
LAGS = 3
WIDTH = 2 * DIM + LAGS
BLOCK_ROWS = 256
SALTS = 16
MAX_SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 3e-3, 1e-4, 11
TOKENS_AT_ONCE = 200_000


class _Words(dict):
    """Word -> up to three token buckets (core, end marks, case), -1 for none; bounded memory."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= 300_000:
            self.clear()
        core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        end = word[len(core):]
        shape = "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() else ""
        self[word] = v = (self.bucket("w", core.lower()) if core else -1,
                          self.bucket("e", end) if end else -1, self.bucket("s", shape) if shape else -1)
        return v

    @staticmethod
    def bucket(kind: str, s: str) -> int:
        return zlib.crc32(f"{kind}:{s}".encode()) % BUCKETS


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token buckets of the texts, end to end, and the number of tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    words = worker_state("token buckets", _Words)
    table = np.array([words[w] for w in coded.dictionary.to_pylist()], np.int32).reshape(-1, 3)
    buckets = table[coded.indices.to_numpy()]
    there = buckets >= 0
    total = np.concatenate([[0], np.cumsum(there.sum(1))])
    return buckets[there], np.diff(total[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's sparse index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO), np.int32), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """The ``BUCKETS`` x ``DIM`` matrix of unit word vectors, learned from all texts."""

    def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM)
        for b in by_size(batches, "t"):
            tokens, sizes = token_buckets(b.column("t"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, REACH + 1):
                near = doc[step:] == doc[:-step]
                left, right = tokens[:-step][near], tokens[step:][near]
                for k in range(NONZERO):
                    for word, other in ((left, right), (right, left)):
                        np.add.at(total, word * DIM + place[other, k], sign[other, k])
        parts = total.astype(np.float32).reshape(-1, BLOCK_ROWS * DIM)
        used = np.flatnonzero(parts.any(1))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([salt] * len(used), pa.int64()),
             pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["block", "salt", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("sums")):
                part = np.frombuffer(v.as_py(), np.float32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()),
             pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())],
            names=["block", "salt", "sums"])

    schema = "block long, salt long, sums binary"
    parts = docs.select(F.col(text).alias("t")).mapInArrow(local_sums, schema)
    parts = parts.repartition("block", "salt").mapInArrow(add_up, schema)
    parts = parts.repartition("block").mapInArrow(add_up, schema)
    out = np.zeros((BUCKETS // BLOCK_ROWS, BLOCK_ROWS * DIM), np.float64)
    for r in parts.collect():  # BUCKETS x DIM numbers in all, whatever the corpus
        out[r["block"]] += np.frombuffer(r["sums"], np.float32)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and mean square of its token vectors, and the share of tokens that stand again one
    to ``LAGS`` places later."""
    tokens, sizes = token_buckets(texts)
    out = np.zeros((len(sizes), WIDTH), np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(0, len(tokens), TOKENS_AT_ONCE):
        x, d = vectors[tokens[k:k + TOKENS_AT_ONCE]], doc[k:k + TOKENS_AT_ONCE]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out[d[first], :DIM] += np.add.reduceat(x, first, axis=0)
        out[d[first], DIM:2 * DIM] += np.add.reduceat(x * x, first, axis=0)
    for lag in range(1, LAGS + 1):
        again = (tokens[lag:] == tokens[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, 2 * DIM + lag - 1] = np.bincount(doc[:-lag], again, len(sizes))[:len(sizes)]
    return out / np.maximum(sizes, 1)[:, None]


class Network:
    """Standardised inputs, one tanh layer, one output; probabilities at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = 0.5 if not len(y) else float((y.sum() + 1) / (len(y) + 2))
            return
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._standard(x)
        held = rng.random(len(x)) < 0.15
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(x), bool)
        self.w = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
                  rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self._fit(x[~held], y[~held], rng)
        self.temperature = 1.0
        check = held if held.any() else ~held
        z = self._logits(x[check])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.logaddexp(0, np.where(y[check] == 1, -z, z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        m, v, n = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                rows = order[k:k + BATCH]
                h = np.tanh(x[rows] @ self.w[0] + self.w[1])
                g = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]))) - y[rows]) / len(rows)
                gh = g[:, None] * self.w[2] * (1 - h * h)
                n += 1
                for i, d in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(keepdims=True))):
                    d = d + DECAY * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9 ** n)) / (np.sqrt(v[i] / (1 - 0.999 ** n)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self._logits(self._standard(x)) / self.temperature))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` modulo ``parts``; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, vectors, text: str, id_col: str, label: str) -> list:
    """At most ``MAX_SAMPLE`` rows ``(id, y, x)`` of labelled training documents, those with the smallest hashed ids."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("id"), 4, 2))
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    known = known.join(data.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "t"):
            x = pool(b.column("t"), vectors.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    chosen = data.join(F.broadcast(known), "id")  # MAX_SAMPLE ids
    rows = chosen.mapInArrow(run, "id long, y int, x binary").collect()
    return sorted({r["id"]: r for r in sorted(rows)}.values())


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "score", text: str = "text", id_col: str = "doc_id",
                 label: str = "quality") -> DataFrame:
    """``docs`` with the probability of label 1 in the new column ``name``; no shuffle of texts."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))  # BUCKETS x DIM
    sample = training_sample(docs, labels, vectors, text, id_col, label)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample], np.float64).reshape(-1, WIDTH)
    network = Network(x, np.array([r["y"] for r in sample], np.float64))
    names = [f"own_{i}" for i in range(len(docs.columns))]  # any column names, whatever they clash with
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, at):
            score = network.score(pool(b.column(at), vectors.value))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    own = docs.toDF(*names)
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema).toDF(*docs.columns, name)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
                   label: str = "quality") -> DataFrame:
    """``(id_col, held_out, score)`` for every row of ``docs``."""
    scored = with_quality(docs.select(id_col, text), labels, "score", text, id_col, label)
    return scored.select(id_col, held_out(F.col(id_col), 4, 2).alias("held_out"), "score")
