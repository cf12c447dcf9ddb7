"""Operator 6, lexical retrieval packing.

Each scan partition is cut into index shards of bounded token count. A shard
builds a BM25 inverted index over its documents (terms: token ids) and is asked
with all distinct terms of a seed. Long
documents first fill whole windows of their own; what is left of every
document is an item. The longest unused item seeds a window; the index
returns unused neighbours of the seed, best first, which fill the window
greedily: whole ones that fit, then the best one that does not fit is cut to
fill the window exactly and its rest stays an item. Only the last window of a
shard can stay short. No shuffle; every id lies in exactly one piece.

* null text: encoded as the empty text (the end id only); empty texts likewise;
* very long texts: cut into consecutive full windows;
* ties in length or score: the earlier row of the shard;
* repeated rows and equal ids are packed as separate documents;
* an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import by_size
from tickframe.llm.pretokens import text_ids

WINDOW = 2048
SHARD_TOKENS = 4_000_000
# Numbers of the dense part of an index; a term belongs there if more than 1 / COMMON of the documents hold it.
DENSE, COMMON = 6_000_000, 8
# Seeds asked for at once; neighbours ranked at first.
SEEDS, BEST = 24, 128
# Chunks of text that a worker remembers with their ids.
REMEMBERED = 300_000
K1, B = 1.2, 0.75


class ShardIndex:
    """BM25 inverted index of one shard, asked with all distinct terms of a document.

    Postings (document, impact) by term. Terms that many documents hold are also kept as columns of a dense matrix
    (``DENSE`` numbers at most): they are the bulk of all postings, and their share of a score
    is a matrix product for a batch of seeds; the other terms' postings are added one by one.
    """

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        n, lengths = len(ends), np.diff(ends, prepend=0)
        key = np.repeat(np.arange(n, dtype=np.int64) << 32, lengths)
        key |= flat.astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.r_[first, len(key)]).astype(np.float32)
        doc, term = (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32)
        del key, first
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / lengths.mean())).astype(np.float32)
        impact = idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        # the commonest terms, as columns
        heavy = np.argsort(-df, kind="stable")[:max(DENSE // max(n, 1), 1)]
        heavy = heavy[df[heavy] * COMMON > n]
        column = np.full(len(df), -1, np.int32)
        column[heavy] = np.arange(len(heavy))
        at = column[term]
        self.dense = np.zeros((n, len(heavy)), np.float32)
        self.dense[doc[at >= 0], at[at >= 0]] = impact[at >= 0]
        # the others, by term; a document's own terms lie together, as ``term`` is in document order
        light = at < 0
        doc, term, impact = doc[light], term[light], impact[light]
        self.own = np.searchsorted(doc, np.arange(n + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.rows = np.arange(n)  # the documents of the rows of ``dense``

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """BM25 of every document to each seed's terms, ``(seeds, documents)``; documents let go are 0."""
        out = np.zeros((len(seeds), len(self.own) - 1), np.float32)
        mine = np.searchsorted(self.rows, seeds)
        out[:, self.rows] = (self.dense[mine] > 0).astype(np.float32) @ self.dense.T
        for row, s in zip(out, seeds):
            terms = self.term[self.own[s]:self.own[s + 1]]
            low, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
            total = int(size.sum())
            if total:
                spots = np.arange(total) + np.repeat(low - np.cumsum(size) + size, size)
                row += np.bincount(self.doc[spots], self.impact[spots], len(row)).astype(np.float32)
        return out

    def let_go(self, unused: np.ndarray) -> None:
        """Drops the dense rows of used documents, once they are the larger part."""
        keep = unused[self.rows]
        if 2 * keep.sum() < len(self.rows):
            self.rows, self.dense = self.rows[keep], np.ascontiguousarray(self.dense[keep])


def pack_shard(flat: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of a shard, each a list of (document, start, length) pieces in order.

    Document ``d`` has the ids ``flat[ends[d - 1]:ends[d]]``.
    """
    left = np.diff(ends, prepend=0)
    start = np.zeros(len(left), np.int64)
    for d in np.flatnonzero(left >= window):
        for _ in range(left[d] // window):
            yield [(int(d), int(start[d]), window)]
            start[d] += window
        left[d] %= window
    unused, index = left > 0, ShardIndex(flat, ends)
    by_length = np.argsort(-left, kind="stable")
    seed_at, asked = 0, {}
    while True:
        while seed_at < len(by_length) and not unused[by_length[seed_at]]:
            seed_at += 1
        if seed_at == len(by_length):
            return
        seed = by_length[seed_at]
        if seed not in asked:  # the seeds to come, as far as they are known
            index.let_go(unused)
            ahead = by_length[seed_at:seed_at + 4 * SEEDS]
            ahead = ahead[unused[ahead]][:SEEDS]
            asked = dict(zip(ahead.tolist(), index.scores(ahead)))
        pieces, room = [], window

        def put(d: int, n: int) -> None:
            nonlocal room
            pieces.append((int(d), int(start[d]), int(n)))
            start[d] += n
            left[d] -= n
            unused[d] = left[d] > 0
            room -= n

        put(seed, left[seed])
        score = asked[seed]
        near = np.flatnonzero(unused & (score > 0))
        bar = np.partition(score[near], -BEST)[-BEST] if len(near) > BEST else 0  # seldom are more looked at
        too_long = -1
        for part in (near[score[near] >= bar], near[score[near] < bar]):
            if not room:
                break
            part = part[np.argsort(-score[part], kind="stable")]
            size = left[part]
            while room and len(part):  # whole ones that fit, best first
                fits = size <= room
                if too_long < 0 and not fits[0]:
                    too_long = part[0]  # the best that does not fit
                k = int(np.argmax(fits))
                if not fits[k]:
                    break
                put(part[k], size[k])
                part, size = part[k + 1:], size[k + 1:]
        if room and too_long >= 0:
            put(too_long, room)
        rest = seed_at  # no neighbour is left: fill up with the longest unused documents
        while room and rest < len(by_length):
            d = by_length[rest]
            if unused[d]:
                put(d, min(room, left[d]))
            rest += 1
        yield pieces


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW,
                   shard_tokens: int = SHARD_TOKENS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = text_ids(path, REMEMBERED), TaskContext.get().partitionId() << 40

        def packed() -> pa.RecordBatch:
            nonlocal sequence, held, size
            columns = [[] for _ in names]
            flat = np.concatenate([x for _, x in held])
            ends, ids = np.cumsum([len(x) for _, x in held]), [i for i, _ in held]
            held, size = [], 0
            for pieces in pack_shard(flat, ends, window):
                offset = 0
                for d, s, n in pieces:
                    first = (ends[d - 1] if d else 0) + s
                    crc = zlib.crc32(flat[first:first + n].astype("<u4").tobytes())
                    total = int(ends[d] - (ends[d - 1] if d else 0))
                    for column, v in zip(columns, (ids[d], s, n, crc, total, sequence, offset)):
                        column.append(v)
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        held, size, end = [], 0, np.array([end_id], encoder.kind)
        for b in by_size(batches, "t"):
            id_arrow = b.schema.field("id").type
            for i, ids in zip(b.column("id").to_pylist(), encoder.batch(b.column("t").to_pylist())):
                held.append((i, np.concatenate([ids, end])))
                size += len(ids) + 1
                if size >= shard_tokens:
                    yield packed()
        if held:
            yield packed()

    kind = docs.schema[id_col].dataType.simpleString()
    return data.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{c}` long" for c in names[1:]))
