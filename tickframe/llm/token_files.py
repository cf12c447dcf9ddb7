"""Operator 5, token-id files: Arrow files of fixed-size-list batches.

Documents are ordered by id, encoded, closed with an end id and laid end to
end; the stream of each range partition is one shard. A shard is an Arrow
file whose record batches hold ``ids`` (fixed-size list of ``seq_len``
unsigned integers) and ``mask`` (fixed-size list of booleans, true on tokens,
false on the padding that ends a shard). Every sequence has the same length,
so sequence ``i`` sits at a computed place and is read as a view, without
copying. A second small Arrow file per shard holds ``(doc_id, start, n_tokens)``.

Lost executors: every task attempt writes files under names of its own, and
only the attempt that Spark commits is recorded in the shard table; files of
lost attempts are never read.

* null text: encoded as the empty text (the end id only); null ids sort first;
* very long texts: encoded whole, written in batches of bounded size;
* equal ids: ordered by text; repeated rows are kept;
* empty table: no shards, and reading returns no rows;
* other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import by_size, stored
from tickframe.llm.pretokens import text_ids

SEQ_LEN = 2048
BATCH_SEQUENCES = 64


class ShardWriter:
    """Appends documents to one shard; holds at most one batch of sequences and one document."""

    def __init__(self, folder: str, kind: np.dtype, seq_len: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.kind, self.seq_len = f"{root}/shard-{uuid.uuid4().hex}.arrow", kind, seq_len
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.waiting, self.size, self.tokens = [], 0, 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        self.index.append((doc_id, self.tokens, n))
        self.tokens += n
        self.waiting.append(ids)
        self.size += n
        if self.size >= self.seq_len * BATCH_SEQUENCES:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        flat = np.concatenate([np.empty(0, self.kind), *self.waiting])
        step = self.seq_len * BATCH_SEQUENCES
        at = 0
        while len(flat) - at >= step or (whole and at < len(flat)):
            part = flat[at:at + step]
            n = -(-len(part) // self.seq_len)
            ids = np.zeros(n * self.seq_len, self.kind)
            ids[:len(part)] = part
            mask = np.arange(n * self.seq_len) < len(part)
            self.file.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
            at += len(part)
        self.waiting, self.size = [flat[at:].copy()], len(flat) - at

    def close(self, id_type_: pa.DataType) -> tuple[str, str, int, int]:
        self._flush(whole=True)
        self.file.close()
        self.out.close()
        docs = self.path.replace(".arrow", "-docs.arrow")
        columns = list(zip(*self.index))
        table = pa.table([pa.array(columns[0], id_type_), pa.array(columns[1], pa.int64()),
                          pa.array(columns[2], pa.int64())], names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(docs) as out, pa.ipc.new_file(out, table.schema) as f:
            f.write_table(table, max_chunksize=65_536)
        return self.path, docs, len(self.index), self.tokens


class TokenFile:
    """Random access to one shard: sequence ``i`` and its mask as views into the (mapped) file."""

    def __init__(self, path: str, filesystem: pafs.FileSystem | None = None):
        local = filesystem is None or isinstance(filesystem, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else filesystem.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.file.get_batch(k)
        ids = b.column("ids").values.to_numpy().reshape(-1, self.seq_len)
        mask = b.column("mask").values.to_numpy(zero_copy_only=False).reshape(-1, self.seq_len)
        return ids, mask

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // BATCH_SEQUENCES)
        return ids[i % BATCH_SEQUENCES], mask[i % BATCH_SEQUENCES]

    def tokens(self) -> Iterator[np.ndarray]:
        """The token stream, batch by batch, without padding."""
        for k in range(self.file.num_record_batches):
            ids, mask = self.batch(k)
            yield ids.reshape(-1)[:int(mask.sum())]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, seq_len: int = SEQ_LEN,
                      text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the shards below ``folder`` (a shared folder) and return the shard table, ordered by ``shard``."""
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    data = data.repartitionByRange("id").sortWithinPartitions("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, text_ids(path)
        for b in by_size(batches, "t", 16 << 20):
            ids = encoder.batch(b.column("t").to_pylist())
            for i, x in zip(b.column("id").to_pylist(), ids):
                writer = writer or ShardWriter(folder, encoder.kind, seq_len)
                writer.add(i, np.append(x, encoder.kind.type(end_id)))
        if writer:
            file, index, n_docs, n_tokens = writer.close(b.schema.field("id").type)
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "file": file,
                                               "index": index, "n_docs": n_docs, "n_tokens": n_tokens}])

    return stored(data.mapInArrow(run, "shard long, file string, index string, n_docs long, n_tokens long"), "shards")


def read_token_files(spark: SparkSession, shards: DataFrame, folder: str, id_kind: str = "long") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    One row per shard passes the driver to number the shards' first tokens.
    """
    rows, first = [], 0
    for r in sorted(shards.collect()):  # one row per written partition
        rows.append((r["shard"], r["file"], r["index"], first))
        first += r["n_tokens"]
    plan = spark.createDataFrame(rows, "shard long, file string, index string, first long")
    out = f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem = pafs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for r in b.to_pylist():
                stream, left = TokenFile(r["file"], filesystem).tokens(), np.empty(0, "<u2")
                index = pa.ipc.open_file(filesystem.open_input_file(r["index"]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    crcs = []
                    for n in part.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if not len(left):
                                left = next(stream)
                            crc = zlib.crc32(left[:n].astype("<u4").tobytes(), crc)
                            n, left = n - len(left[:n]), left[n:]
                        crcs.append(crc)
                    starts = part.column("start").to_numpy() + r["first"]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(starts), part.column("n_tokens"),
                         pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.repartition(max(1, len(rows)), "shard").mapInArrow(run, out)
