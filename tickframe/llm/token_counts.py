"""Operator 1, token counts by the whole-token shortcut.

Proved once, before any text is read: which vocabulary strings the tokenizer
encodes, standing alone as one pre-token, to exactly one token. A pre-token
in that table counts 1 with no merging; only the rest is merged.

* null text: counted as the empty text (0 bytes, 0 tokens);
* very long texts: processed whole, one text at a time;
* special strings in a text (``<|endoftext|>``): one special token each, the library's default;
* other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import by_size, worker_state
from tickframe.llm.pretokens import Splitter, TextIds

def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token (at most the vocabulary's size)."""
    s = Splitter(path)
    by_id = s.tokenizer.get_vocab(with_added_tokens=False)
    # byte-level symbols to text; strings that are no valid UTF-8 are never whole pre-tokens
    strings = {s.tokenizer.decode([i], skip_special_tokens=False) for i in by_id.values()}
    strings = [x for x in strings if x and "�" not in x and s.pieces(x) == [x]]
    encoded = s.tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(x for x, e in zip(strings, encoded) if len(e.ids) == 1)


def _counter(path: str, whole: frozenset[str]) -> TextIds:
    return worker_state(("counts", path), lambda: TextIds(path, True, dict.fromkeys(whole, 1)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` for every row of ``docs``; no shuffle."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, whole.value)
        for b in by_size(batches, "t", 16 << 20):
            n_bytes = pc.binary_length(b.column("t")).cast(pa.int64())
            n_tokens = pa.array(count.batch(b.column("t").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), n_bytes, n_tokens],
                                             names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return data.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
