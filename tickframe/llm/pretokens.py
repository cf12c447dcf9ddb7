"""Pre-token work shared by the token operators: cut a text, look up or merge each part.

A BPE tokenizer merges inside pre-tokens only, so a text's ids are the ids of
its pre-tokens in order. Texts are cut at spaces and line ends first; a chunk
seen before needs no further work, a new one is split into pre-tokens, and
only pre-tokens not seen before are merged, by the library's model. Chunks
are split with Python's ``re`` where that is proven equal to the library,
character by character; any other text goes to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tickframe.llm.common import worker_state

# The split patterns of the public vocabularies, letters \p{L} as [^\W\d_],
# numbers \p{N} as \d, everything else as [^\s\w] or _.
SPLIT_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
SPLIT_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
# Code points tried by the proof; below U+0300 no character combines with its neighbours.
PROOF_RANGE = range(1, 0x300)
# A run of three white-space characters is cut differently inside a text than at its spaces.
PAIRS = ["".join(run) for run in itertools.product(" \n", repeat=2)]
RUNS = ["".join(run) for run in itertools.product(" \n", repeat=3)]
# Marks that stand as a pre-token of their own after a word.
MARKS = tuple(".,;:!?")
# Entries kept per table (about 200 bytes each); a full table starts again, results never change.
TABLE_LIMIT = 1_000_000


class Splitter:
    """Splits a text into pre-tokens; ``odd`` tells what only the library splits safely."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = _byte_symbols()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lowered = "Lowercase" in json.dumps(spec["normalizer"])
        self.find = re.compile(SPLIT_WORD if self.lowered else SPLIT_BYTE_LEVEL).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        unsafe = ["\0", *(chr(c) for c in PROOF_RANGE if not self._proven(chr(c)))]
        self.odd_ascii = [c for c in unsafe if c.isascii()] + specials
        self.odd_any = re.compile("|".join(map(re.escape, specials)) + "|[" + re.escape("".join(unsafe))
                                  + "\u0300-\U0010ffff]").search

    def odd(self, text: str) -> bool:
        if text.isascii():
            return any(c in text for c in self.odd_ascii)
        return self.odd_any(text) is not None

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None for an odd text."""
        if self.odd(text):
            return None
        return self.find(text.lower() if self.lowered else text)

    def _proven(self, c: str) -> bool:
        """The library's ids of a probe with ``c`` in every position equal those of the split pieces."""
        if c.isspace() and c not in " \n\t\r":
            return False  # Python and the library differ on which of these are white space
        probe = f"{c} a{c}b A{c}B 1{c}2 !{c}? {c}{c} x {c}'s'{c} '{c}s  {c}\n{c} {c}"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for p in self.find(probe.lower() if self.lowered else probe) for i in self.merged(p)]

    def merged(self, piece: str) -> list[int]:
        """The ids of one pre-token, merged by the library's model without splitting again."""
        if not (piece.isalpha() and piece.isascii()):  # ASCII letters stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.tokenize(piece)]


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Table(dict):
    """Remembers ``make(key)``."""

    def __init__(self, make: Callable, known: dict | None = None, limit: int = TABLE_LIMIT):
        super().__init__(known or {})
        self.make, self.known, self.limit = make, known or {}, limit + len(known or {})

    def __missing__(self, key: str):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.known)
        self[key] = value = self.make(key)
        return value


class TextIds:
    """Token ids of whole texts, batch by batch.

    A batch is cut into chunks and its distinct chunks are found by Arrow;
    each gets its ids once, from a table that lives as long as the worker,
    and the texts' ids are gathered from the distinct chunks. With
    ``count_only`` the table holds token counts instead of ids; ``known``
    holds the counts of pre-tokens that need no merging.
    """

    def __init__(self, path: str, count_only: bool = False, known: dict[str, int] | None = None,
                 limit: int = TABLE_LIMIT):
        self.splitter, self.count_only, self.known = Splitter(path), count_only, known or {}
        size = self.splitter.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        code = "H" if size <= 1 << 16 else "I"
        self.of = len if count_only else (lambda ids: struct.pack(f"<{len(ids)}{code}", *ids))
        self.join = sum if count_only else b"".join
        self.piece = _Table(lambda piece: self.of(self.splitter.merged(piece)), self.known, limit)
        self.bare = _Table(lambda chunk: self._chunk("", chunk, self.bare), limit=limit)
        self.spaced = _Table(lambda chunk: self._chunk(" ", chunk, self.spaced), limit=limit)

    def _chunk(self, space: str, chunk: str, table: _Table):
        """A chunk's value; words, alone or before one mark, need no pattern."""
        if chunk.isalpha():
            known = self.known.get(space + chunk) if self.known else None
            return self.of(self.splitter.merged(space + chunk)) if known is None else known
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.join((table[chunk[:-1]], self.piece[chunk[-1]]))
        return self.join(map(self.piece.__getitem__, self.splitter.find(space + chunk)))

    def _whole(self, text: str):
        """A text that is not cut into chunks."""
        if self.splitter.odd(text):
            return self.of(self.splitter.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.join(map(self.piece.__getitem__, self.splitter.find(text)))

    def batch(self, texts: list[str]) -> list:
        """Per text its number of tokens, or its ids as an array."""
        lowered, out, at, plain = self.splitter.lowered, [None] * len(texts), [], []
        for i, t in enumerate(texts):
            if self.splitter.odd(t) or not lowered and (
                    "\t" in t or "\r" in t or t[-2:].isspace()
                    or any(p in t for p in PAIRS) and any(run in t for run in RUNS)):
                out[i] = self._whole(t)
            else:
                at.append(i)
                plain.append(t.lower() if lowered else t)
        if not self.count_only:
            out = [None if v is None else np.frombuffer(v, self.kind) for v in out]
        for i, v in zip(at, self._chunked(plain) if plain else ()):
            out[i] = v
        return out

    def _chunked(self, texts: list[str]) -> list:
        lowered = self.splitter.lowered
        cut = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " " if lowered else " \n ")
        lists = pc.split_pattern(cut, " ")
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        if lowered:
            values = list(map(self.bare.__getitem__, chunks.tolist()))
        else:  # a chunk stands bare at the start of a text or line, else behind a space
            line = np.flatnonzero(chunks == "\n")
            line = int(line[0]) if len(line) else -1
            start = np.zeros(len(code), bool)
            start[1:] = code[:-1] == line
            start[ends[:-1]] = True
            code = code + len(chunks) * (start | (code == line)).astype(np.int64)
            used = np.flatnonzero(np.bincount(code, minlength=2 * len(chunks)))
            spaced, bare = used[used < len(chunks)], used[used >= len(chunks)] - len(chunks)
            values = [*map(self.spaced.__getitem__, chunks[spaced].tolist()),
                      *map(self.bare.__getitem__, chunks[bare].tolist())]
            place = np.zeros(2 * len(chunks), np.int64)
            place[used] = np.arange(len(used))
            code = place[code]
        size = np.array(values if self.count_only else list(map(len, values)), np.int64)
        total = np.concatenate([[0], np.cumsum(size[code])])[ends]
        if self.count_only:
            return np.diff(total).tolist()
        flat = pa.array(values, pa.large_binary()).take(pa.array(code))
        first = int(np.frombuffer(flat.buffers()[1], np.int64, 1, flat.offset * 8)[0])
        flat = np.frombuffer(flat.buffers()[2], np.uint8, int(total[-1]), first).view(self.kind) \
            if total[-1] else np.empty(0, self.kind)
        return np.split(flat, total[1:-1] // self.kind.itemsize)


def text_ids(path: str, limit: int = TABLE_LIMIT) -> TextIds:
    """The worker's table for a tokenizer file, of ``limit`` entries at most."""
    return worker_state(("ids", path, limit), lambda: TextIds(path, limit=limit))
