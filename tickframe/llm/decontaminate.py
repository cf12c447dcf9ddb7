"""Operator 8, benchmark decontamination: BM25 with block-max WAND, then the overlap of words in order.

The test items are cut into segments, and an inverted index holds the BM25
impact of every term in every segment. Segments of similar length share a
block; a posting names a block with the largest impact its segments have for the term. Every passage
of every document is a query: windows of twice the longest segment of a length class,
one segment length apart, so that any run of that length lies in one window.

* Pivot terms. A segment's commonest terms, up to ``REST`` of the score it must reach, cannot bring it there; only the
  other terms are posted. A window without any of a block's posted terms never touches the block.
* Block maxima. For the blocks that a window's distinct posted terms name, the maxima are added up; a block is skipped
  unless they reach its gap, the least score that its segments still need beside their unposted terms.
* For the others the exact BM25 score of each segment is computed; all
  segments that reach ``SHARE`` of their own full score are retrieved.
* A retrieved item is compared word by word: a word is held when it lies in a
  run of ``RUN_WORDS`` words that also stands in one passage of the document,
  at most twice as long as what is looked for. A changed word costs itself, not
  all the runs around it.
* An item with an answer mark counts when a passage holds ``MIN_OVERLAP`` of
  its question, and the document as much of its answer. Any other item counts
  when a passage holds as much of the whole item, or of the item without its
  last sentence if ``MIN_WORDS`` words are left then.
* Items of ``LEAST_WORDS`` to ``MIN_WORDS`` - 1 words count where all their words stand together, in order.

Work grows with the postings that the texts' words name, not with the number of blocks. The index
is broadcast in parts of at most ``PART_CHARS`` characters of items, its bound; term statistics are those of the whole
benchmark, so that parts change no result.

* null or empty text: no passages; texts are queried whole, however long;
* null or empty items, and items under ``LEAST_WORDS`` words, name nothing and are skipped;
* words of marks alone ('+', '|', '-') are left out of items and texts alike;
* repeated items are reported each; ties at a threshold count;
* an empty benchmark contaminates nothing; an empty table gives no rows;
* other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import by_size

PART_CHARS = 64_000_000
SEGMENT_WORDS = 64  # the last of CLASSES
BLOCK_SEGMENTS = 8
K1, B = 1.2, 0.75
SHARE = 0.6
RUN_WORDS = 3
MIN_OVERLAP = 0.6
LEAST_WORDS, MIN_WORDS = 3, 8
# Length classes of windows, in words; share of the needed score that unposted terms may hold.
CLASSES = (8, 12, 16, 24, 32, 48, 64)
REST = 0.5
# Postings looked up at once.
POSTINGS = 1 << 21
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(word: str) -> str:
    """A word without the marks around it, in lower case."""
    return word.strip(MARKS).lower()


def answer_mark(text: str) -> re.Match | None:
    """The first answer mark, if a question stands before it."""
    mark = re.search(r"(?i)\b(?:answer|réponse|antwort|respuesta|a)\s*:", text)
    return mark if mark and mark.start() else None


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: cut at an answer mark, else before the last sentence."""
    mark = answer_mark(text)
    if mark:
        return text[:mark.start()], text[mark.end():]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    return (text[:ends[-1]], text[ends[-1]:]) if ends else (text, "")


def runs(terms: list[int], size: int = RUN_WORDS) -> list[tuple[int, ...]]:
    """The run of ``size`` words (or of all, if fewer) that starts at each word."""
    n = min(size, len(terms))
    return list(zip(*(terms[k:len(terms) - n + 1 + k] for k in range(n))))


def held(part: list[tuple[int, ...]], passage: Counter, size: int) -> int:
    """How many words of ``part`` lie in a run of the passage; each run of the passage serves once."""
    left, n, last = passage.copy(), 0, 0
    for k, run in enumerate(part):
        if left[run] > 0:
            left[run] -= 1
            n += k + size - max(k, last)
            last = k + size
    return n


def holds(doc_runs: list[tuple[int, ...]], part: list[int], reach: int | None = None) -> bool:
    """Whether a passage of ``reach`` words (the whole document if None) holds ``MIN_OVERLAP`` of ``part``."""
    own, size = runs(part), min(RUN_WORDS, len(part))
    wanted = Counter(own)
    at = [k for k, run in enumerate(doc_runs) if run in wanted]
    passage, usable, end = Counter(), 0, 0
    for k, start in enumerate(at):  # passages that start with a run of the part
        while end < len(at) and (reach is None or at[end] + size <= start + reach):
            run = doc_runs[at[end]]
            passage[run] += 1
            usable += passage[run] <= wanted[run]
            end += 1
        if usable * size >= MIN_OVERLAP * len(part) and held(own, passage, size) >= MIN_OVERLAP * len(part):
            return True
        if reach is None:
            return False
        run = doc_runs[start]
        usable -= passage[run] <= wanted[run]
        passage[run] -= 1
    return False


@dataclass
class Segment:
    words: list[str]
    must: list[str]  # the words whose full score is the measure
    share: float


@dataclass
class Item:
    name: int
    questions: list[list[str]]  # one of these must be held
    answer: list[str]  # and this, if any
    segments: list[Segment]
    exact: bool


def parsed(name: int, text: str | None) -> Item | None:
    """An item as it is searched; None if it has too few words."""
    words = [w for w in map(normal, (text or "").split()) if w]
    if len(words) < LEAST_WORDS:
        return None
    if len(words) < MIN_WORDS:
        return Item(name, [words], [], [Segment(words, words, 1.0)], True)
    question, answer = ([w for w in map(normal, part.split()) if w] for part in question_answer(text))
    questions, pieces, rest = [words], [words], None
    if answer_mark(text):
        questions = [question]
    else:
        if answer and len(question) >= MIN_WORDS:  # copies without the last sentence count, too
            questions.append(question)
            if len(answer) >= MIN_WORDS:
                pieces = [question, answer]
            else:
                rest = question
        answer = []
    segments = []
    for piece in pieces:
        parts = -(-len(piece) // SEGMENT_WORDS)
        for p in np.array_split(np.arange(len(piece)), parts):
            own = piece[p[0]:p[-1] + 1]
            segments.append(Segment(own, rest if rest and parts == 1 else own, SHARE))
    return Item(name, questions, answer, segments, False)


class Statistics:
    """Number and mean length of all segments of a benchmark, and in how many of them each word stands."""

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.n, self.words, self.df = 0, 0, Counter()
        for item in (parsed(*x) for x in items):
            for segment in item.segments if item else ():
                self.n += 1
                self.words += len(segment.words)
                self.df.update(set(segment.words))

    def idf(self, words: list[str]) -> np.ndarray:
        df = np.array([self.df[w] for w in words], float)
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


@dataclass
class Block:
    terms: np.ndarray  # sorted term numbers
    impact: np.ndarray  # terms x segments
    needed: np.ndarray  # the score a segment must reach
    item: np.ndarray  # the segments' items
    words: int  # the segments' length class


@dataclass
class Postings:
    """Of the blocks of one length class: by term, the blocks it is posted for with its largest impact there."""
    words: int
    begin: np.ndarray  # per term of the vocabulary, and one more
    block: np.ndarray
    most: np.ndarray
    gap: np.ndarray  # per block: what posted terms must bring at least


class Index:
    """BM25 index of some items of a benchmark, in blocks of segments of similar length."""

    def __init__(self, items: Iterable[tuple[int, str | None]], statistics: Statistics | None = None):
        items = list(items) if statistics is None else items
        stats = statistics or Statistics(items)
        self.vocabulary: dict[str, int] = {}
        number = lambda ws: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
        self.names, self.questions, self.answers, self.exact = [], [], [], []
        segments = []
        for item in filter(None, (parsed(*x) for x in items)):
            for part in item.segments:
                segments.append((len(part.words), len(self.names), part))
                number(part.words)
            self.names.append(item.name)
            self.questions.append([number(q) for q in item.questions])
            self.answers.append(number(item.answer))
            self.exact.append(item.exact)
        segments.sort(key=lambda x: x[0])
        mean = stats.words / max(stats.n, 1)
        self.blocks: list[Block] = []
        posted: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]] = {}
        # windows follow a segment's own length class, whatever it shares a block with
        classes = [(size, list(g)) for size, g in groupby(segments, lambda x: next(c for c in CLASSES if c >= x[0]))]
        for size, part in ((s, g[k:k + BLOCK_SEGMENTS]) for s, g in classes for k in range(0, len(g), BLOCK_SEGMENTS)):
            words = sorted({w for _, _, x in part for w in x.words}, key=self.vocabulary.__getitem__)
            terms, idf = np.array(number(words), np.int64), stats.idf(words)
            impact, needed = np.zeros((len(terms), len(part)), np.float32), np.zeros(len(part), np.float32)
            pivot, gap = np.zeros(impact.shape, bool), np.zeros(len(part))
            for j, (length, _, x) in enumerate(part):
                t, tf = np.unique(np.array(number(x.words), np.int64), return_counts=True)
                at = np.searchsorted(terms, t)
                impact[at, j] = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                needed[j] = impact[np.isin(terms, number(x.must)), j].sum() * x.share
                # the commonest terms stay unposted while they hold at most REST of what is needed
                order = at[np.argsort(idf[at], kind="stable")]
                left_out = np.cumsum(impact[order, j]) <= REST * needed[j]
                pivot[order[~left_out], j] = True
                gap[j] = needed[j] - impact[order[left_out], j].sum()
            most = np.where(pivot, impact, 0).max(1)
            use = most > 0
            posted.setdefault(size, []).append((terms[use], np.full(use.sum(), len(self.blocks)), most[use], gap.min()))
            self.blocks.append(Block(terms, impact, needed, np.array([i for _, i, _ in part]), size))
        self.postings = []
        for size, parts in posted.items():
            term, block, most = (np.concatenate(x) for x in list(zip(*parts))[:3])
            order = np.argsort(term, kind="stable")
            gap = np.full(len(self.blocks), np.inf)
            gap[[p[1][0] for p in parts if len(p[1])]] = [p[3] for p in parts if len(p[1])]
            begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary) + 1))])
            self.postings.append(Postings(size, begin, block[order], most[order], gap))

    def candidates(self, terms: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs whose passages reach the threshold; ``terms``: the texts end to end,
        the number after the vocabulary for words of no item; ``ends``: where each text ends."""
        found: set[tuple[int, int]] = set()
        for post in self.postings:
            window, block = self._near(post, terms)
            for k in np.flatnonzero(np.r_[True, window[1:] != window[:-1]][:len(window)]):
                lo = int(window[k]) * post.words
                hi = min(lo + 2 * post.words, len(terms))
                t = np.unique(terms[lo:hi])
                docs = range(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1)
                for b in block[k:np.searchsorted(window, window[k], "right")]:
                    b = self.blocks[b]
                    at = np.searchsorted(b.terms, t)
                    at[at == len(b.terms)] = 0
                    score = b.impact[at[b.terms[at] == t]].sum(0)
                    for j in np.flatnonzero(score >= b.needed - 1e-3):
                        found.update((d, int(b.item[j])) for d in docs)
        return found

    @staticmethod
    def _near(post: Postings, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and blocks, in window order, whose posted maxima reach the block's gap."""
        size = np.diff(post.begin)
        place = np.flatnonzero(size[terms] > 0)
        stretch, n = place // post.words, len(size)
        # a window is two stretches: every distinct term of either counts once
        key = _distinct(stretch * n + terms[place])
        key = _distinct(np.concatenate([key, key[key >= n] - n]))
        window, term = key // n, key % n
        cost = np.cumsum(size[term])
        out, lo = [], 0
        while lo < len(key):  # whole windows, about POSTINGS postings at a time
            hi = int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + POSTINGS, "right"))
            hi = len(key) if hi >= len(key) else int(np.searchsorted(window, window[max(hi, lo)], "left"))
            if hi <= lo:
                hi = int(np.searchsorted(window, window[lo], "right"))
            t, times = term[lo:hi], size[term[lo:hi]]
            spot = np.arange(times.sum()) + np.repeat(post.begin[t] - np.cumsum(times) + times, times)
            pair = np.repeat(window[lo:hi], times) * len(post.gap) + post.block[spot]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][:len(pair)])
            if len(first):
                bound = np.add.reduceat(post.most[spot[order]].astype(np.float64), first)
                pair = pair[first]
                out.append(pair[bound >= post.gap[pair % len(post.gap)] - 1e-3])
            lo = hi
        pair = np.concatenate(out) if out else np.empty(0, np.int64)
        return pair // len(post.gap), pair % len(post.gap)

    def held_by(self, doc_runs: dict[int, list], terms: list[int], item: int) -> bool:
        """Whether the document holds the item; ``doc_runs`` keeps its runs by size."""
        def of_size(part: list[int]) -> list:
            n = min(RUN_WORDS, len(part))
            if n not in doc_runs:
                doc_runs[n] = runs(terms, n) if len(terms) >= n else []
            return doc_runs[n]

        if self.exact[item]:
            whole = self.questions[item][0]
            key = -len(whole)
            if key not in doc_runs:
                doc_runs[key] = set(runs(terms, len(whole))) if len(terms) >= len(whole) else set()
            return tuple(whole) in doc_runs[key]
        answer = self.answers[item]
        return (any(holds(of_size(part), part, 2 * len(part)) for part in self.questions[item])
                and (not answer or holds(of_size(answer), answer)))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][:len(x)]]


class _Numbers(dict):
    """Word -> term number in the index, the number after the last for words of no item, -1 for mere marks; bounded
    memory."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        term = normal(word)
        self[word] = n = self.vocabulary.get(term, len(self.vocabulary)) if term else -1
        return n


def with_items(docs: DataFrame, benchmark: DataFrame, name: str = "items", text: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the sorted ids of the test items each document holds in the new column ``name``; no shuffle."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    statistics = Statistics(map(tuple, items.toLocalIterator())) if parts > 1 else None  # a vocabulary, no texts
    names = [f"own_{i}" for i in range(len(docs.columns))]  # any column names, whatever they clash with
    at, out = docs.columns.index(text), docs.toDF(*names).withColumn("items", F.array().cast("array<long>"))
    for p in range(parts):  # one bounded part of the index at a time
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in chosen.orderBy("i", "t").collect()], statistics))
        out = out.mapInArrow(_scanner(index, at), out.schema)
    return out.toDF(*docs.columns, name)


def _scanner(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        numbers = _Numbers(ix.vocabulary)
        for b in by_size(batches, at):
            lists = pc.utf8_split_whitespace(pc.fill_null(b.column(at).cast(pa.large_string()), ""))
            coded = lists.flatten().dictionary_encode()
            table = np.array([numbers[w] for w in coded.dictionary.to_pylist()], np.int64)
            terms = table[coded.indices.to_numpy()] if len(table) else np.empty(0, np.int64)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            words = terms >= 0  # free-standing marks are no words, as in the items
            starts, terms = np.concatenate([[0], np.cumsum(words)])[starts], terms[words]
            items = b.column("items").to_pylist()
            cache: tuple[int, dict, list] = (-1, {}, [])
            for d, i in sorted(ix.candidates(terms, starts[1:])) if len(terms) else ():
                if d >= b.num_rows or starts[d] == starts[d + 1]:
                    continue
                if cache[0] != d:
                    cache = (d, {}, terms[starts[d]:starts[d + 1]].tolist())
                if ix.held_by(cache[1], cache[2], i):
                    items[d].append(ix.names[i])
            found = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=b.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, contaminated, n_items, items)`` for every document."""
    found = with_items(docs.select(id_col, text), benchmark, "items", text, item_col, item_text)
    return found.select(id_col, (F.size("items") > 0).alias("contaminated"),
                        F.size("items").cast("long").alias("n_items"),
                        F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))
