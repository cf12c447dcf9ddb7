"""Token counts, token files, packing: against the tokenizers library."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickframe.llm.common import shared_folder
from tickframe.llm import packing as P
from tickframe.llm.packing import pack_documents, pack_shard
from tickframe.llm.pretokens import TextIds
from tickframe.llm.token_counts import count_tokens, whole_tokens
from tickframe.llm.token_files import TokenFile, read_token_files, write_token_files
from tests.conftest import SF, SF_SMALL

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "  a  b ", "\n\n\nx\n", "it's we're <|endoftext|> end", "日本語 né ²½ ſİ", "a\tb\r\nc   d\x0b\x85e",
         "word " * 5000, "x" * 3000, None, "Hello, world. Hello, world.", "Hello, world. Hello, world."]


def library(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "src", i * 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, t double")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_strings_encode_as_the_library(path):
    rnd, ids, one = random.Random(5), TextIds(path), library(path)
    texts = ["".join(rnd.choice("  \n\n\t\rab AB'sre,.!1²½éß\xa0\x1c_日") for _ in range(rnd.randint(0, 16)))
             for _ in range(3000)]
    assert [x.tolist() for x in ids.batch(texts)] == [one(t) for t in texts]


def test_whole_tokens_are_proven():
    whole, one = whole_tokens(BYTE), library(BYTE)
    assert " the" in whole and len(whole) > 40_000
    assert all(len(one(t)) == 1 for t in random.Random(1).sample(sorted(whole), 500))


def test_counts(odd_docs):
    one = library(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(odd_docs, BYTE).collect()}
    assert got == {i: (len((t or "").encode()), len(one(t))) for i, t in enumerate(TEXTS)}
    assert count_tokens(odd_docs.limit(0), BYTE).collect() == []


def test_token_files_round_trip(spark, odd_docs):
    folder = "file://" + shared_folder(spark, "token-test").removeprefix("file:").replace("//", "/")
    shards = write_token_files(odd_docs.repartition(3), folder, BYTE, seq_len=64)
    one, at = library(BYTE), 0
    rows = sorted(read_token_files(spark, shards, folder).collect())
    assert [r.doc_id for r in rows] == list(range(len(TEXTS)))
    for r, t in zip(rows, TEXTS):
        ids = [*one(t), 0]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    stream = [i for t in TEXTS for i in [*one(t), 0]]
    read = []
    for s in sorted(shards.collect()):
        f = TokenFile(s.file)
        ids, mask = f.sequence(0)
        assert len(ids) == 64 and not ids.flags.owndata  # a view into the mapped file
        assert mask[:min(64, s.n_tokens)].all()
        read += np.concatenate(list(f.tokens())).tolist()
    assert read == stream


def test_token_files_of_an_empty_table(spark, odd_docs):
    folder = "file://" + shared_folder(spark, "token-test").removeprefix("file:").replace("//", "/")
    shards = write_token_files(odd_docs.limit(0), folder, BYTE)
    assert read_token_files(spark, shards, folder).collect() == []


def check_pieces(rows, texts, window=2048):
    one, pieces, sequences = library(WORD), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, ps in pieces.items():
        ids, at = np.array([*one(texts[i]), 1], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    used = sum(r.length for r in rows)
    return 1 - used / (window * len(sequences)) if sequences else 0.0


def test_packing(spark, odd_docs):
    rows = pack_documents(odd_docs, WORD).collect()
    check_pieces(rows, dict(enumerate(TEXTS)))
    assert pack_documents(odd_docs.limit(0), WORD).collect() == []


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_pieces(pack_documents(docs, WORD).collect(), texts) < 0.02


def test_neighbours_share_words():
    a, b = np.arange(100, 140), np.arange(500, 540)
    ids = [a, b, a + 0, b + 0, np.arange(900, 925)]
    windows = list(pack_shard(np.concatenate(ids).astype("<u2"), np.cumsum(list(map(len, ids))), window=80))
    assert {frozenset(d for d, *_ in w) for w in windows[:2]} == {frozenset({0, 2}), frozenset({1, 3})}


def plain_bm25(ids):
    """BM25 of every document to all distinct ids of every other, straight from the formula."""
    n, mean = len(ids), np.mean([len(x) for x in ids])
    df = Counter(t for x in ids for t in set(x.tolist()))
    tf = [Counter(x.tolist()) for x in ids]
    out = np.zeros((n, n))
    for q in range(n):
        for d in range(n):
            k = P.K1 * (1 - P.B + P.B * len(ids[d]) / mean)
            out[q, d] = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[d][t] * (P.K1 + 1) / (tf[d][t] + k)
                            for t in tf[q] if t in tf[d])
    return out


@pytest.mark.parametrize("common,dense", [(2, 10**6), (32, 10**6), (10**9, 10**6), (32, 1), (10**9, 200)])
def test_scores_equal_plain_bm25_over_all_terms(monkeypatch, common, dense):
    monkeypatch.setattr(P, "COMMON", common)
    monkeypatch.setattr(P, "DENSE", dense)
    rng = np.random.default_rng(7)
    ids = [np.minimum(rng.zipf(1.3, rng.integers(1, 120)), 60_000).astype("<u2") for _ in range(60)]
    ids += [ids[0], np.array([65_000], "<u2"), np.array([], "<u2")]
    index = P.ShardIndex(np.concatenate(ids), np.cumsum(list(map(len, ids))))
    want = plain_bm25(ids)
    unused = np.ones(len(ids), bool)
    unused[:40] = False
    assert np.allclose(index.scores(np.arange(len(ids))), want, rtol=1e-4, atol=1e-5)
    index.let_go(unused)
    left = np.flatnonzero(unused)
    got = index.scores(left)[:, left]
    assert np.allclose(got, want[np.ix_(left, left)], rtol=1e-4, atol=1e-5)
    for row, wanted in zip(got, want[np.ix_(left, left)]):  # the order too, up to rounding
        assert (np.diff(wanted[np.argsort(-row, kind="stable")]) <= 1e-4 * wanted.max(initial=1)).all()


def test_windows_take_the_best_unused_neighbours():
    rng = np.random.default_rng(9)
    ids = [np.minimum(rng.zipf(1.2, n), 5000).astype("<u2") for n in rng.integers(1, 90, 80)]
    score, left = plain_bm25(ids), np.array([len(x) for x in ids])
    whole = left.copy()
    for pieces in P.pack_shard(np.concatenate(ids), np.cumsum(left), window=100):
        room, seed = 100, pieces[0][0]
        assert seed == max(np.flatnonzero(left), key=lambda d: (whole[d], -d))
        for d, _, n in pieces[1:]:
            room = 100 - sum(k for e, _, k in pieces[:pieces.index((d, _, n))])
            taken = {e for e, *_ in pieces[:pieces.index((d, _, n))]}
            better = [e for e in np.flatnonzero(left) if e not in taken and left[e] <= room
                      and score[seed, e] > score[seed, d] + 1e-4]
            assert not better or n < left[d]  # nothing better would have fitted, unless the window was topped up
        for d, _, n in pieces:
            left[d] -= n
    assert not left.any()


def test_registered_queries(spark):
    from tickframe.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    one = library(BYTE)
    counts = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, SF_SMALL).collect()}
    assert {i: r.n_tokens for i, r in counts.items()} == {i: len(one(t)) for i, t in docs.items()}
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counts.values())
    files = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, SF_SMALL).collect()}
    assert all(files[i].n_tokens == counts[i].n_tokens + 1 for i in docs)
    check_pieces(QUERIES["op6_packing"](spark, SF_SMALL).filter(F.col("doc_id") >= 0).collect(), docs)


def test_new_ascii_words_are_merged_without_translation():
    """Letters stand for themselves in the byte alphabet; other pre-tokens still go through it."""
    import public_tokenizers

    from tickframe.llm.pretokens import Splitter

    class Untouched(dict):
        def __getitem__(self, k):
            raise AssertionError("translated")

    splitter = Splitter(public_tokenizers.path("word_bpe_49k.json"))
    want = [splitter.tokenizer.encode(w, add_special_tokens=False).ids for w in ("thanha", "über", "!?", "9")]
    assert [splitter.merged(w) for w in ("thanha", "über", "!?", "9")] == want
    splitter.symbols = Untouched()
    assert splitter.merged("thanha") == want[0]
