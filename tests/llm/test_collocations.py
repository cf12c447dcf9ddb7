"""Collocations against SQL and against plain counting; quotient filters against dictionaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import collocations as C
from tickframe.llm.collocations import collocations
from tickframe.llm.queries import ORACLE_SQL, QUERIES
from tickframe.llm.quotient_filter import by_bucket, from_filter, merged, permute, restore, summed
from tests.conftest import SF


def plain(rows, min_count, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i:i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = {}
    held = Counter()
    for p, a in f.items():
        if len(p) > 2 and a >= min_count:
            cuts = [(2000000 * a // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])])
                    for k in range(1, len(p) - 1)]
            out[p] = (a, *min(cuts))
            for size in range(2, len(p) - 1):
                for i in range(1, len(p) - size + 1):
                    held[(p[0], *p[i:i + size])] = max(held[(p[0], *p[i:i + size])], a)
    rows = [(p[0], -s, -a, " ".join(p[1:]).encode(), left, r) for p, (a, s, _, left, r) in out.items()
            if 100 * held[p] < 80 * a or not held[p]]
    got, ranks = [], Counter()
    for lang, s, a, phrase, left, r in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], phrase.decode(), -a, left, r, total[lang], -s))
    return sorted(got)


def found(spark, rows, **options):
    df = collocations(spark.createDataFrame(rows, "lang string, text string"), **options)
    return sorted(map(tuple, df.collect()))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_collocations"])
    got = QUERIES["op12_collocations"](spark, SF)
    assert got.columns == want.columns
    rows = want.fetchall()
    assert len(rows) > 200 and sorted(map(tuple, got.collect())) == sorted(rows)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "x", "..", "a-b", "\x1f", "日本"] + [f"w{i}" for i in range(30)]
    weights = [9, 8, 6, 6, 5, 3, 3] + [1] * (len(words) - 7)
    text = lambda: "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for w in rnd.choices(
        words, weights, k=rnd.choice([0, 1, 5, 60, 200])))
    rows = [(rnd.choice(["en", "de", None]), text()) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("fr", " . , "), ("en", "new york city " * 400), ("x", "the of"),
                   ("und", "a a a a a a"), ("en", "NEW YORK\r\nCITY; new york")]


@pytest.mark.parametrize("dense", [True, False])
def test_against_plain_counting(spark, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(C, "DENSE", 3)
    monkeypatch.setattr(C, "ENTRIES", 500)
    monkeypatch.setattr(C, "WORDS", 50)
    monkeypatch.setattr(C, "REMEMBERED", 20)
    monkeypatch.setattr(C, "BUCKET_WORDS", 64)
    rows = corpus(1)
    assert found(spark, rows, min_count=4) == plain(rows, 4)
    assert found(spark, rows, min_count=30, top=7) == plain(rows, 30, 7)


def test_word_ids_that_collide_are_drawn_anew(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "a b c"), ("de", "a b")], "lang string, text string")
    words, seed = C.word_counts(texts)
    assert seed == 0 and words.count() == 5
    assert len({r.id for r in words.collect()}) == 5
    real = C._word_counts

    def first_round_collides(seed):
        if seed:
            return real(seed)
        def run(batches):
            for b in real(seed)(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([7] * b.num_rows, pa.int64()),
                                                  b.column(3)], names=b.schema.names)
        return run
    monkeypatch.setattr(C, "_word_counts", first_round_collides)
    words, seed = C.word_counts(texts)
    assert seed == 1 and len({r.id for r in words.collect()}) == 5


def test_empty_tables_and_clashing_columns(spark):
    rows = corpus(2, 30)
    docs = spark.createDataFrame([(lang, text, 1, 2, 3) for lang, text in rows],
                                 "lang string, text string, w1 int, n int, word string")
    assert sorted(map(tuple, collocations(docs, min_count=5).collect())) == plain(rows, 5)
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs, min_count=10**9).collect() == []


@pytest.mark.parametrize("widths", [(21, 21), (21, 42), (42, 42), (64, 64), (64, 64, 64, 64)])
def test_filters_lose_nothing(widths):
    rng = np.random.default_rng(len(widths) + widths[0])
    draw = lambda n: [rng.integers(0, 1 << min(w, 12), n, dtype=np.uint64) for w in widths]
    shards = [draw(n) for n in (0, 1, 40, 3000)]
    shards.append([np.concatenate([x[:1]] * 700) for x in shards[-1]])  # a count beyond one byte
    want = Counter(t for limbs in shards for t in zip(*[x.tolist() for x in limbs]))
    buckets = {}
    for limbs in shards:
        mixed = permute(limbs, widths)
        assert all((a == b).all() for a, b in zip(restore(mixed, widths), limbs))
        entries, counts = summed(mixed, widths)
        for bucket, data in by_bucket(entries, counts, widths, 5):
            buckets.setdefault(bucket, []).append(from_filter(data, widths, bucket, 5))
    got = Counter()
    for parts in buckets.values():
        limbs, counts = merged(parts, widths)
        assert len(parts) == 1 or (np.diff(limbs[0].astype(np.float64)) >= 0).all()
        for t, c in zip(zip(*[x.tolist() for x in restore(limbs, widths)]), counts.tolist()):
            got[t] += c
    assert got == want and len(buckets) == 32
