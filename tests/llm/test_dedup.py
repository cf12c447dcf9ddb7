"""Embedding and document near-duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm.common import smallest_reachable
from tickframe.llm import embedding_dedup as D
from tickframe.llm.embedding_dedup import embedding_groups
from tickframe.llm.lattice import LatticeHash, decode_e8, minimal_vectors
from tickframe.llm.minhash import _compare, near_duplicates, one_of_each_group, sketch
from tickframe.llm.shingles import shingle_set


class Sets:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 80)] + [(300, 300)]
    edges += [(rnd.randint(400, 600), rnd.randint(400, 600)) for _ in range(90)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = dict(smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.root(x) for x in nodes}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).collect() == []


def test_e8_decoding_finds_the_nearest_point():
    x = np.random.default_rng(0).normal(0, 2, (300, 8))
    point, steps = decode_e8(x), minimal_vectors()
    assert len(steps) == 240 and (point.sum(1) % 4 == 0).all()
    assert (((point % 2) == point[:, :1] % 2).all(1)).all()  # all whole or all half coordinates
    own = ((2 * x - point) ** 2).sum(1)
    other = ((2 * x[:, None] - (point[:, None] + steps[None])) ** 2).sum(2).min(1)
    assert (own <= other + 1e-9).all()


def test_lattice_recall_at_the_threshold():
    rng, n, cos = np.random.default_rng(1), 2000, 0.93
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b, axis=1)[:, None]
    h = LatticeHash(64, D.TABLES, D.BLOCKS, D.PROBES, D.SCALE, D.SEED)
    (ha, na), (hb, nb) = h.keys(a), h.keys(b)
    met = (ha == hb) | (na == hb[:, :, None]).any(2) | (nb == ha[:, :, None]).any(2)
    assert met.any(1).mean() > 0.985


def brute_vectors(rows, threshold):
    sets, links, usable = Sets(), [0] * len(rows), []
    for _, v, label in rows:
        ok = label is not None and v and not any(c is None or not np.isfinite(c) for c in v) and any(v)
        usable.append(ok)
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    sets.join(rows[i][0], rows[j][0])
    return sorted((r[0], n, sets.root(r[0]), sets.root(r[0]) == r[0]) for r, n in zip(rows, links))


def test_vectors_against_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(12):
        centre = rng.standard_normal(16)
        for _ in range(12):
            noise = rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])
            rows.append((len(rows), ((centre + noise) * rng.choice([1.0, 3.0])).tolist(), k % 3))
    big = rng.standard_normal(16)
    rows += [(len(rows) + i, (big + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(200)]  # a crowded cell
    odd = [(None, 1), ([], 1), ([0.0] * 16, 1), ([1.0, None] * 8, 1), ([float("nan")] * 16, 1),
           ([float("inf")] * 16, 1), ([1.0] * 16, None), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1.0] * 16, 1)]
    rows += [(len(rows) + i, v, label) for i, (v, label) in enumerate(odd)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, key string, home int")
    got = sorted(tuple(r) for r in embedding_groups(df).collect())
    want = brute_vectors(rows, 0.93)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert embedding_groups(df.limit(0)).collect() == []


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 5000):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        s = sketch(a, 160)
        assert (s != np.iinfo(np.uint64).max).all() and (s == sketch(a[::-1].copy(), 160)).all()
    common, own = rng.integers(1, 1 << 62, 800).astype(np.uint64), rng.integers(1, 1 << 62, 200).astype(np.uint64)
    a, b = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
    assert abs((sketch(a, 2000) == sketch(b, 2000)).mean() - 0.8) < 0.05


def words_of(text):
    return (text or "").encode().lower().split()


def brute_docs(rows, size, percent):
    sets, shingles = Sets(), {}
    for i, text in rows:
        w = words_of(text)
        shingles[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    ids = sorted(shingles)
    for i in ids:
        for j in ids:
            if j < i and shingles[i] and shingles[j]:
                both = len(shingles[i] & shingles[j])
                if 100 * both >= percent * (len(shingles[i]) + len(shingles[j]) - both):
                    sets.join(i, j)
    return sorted((i, len(shingles[i]), sets.root(i), sets.root(i) == i) for i in ids)


def corpus():
    rnd, rows = random.Random(9), []
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    for n in (3, 40, 40, 150, 400):
        base = [word() for _ in range(n)]
        for _ in range(25):  # chains of edits: neighbours are near, ends are not
            if rnd.random() < 0.8:
                base = list(base)
                for _ in range(max(1, n // 50)):
                    base[rnd.randrange(n)] = word()
            rows.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in base))
    rows += ["", None, " \n\t ", "one", "ONE", "one\x85two", "one two", "One\x0btwo", "x " * 20000, "x " * 9]
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_documents_against_brute_force(spark, size):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1, [1]) for i, t in rows],
                               "doc_id long, text string, key string, n int, bands array<int>")
    got = sorted(tuple(r) for r in near_duplicates(df, words=size).collect())
    assert [(g[0], g[2], g[1], g[3]) for g in got] == [(w[0], w[2], w[1], w[3]) for w in brute_docs(rows, size, 80)] or \
        got == brute_docs(rows, size, 80)
    assert near_duplicates(df.limit(0), words=size).collect() == []
    kept = sorted(r.doc_id for r in one_of_each_group(df, words=size).collect())
    assert kept == [g[0] for g in got if g[3]]


def test_repeated_ids_keep_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (None, "x")],
                               "doc_id long, text string")
    assert sorted((r.doc_id or -1 for r in one_of_each_group(df).collect())) == [-1, -1, 1]


def test_repeated_ids_with_other_vectors(spark):
    rng = np.random.default_rng(12)
    a, b = rng.normal(0, 1, (2, 16))
    near = lambda v: (v + rng.normal(0, 0.02, 16)).tolist()
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, near(a), 0), (3, near(b), 0), (1, a.tolist(), 0),
            (7, rng.normal(0, 1, 16).tolist(), 0), (1 << 62, near(b), 0), (-(1 << 63), rng.normal(0, 1, 16).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # links by row; the component of a row is that of its own vector
    parts = Sets()
    for i in range(len(rows)):
        for j in range(i):
            x, y = np.array(rows[i][1]), np.array(rows[j][1])
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                parts.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        least[parts.root(i)] = min(r[0], least.get(parts.root(i), r[0]))
    want = sorted((r[0], n, least[parts.root(i)], r[0] == least[parts.root(i)]) for i, (r, n) in enumerate(zip(
        rows, [sum(1 for j, s in enumerate(rows) if j != i and np.dot(r[1], s[1]) / np.linalg.norm(r[1]) / np.linalg.norm(
            s[1]) >= 0.93) for i, r in enumerate(rows)])))
    assert sorted(map(tuple, embedding_groups(df).collect())) == want


def test_repeated_ids_with_other_texts(spark):
    rnd = random.Random(6)
    text = lambda: [f"w{rnd.randrange(4000)}" for _ in range(90)]
    one, two = text(), text()
    near = lambda t: [*t[:-1], "other"]
    rows = [(1, one), (1, two), (2, near(two)), (3, near(one)), (1, one), (5, text()), (5, near(two)), (6, []), (6, []),
            (None, text()), (1 << 62, text())]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, bool(r.kept)) for r in near_duplicates(df).collect()))
    want = [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False),
            (5, 5, True), (6, 6, True), (6, 6, True), (1 << 62, 1 << 62, True)]
    assert got == want
    left = sorted((r.doc_id or 0, r.text) for r in one_of_each_group(df).collect())
    assert left == sorted((i or 0, " ".join(t)) for i, t in [rows[k] for k in (0, 1, 5, 7, 8, 9, 10)])


def test_block_comparison_equals_pairwise():
    rnd = random.Random(1)
    base = [rnd.random() for _ in range(100)]
    texts = [" ".join(str(x) if rnd.random() < 0.93 else str(rnd.random()) for x in base).encode() for _ in range(60)]
    sets = [shingle_set(t, 1).astype(np.int64) for t in texts]
    want, got = Sets(), Sets()
    for i in range(60):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    for a, b in _compare(np.arange(60), np.arange(60), sets, 80):
        got.join(a, b)
    assert [want.root(i) for i in range(60)] == [got.root(i) for i in range(60)]


def test_registered_queries_return_every_row(spark):
    from tests.conftest import SF_SMALL
    from tickframe.llm.queries import QUERIES

    vectors = QUERIES["op4_embedding_dedup"](spark, SF_SMALL)
    assert vectors.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert vectors.count() == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = QUERIES["op10_minhash_dedup"](spark, SF_SMALL)
    want = brute_docs([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert got.filter(F.col("kept") & (F.col("doc_id") != F.col("component_id"))).isEmpty()
