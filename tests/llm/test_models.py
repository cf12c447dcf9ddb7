"""Quality classifier, decontamination and language model: held-out accuracy and brute force."""

import collections
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import language_model as L
from tickframe.llm.decontaminate import Index, Statistics, contamination, question_answer, with_items
from tickframe.llm.quality import DIM, Network, WIDTH, pool, quality_scores, token_buckets, with_quality
from tickframe.llm.queries import QUERIES
from tests.conftest import SF, SF_SMALL


def part(i, n):
    return zlib.crc32(str(i).encode()) % n


# ------------------------------------------------------------------ quality

def test_quality_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (part(i, 4) == 2) and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.93


def test_held_out_labels_never_change_a_score(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(quality_scores(docs, labels).collect())
    assert a == sorted(quality_scores(docs, flipped).collect())


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 30000, "c"), (None, "x y", "d")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = with_quality(docs, labels, "q")
    assert out.columns == ["doc_id", "text", "score", "q"] and [r.q for r in out.collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, None)], "doc_id long, quality int")
    assert all(0.5 < r.score < 1 for r in quality_scores(docs, one).collect())
    assert quality_scores(docs.limit(0), one).collect() == []


def test_pooling_is_the_mean_of_token_vectors():
    vectors = np.random.default_rng(0).standard_normal((1 << 14, DIM)).astype(np.float32)
    texts = pa.array(["One two!! two", None, " \n", "ALL CAPS"])
    tokens, sizes = token_buckets(texts)
    assert sizes.tolist() == [5, 0, 0, 4]  # One two!! two: three cores, a case, a mark
    x = pool(texts, vectors)
    assert x.shape == (4, WIDTH) and not x[1].any() and not x[2].any()
    assert np.allclose(x[0, :DIM], vectors[tokens[:5]].mean(0), atol=1e-5)


def test_network_calibration():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, WIDTH))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    fresh = rng.standard_normal((8000, WIDTH))
    s, y = Network(x, y).score(fresh), (rng.random(8000) < 1 / (1 + np.exp(-2 * fresh[:, 0]))).astype(float)
    for lo, hi in ((0.1, 0.4), (0.4, 0.6), (0.6, 0.9)):
        inside = (s >= lo) & (s < hi)
        assert abs(s[inside].mean() - y[inside].mean()) < 0.12


# ------------------------------------------------------------ decontamination

def test_documents_with_items(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: sorted(k for k, t in items.items() if t in text) for i, text in docs.items()}
    got = {r.doc_id: r for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert {i: r.items for i, r in got.items()} == {i: ",".join(map(str, v)) for i, v in want.items()}
    assert all(r.contaminated == (r.n_items > 0) == bool(want[i]) for i, r in got.items())


def test_skipping_loses_no_segment():
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % int(rng.zipf(1.3) % 3000)
    items = [(i, " ".join(word() for _ in range(rng.integers(8, 150)))) for i in range(120)]
    ix = Index(items)
    texts = []
    for _ in range(150):
        ws = [word() for _ in range(rng.integers(0, 300))]
        if rng.random() < 0.5:
            item = items[rng.integers(0, 120)][1].split()
            cut = rng.integers(len(item) // 2, len(item) + 1)
            at = rng.integers(0, len(ws) + 1)
            ws[at:at] = item[:cut]
        texts.append([ix.vocabulary.get(w, len(ix.vocabulary)) for w in ws])
    ends = np.cumsum([len(t) for t in texts])
    terms = np.array([x for t in texts for x in t], np.int64)
    found = ix.candidates(terms, ends)
    exact = set()
    for b in ix.blocks:  # every window of every block, without bounds
        for lo in range(0, len(terms), b.words):
            hi = min(lo + 2 * b.words, len(terms))
            held = np.isin(b.terms, terms[lo:hi])
            for j in np.flatnonzero(b.impact[held].sum(0) >= b.needed):
                exact |= {(d, int(b.item[j])) for d, e in enumerate(ends)
                          if e > lo and e - len(texts[d]) < hi and len(texts[d])}
    assert exact <= found


def test_decontamination_edge_cases(spark):
    q = "Which of the seven listed rivers flows through the longest mountain valley of the north"
    bench = spark.createDataFrame([(1, f"{q}? Answer: the blue river delta", 0), (2, None, 0), (3, "", 0), (4, "too short", 0),
                                   (1, f"{q}? Answer: the blue river delta", 0)], "item_id long, text string, items int")
    docs = spark.createDataFrame(
        [(1, f"lead in {q.upper()}! the blue river delta, and on", 1), (2, f"{q}? it says something else", 1), (3, None, 1),
         (4, "", 1), (5, "the blue river delta", 1), (6, "pad word " * 20000 + q + " the blue river delta", 1), (6, None, 1)],
        "doc_id long, text string, items int")
    got = sorted((r.doc_id, r.contaminated, r.n_items) for r in contamination(docs, bench).collect())
    assert got == [(1, True, 2), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 0), (6, False, 0), (6, True, 2)]
    assert with_items(docs, bench, "found").columns == [*docs.columns, "found"]
    assert not any(r.contaminated for r in contamination(docs, bench.limit(0)).collect())
    assert contamination(docs.limit(0), bench).collect() == []


def test_near_and_cut_copies_are_found(spark):
    """Copies with one changed word in eight, without their last sentence, or both; unrelated and reordered words are not."""
    rng = np.random.default_rng(11)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    pad = " ".join(f"pad{k}" for k in rng.integers(0, 50, 200))
    rows, want = [], {}
    for i, text in items.items():
        words, rest = text.split(), question_answer(text)[0].split()
        changed = lambda ws: [f"new{k}" if k % 8 == 5 else w for k, w in enumerate(ws)]
        copies = [(words, True), (changed(words), True), (words[:-1] + ["otherwise"], True),
                  (list(rng.permutation(words)), False)]
        if len(rest) >= 8:
            copies += [(rest, True), (changed(rest), True)]
        for ws, found in copies:
            want[len(rows)] = {i} if found else set()
            rows.append((len(rows), f"{pad} {' '.join(ws)} {pad}"))
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: {int(x) for x in r.items.split(",") if x} for r in got} == want


def test_free_standing_marks_break_no_run(spark):
    exact = ["If x + y = 5 and x - y = 1 , then 2 * x = 6 and y = 2",
             "| left | right | upper | lower | \n | one | two | three | four |"]
    bench = spark.createDataFrame(list(enumerate(exact)), "item_id long, text string")
    docs = spark.createDataFrame(
        [(0, f"- + = lead in {exact[0]} & so on"), (1, exact[1]), (2, "+ - = | * &"), (3, "| " * 500 + exact[1] + " *" * 500),
         (4, f"{exact[0]} | {exact[1]}")], "doc_id long, text string")
    got = {r.doc_id: r.items for r in contamination(docs, bench).collect()}
    assert got == {0: "0", 1: "1", 2: "", 3: "1", 4: "0,1"}


def test_large_benchmarks_run_in_parts(spark, monkeypatch):
    import tickframe.llm.decontaminate as D

    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(contamination(docs, bench).collect())
    monkeypatch.setattr(D, "PART_CHARS", 900)
    assert sorted(contamination(docs, bench).collect()) == one and any(r.contaminated for r in one)


def test_parts_retrieve_alike():
    rng = np.random.default_rng(15)
    word = lambda: "w%d" % int(rng.zipf(1.2) % 2000)
    items = [(i, " ".join(word() for _ in range(rng.integers(3, 90)))) for i in range(200)]
    texts = [[w if rng.random() < 0.85 else word() for w in items[rng.integers(0, 200)][1].split()] for _ in range(150)]
    ends = np.cumsum([len(t) for t in texts])

    def found(ix):
        terms = np.array([ix.vocabulary.get(w, len(ix.vocabulary)) for t in texts for w in t], np.int64)
        return {(d, ix.names[i]) for d, i in ix.candidates(terms, ends)}
    whole, all_of = found(Index(items)), Statistics(items)
    for parts in (2, 7):
        each = [found(Index([x for x in items if x[0] % parts == p], all_of)) for p in range(parts)]
        assert set().union(*each) == whole and len(whole) > 150


def test_short_items_match_whole_and_in_order(spark):
    bench = spark.createDataFrame([(1, "seven blue rivers"), (2, "Deep, in the hills!"), (3, "two words"), (4, "x y x y x")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "the Seven blue rivers run deep in the hills"), (2, "blue seven rivers"),
                                  (3, "two words"), (4, "seven big blue rivers, deep in hills"), (5, "y x y x y x y"),
                                  (6, "pad " * 3000 + "seven blue rivers " + "pad " * 3000), (7, "x y x"), (8, "")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.items for r in contamination(docs, bench).collect()}
    assert got == {1: "1,2", 2: "", 3: "", 4: "", 5: "4", 6: "1", 7: "", 8: ""}


def test_question_and_answer():
    assert question_answer("What is it? It is a test.") == ("What is it? ", "It is a test.")
    assert question_answer("Q text Answer: five") == ("Q text ", " five")
    assert question_answer("one sentence only") == ("one sentence only", "")


# ------------------------------------------------------------- language model

TEXTS = ["a b a b a b c", "A B a", "", None, "  \n", "c d e unseen", "a b a b a b c", "x " * 3000, "b\x0ba\x85b é"]


def check_scores(rows, texts):
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in words.items() if part(i, 5) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (part(r.doc_id, 5) == 1, len(ws), n)
        assert r.n_known == sum(w in count for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0


def test_scores_of_small_tables(spark):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in texts.items()], "doc_id long, text string, w string, chunk int")
    check_scores(L.score_documents(docs).collect(), texts)
    assert L.score_documents(docs.limit(0)).collect() == []
    alone = docs.filter("doc_id = %d" % next(i for i in range(100) if part(i, 5) == 1 and i < len(TEXTS)))
    assert alone.count() == 0 or all(r.train_tokens == 0 and r.score == 0 for r in L.score_documents(alone).collect())


def test_model_beats_the_base_on_held_out_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_language_model"](spark, SF).collect()
    check_scores(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_previous_word_is_a_context_of_its_own(spark):
    """Each word names the next; hashed classes mix the words, so that the next one stays uncertain."""
    rng = np.random.default_rng(4)
    n = 300
    texts = {i: " ".join(f"left{k} right{k}" for k in rng.integers(0, n, 120)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = L.score_documents(docs).collect()
    check_scores(rows, texts)
    held = [r for r in rows if r.held_out]
    # a left word costs log10(300), its right word next to nothing
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -(math.log10(n) / 2 + 0.25)


def test_own_seats_are_removed_before_seating():
    """A pair that owns all tables of its context and word is seated as if it were alone there."""
    c, full = np.full(20000, 8), lambda v: np.full(20000, v)
    shared = L.Totals(np.zeros(0), np.zeros(0), 1000, 400, 50, 0.6, 0.4)
    a = L.seat_pairs(c, full(8), full(8), full(8), full(1), shared, L.Draws(1, np.arange(20000))).mean()
    less = L.Totals(np.zeros(0), np.zeros(0), 993, 400, 50, 0.6, 0.4)
    b = L.seat_pairs(c, full(1), full(1), full(1), full(1), less, L.Draws(2, np.arange(20000))).mean()
    assert a == pytest.approx(b, abs=0.04)


def test_predictive_probabilities_sum_to_one():
    """Over the whole vocabulary and the unknown word, in every context."""
    rng = np.random.default_rng(3)
    c = rng.integers(0, 6, (30, L.CONTEXTS))  # words x contexts
    c[0] += 1
    c = c[c.sum(1) > 0]
    ctx = np.tile(np.arange(L.CONTEXTS), len(c))
    t = np.minimum(c, 1)
    for k in range(3):
        c1, t1 = t.sum(1), np.minimum(t.sum(1), 1)
        shared = L.Totals(c.sum(0), t.sum(0), int(t.sum()), int(t1.sum()), len(c), 0.6, 0.4)
        parent = shared.unigram(c1, t1)
        unknown = shared.unigram(np.zeros(1), np.zeros(1))
        p = shared.in_context(ctx, c.ravel(), t.ravel(), np.repeat(parent, L.CONTEXTS)).reshape(c.shape)
        rest = shared.in_context(np.arange(L.CONTEXTS), 0, 0, np.repeat(unknown, L.CONTEXTS))
        assert np.allclose(p.sum(0) + rest, 1) and parent.sum() + unknown[0] == pytest.approx(1)
        t = L.seat(c.ravel(), (1 + 0.6 * shared.tables[ctx]) * np.repeat(parent, L.CONTEXTS), 0.6,
                   L.Draws(k, np.arange(c.size))).reshape(c.shape)
        assert ((t <= c) & ((t > 0) == (c > 0))).all()


def test_seating_follows_the_restaurant_weights():
    """Mean tables of n customers of one dish with new-table weight w: the sum of the chances to open one."""
    n, w, d = 12, 1.7, 0.3
    want = np.zeros(n + 1)
    want[1], mean = 1.0, None
    for k in range(1, n):
        after = np.zeros(n + 1)
        for t in range(1, k + 1):
            p = w / (w + k - d * t)
            after[t + 1] += want[t] * p
            after[t] += want[t] * (1 - p)
        want = after
    mean = (want * np.arange(n + 1)).sum()
    got = L.seat(np.full(40000, n), np.full(40000, w), d, L.Draws(8, np.arange(40000))).mean()
    assert got == pytest.approx(mean, abs=0.03)


@pytest.mark.parametrize("n,p", [(1, 0.3), (7, 0.5), (500, 0.02), (5000, 0.4), (10**12, 0.001)])
def test_draws_have_the_moments_of_a_binomial(n, p):
    size = 20000 if n < 100 else 4000
    got = L.Draws(3, np.arange(size)).binomial(np.arange(size), 1, np.full(size, n), np.full(size, p))
    sd = math.sqrt(n * p * (1 - p))
    assert got.min() >= 0 and got.max() <= n
    assert got.mean() == pytest.approx(n * p, abs=5 * sd / math.sqrt(size))
    assert got.std() == pytest.approx(sd, rel=0.06)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    try:
        for n in ("5", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scores.append(sorted((r.doc_id, r.score) for r in L.score_documents(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]]
    assert [x for _, x in scores[0]] == pytest.approx([x for _, x in scores[1]], rel=1e-12)


def test_steps_keep_about_their_input_and_chunks_score_alike(spark, monkeypatch, tmp_path):
    """A chunk's pairs are stored once, packed, and pairs seen once aren't answered to the texts they were seen in."""
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    sizes, stored = {}, L.stored

    def watched(df, name):
        out = stored(df, name)
        sizes[name] = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(L, "stored", watched)
    scores = []
    for files in (1, 5):
        texts.repartition(files, "doc_id").write.parquet(path := f"{tmp_path}/{files}")
        scores.append(dict((r.doc_id, r.score) for r in L.score_documents(spark.read.parquet(path)).collect()))
        whole = sum(e.stat().st_size for e in os.scandir(path) if e.name.endswith(".parquet"))
        assert sizes and max(sizes.values()) < 2 * whole
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_answers_go_out_without_names(spark, monkeypatch, tmp_path):
    """A chunk's pairs lie in one order whenever it is read, so that an answer needs no hash of its pair."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 400))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path := f"{tmp_path}/docs")
    stored, packed = L.stored, []

    def watched(df, name):
        out = stored(df, name)
        if name == "lm-answers":
            packed.extend(sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) for r in out.filter("kind = 0").collect())
        return out

    monkeypatch.setattr(L, "stored", watched)
    check_scores(L.score_documents(spark.read.parquet(path)).collect(), dict(rows))
    pairs = {p for _, t in rows for w in [t.split()] for p in zip(w, w[1:])}
    assert len(pairs) > 3000 and sum(packed) < 6 * len(pairs)


def test_pairs_lie_in_one_order():
    """Also those whose hashes agree in the parts that are sorted first."""
    rng = np.random.default_rng(6)
    word = (rng.integers(0, 3, 5000) << 40) + rng.integers(0, 4, 5000)
    context = (rng.integers(-2, 2, 5000) << 45) + 8 * rng.integers(0, 4, 5000)
    count = collections.Counter(zip(word.tolist(), context.tolist()))
    lists = []
    for _ in range(2):
        order = rng.permutation(5000)
        lists.append(L._pairs(word[order], context[order], np.ones(5000, np.int64), 4))
    for x, y in zip(*lists):
        assert (x == y).all()
    w, ctx, n = (x.tolist() for x in lists[0])
    assert len(w) == len(count) and dict(zip(zip(w, ctx), n)) == count
    some = rng.random(len(w)) < 0.3  # a part of the pairs lies as the whole does
    assert (lists[0][0][some][L.pair_order(lists[0][0][some], lists[0][1][some], 4)] == lists[0][0][some]).all()


def test_pairs_merged_in_parts_are_those_of_the_whole():
    word, context, _ = L.tokens(pa.array(["a b a b c", "b a", None, "c " * 50, "a b"] * 3))
    n = np.arange(len(word)) % 2
    whole = L._pairs(word, context, n, 16)
    parts = [L._pairs(word[i::3], context[i::3], n[i::3], 16) for i in range(3)]
    for x, y in zip(whole, L._pairs(*(np.concatenate(x) for x in zip(*parts)), 16)):
        assert (x == y).all()
    h, place, start = L._lexicon(whole[0], 16)
    assert (h[place] == whole[0]).all() and h[start] == L.START and sorted(h) == sorted({*word.tolist(), L.START})


def test_numbers_are_squeezed_without_loss():
    x = np.array([0, 1, -1, 2**62, 300, 7], np.int64)
    assert (L.unsqueezed(L.squeezed(x)) == x).all() and L.squeezed(x[:0]) == b"" and len(L.unsqueezed(b"")) == 0
    assert len(L.squeezed(np.ones(10000, np.int64))) < 200


def test_dishes_of_many_batches_are_seated_together():
    """A frequent dish takes over a hundred steps: Arrow's batches of 10,000 rows would each take them alone."""
    rows = [pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + 10_000))], names=["w"]) for k in range(0, 400_000, 10_000)]
    out = list(L.together(iter([rows[0].slice(0, 0), *rows])))
    assert [x for b in out for x in b.column("w").to_pylist()] == list(range(400_000))
    assert len(out) <= 4 and max(b.num_rows for b in out) < L.SEATED + 10_000
    assert list(L.together(iter([]))) == []


@pytest.mark.parametrize("n", [0, 1, 5000, (1 << 24) + 1])
def test_keys_are_sorted_as_whole_numbers(n):
    """By all 64 bits, also keys that differ in the lower or the upper ones only, and the highest numbers."""
    rng = np.random.default_rng(9)
    key = rng.integers(0, 4, n).astype(np.uint64) << np.uint64(62) | rng.integers(0, 3, n).astype(np.uint64) << np.uint64(23)
    order = L._order(key)
    assert (np.bincount(order, minlength=n) == 1).all() and (key[order] == np.sort(key)).all()


def test_hashes_of_words_depend_on_their_bytes_only():
    """Not on the spaces behind them, their case or the texts beside them, below and above the kept random numbers."""
    words = ["a", "b" * 63, "b" * 64, "b" * 65, "Q" * 200, "\u00e9" * 40]
    alone = {w: int(L.tokens(pa.array([w.lower()]))[0][0]) for w in words}
    assert len(set(alone.values())) == len(words)
    for space in (" ", "\t \x0b", " " * 64, "\n" * 300):
        texts = pa.array([space + space.join(words) + space, None, space.join(words[::-1]), space])
        for own in (texts, texts.slice(2, 2)):
            got, context, sizes = L.tokens(own)
            want = [x for t in own.to_pylist() for x in [*map(alone.get, (t or "").split()), L.END]]
            assert got.tolist() == want and sizes.sum() == len(want)
