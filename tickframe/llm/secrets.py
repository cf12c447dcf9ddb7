"""Operator 2, secret scans in native Spark expressions: fixed patterns, then Markov models.

Patterns find assignments (``token = ...``), access keys and long hex runs.
What lies between these spans is searched for long identifier-like runs (20
characters and more), each scored with two character Markov models of order 1, one of random strings and one of ordinary identifiers: its
log-likelihood ratio (bits per character) decides. Both models are trained
from labelled samples; a model is a table of at most 128 x 128 ASCII pairs.

Everything runs inside the JVM on built-in functions: no UDF. A text without
hits costs one pattern search per kind.

* null or empty text: no spans;
* very long texts are scanned whole; a run's score is linear in its length;
* spans count code points, end exclusive; overlapping spans of different kinds all stay;
* the ordinary model is as good as the table has text: a handful of short texts flags few random strings;
* repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Group 2 of an assignment is its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of AKIA and 20 characters in all
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9_]{8,}"
# Bits per character by which the random model must be likelier.
MIN_RATIO = 0.4
# Bounds of the training sample: documents that give ordinary identifiers, generated random strings.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_STRINGS = 4_000
_SPANS = "array<struct<start:int,end:int,value:string>>"


def hits(text: str, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches in column ``text``.

    The pieces between matches and the matches themselves alternate, so
    their lengths add up to the places.
    """
    t, rx = F.col(text), F.lit(pattern)
    none = F.array().cast(_SPANS)
    found = F.regexp_extract_all(t, rx, F.lit(0))
    both = F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(found)), found,
                      lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    placed = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(t.rlike(pattern), placed).otherwise(none)


def base_spans(text: str) -> Column:
    """``array<struct<start, kind, end>>`` of the three patterns, by start and kind."""
    def of(kind: int, pattern: str, keep) -> Column:
        return F.transform(F.filter(hits(text, pattern), keep), lambda x: F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    long_value = lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= MIN_VALUE
    always = lambda x: F.lit(True)
    return F.array_sort(F.concat(of(0, ASSIGN, long_value), of(1, ACCESS, always), of(2, HEX, always)))


def markov_table(samples: DataFrame) -> list[float]:
    """Bits by which a random string is likelier to go from character ``a`` to ``b``, at ``a * 128 + b``.

    ``samples(sample, random)``: ASCII strings with their label. Add-one
    smoothing over the alphabet of the candidates; at most 2 x 128 x 128 rows
    of counts come to the driver.
    """
    pairs = samples.select("random", F.split("sample", "").alias("c")).select("random", F.explode(F.expr(
        "transform(slice(c, 1, size(c) - 1), (x, i) -> ascii(x) * 128 + ascii(c[i + 1]))")).alias("pair"))
    rows = pairs.filter("pair between 0 and 16383").groupBy("random", "pair").count().collect()
    counts = {True: [1.0] * 16384, False: [1.0] * 16384}
    for r in rows:
        counts[r["random"]][r["pair"]] += r["count"]
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    ratio = [0.0] * 16384
    for a in alphabet:
        total = {k: sum(v[a * 128 + b] for b in alphabet) for k, v in counts.items()}
        for b in alphabet:
            p = a * 128 + b
            ratio[p] = math.log2(counts[True][p] / total[True]) - math.log2(counts[False][p] / total[False])
    return ratio


def labelled_samples(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Random strings (hex and base64 forms of hashes) and ordinary identifiers of a bounded set of documents.

    The documents with the smallest hashed ids are taken, at most
    ``SAMPLE_DOCUMENTS``; only ids are ordered, and those few are broadcast.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = docs.sparkSession.range(SAMPLE_STRINGS).select(F.explode(F.array(
        F.substring(digest, 1, 40), F.rtrim(F.lit("="), F.base64(F.unhex(digest))),
        F.upper(F.conv(F.substring(digest, 1, 12), 16, 36)))).alias("sample"), F.lit(True).alias("random"))
    ids = docs.select(F.col(id_col).alias("sampled")).distinct()
    ids = ids.orderBy(F.xxhash64("sampled"), "sampled").limit(SAMPLE_DOCUMENTS)
    chosen = docs.select(F.col(id_col).alias("sampled"), F.col(text).alias("t")).join(
        F.broadcast(ids), "sampled", "left_semi")
    words = chosen.select(F.explode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("sample"))
    words = words.filter(~F.col("sample").rlike(f"{ACCESS}|{HEX}") & ~(
        (F.length("sample") >= 20) & F.col("sample").rlike("[0-9]")))  # more likely secrets than identifiers
    return random.unionByName(words.withColumn("random", F.lit(False)))


def outside(text: str, base: str) -> Column:
    """The text with the places of its base spans blanked, every other character where it was."""
    def add(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        kept = F.substr(F.col(text), acc["at"] + 1, start - acc["at"])
        grown = F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(" "), s["end"] - start)).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(grown)

    blank = F.aggregate(base, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
                        lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))
    return F.when(F.size(base) > 0, blank).otherwise(F.col(text))


def markov_spans(text: str, ratio: list[float]) -> Column:
    """Spans of runs (20 characters at least) whose mean ratio reaches ``MIN_RATIO``."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")  # folded to one literal

    def mean(value: Column) -> Column:
        c = F.split(value, "")
        steps = F.transform(c, lambda x, i: F.when(i > 0, F.element_at(
            table, F.ascii(F.get(c, i - 1)) * 128 + F.ascii(x) + 1)).otherwise(0.0))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (F.length(value) - 1)

    found = F.filter(hits(text, CANDIDATE), lambda x: mean(x["value"]) >= MIN_RATIO)
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))


def scan_secrets(docs: DataFrame, ratio: list[float] | None = None, text: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """``docs`` as ``(id, t, base, spans)``: base spans, and all spans with the Markov ones, in order."""
    ratio = ratio if ratio is not None else markov_table(labelled_samples(docs, text, id_col))
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    data = data.withColumn("base", base_spans("t"))
    return _with_markov(data, ratio)


def _with_markov(data: DataFrame, ratio: list[float]) -> DataFrame:
    """``spans``: those of ``base``, and Markov spans in what lies between them."""
    data = data.withColumn("rest", outside("t", "base"))
    return data.withColumn("spans", F.array_sort(F.concat("base", markov_spans("rest", ratio)))).drop("rest")


def span_list(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def secret_report(docs: DataFrame, ratio: list[float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans."""
    found = scan_secrets(docs, ratio, id_col=id_col)
    count = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)")
    return found.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(span_list("base"), 256).alias("base_sha256"),
                        span_list("spans").alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[secret]", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, overlapping spans by one; null texts stay null."""
    ratio = markov_table(labelled_samples(docs, text, id_col))
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # own names never clash with working columns
    out = docs.withColumnsRenamed(names).withColumn("t", F.coalesce(F.col(names[text]), F.lit("")))
    out = _with_markov(out.withColumn("base", base_spans("t")), ratio)

    def add(acc: Column, s: Column) -> Column:
        before = F.concat(acc["out"], F.substr(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        grown = F.struct(s["end"].alias("at"),
                         F.when(s["start"] < acc["at"], acc["out"]).otherwise(before).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(grown)

    cleaned = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
                          lambda acc: F.concat(acc["out"], F.substr(F.col("t"), acc["at"] + 1)))
    out = out.withColumn(names[text], F.when(F.size("spans") > 0, cleaned).otherwise(F.col(names[text])))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
