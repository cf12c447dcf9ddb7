"""The registered ``opN_*`` queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.collocations import collocations
from tickframe.llm.common import read_table, shared_folder
from tickframe.llm.decontaminate import contamination
from tickframe.llm.embedding_dedup import embedding_groups
from tickframe.llm.hard_negatives import hard_negatives
from tickframe.llm.language_model import score_documents
from tickframe.llm.licenses import license_report
from tickframe.llm.minhash import near_duplicates
from tickframe.llm.packing import pack_documents
from tickframe.llm.quality import quality_scores
from tickframe.llm.secrets import secret_report
from tickframe.llm.token_counts import count_tokens
from tickframe.llm.token_files import read_token_files, write_token_files
from tickframe.llm.url_filter import filter_urls

MAX_TOKENS = 1024
MIN_QUALITY = 0.7
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    shards = write_token_files(read_table(spark, sf_dir, "documents"), folder,
                               public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, shards, folder)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= MIN_QUALITY).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), min_count=30, top=2000, contained=80)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, positives=5,
                          negatives=10, low=30, high=90, label=moved)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_secret_scan, op3_url_filters, op4_embedding_dedup, op5_token_files, op6_packing, op7_quality,
    op8_decontamination, op9_language_model, op10_minhash_dedup,
    op11_license_scan, op12_collocations, op13_hard_negatives)}

_URL_SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, rule, verdict) AS (VALUES
  ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow'))
SELECT u.page_id, u.host, u.path, max_by(r.rule, length(r.rule)) AS rule,
       coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host))
                  AND starts_with(u.path, r.rule_path)
GROUP BY ALL
"""

_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

_PHRASES_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, size, unnest([ws[i:i + size - 1] FOR i IN range(1, len(ws) - size + 2)]) AS ph
      FROM w, (VALUES (1), (2), (3), (4)) s(size)),
f AS MATERIALIZED (SELECT lang, size, array_to_string(ph, ' ') AS phrase, any_value(ph) AS ph, count(*) AS c
      FROM g GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT lang, size, ph, phrase, c AS a FROM f WHERE size > 1 AND c >= 30),
k AS MATERIALIZED (SELECT c.*, unnest(range(1, size)) AS k FROM c),
parts AS MATERIALIZED (SELECT k.*, array_to_string(ph[1:k], ' ') AS lp, array_to_string(ph[k + 1:], ' ') AS rp FROM k),
cuts AS (
  SELECT p.lang, p.ph, p.phrase, p.a, p.k, l.c AS l, r.c AS r,
         (CAST(2000000 AS HUGEINT) * p.a) // (CAST(l.c AS HUGEINT) + r.c) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.lp JOIN f r ON r.lang = p.lang AND r.phrase = p.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ph AS (
  SELECT lang, a, unnest([ph[i:i + s.s - 1] FOR i IN range(1, size - s.s + 2)]) AS ph
  FROM c JOIN (VALUES (2), (3)) s(s) ON s.s < size),
held AS (SELECT lang, array_to_string(ph, ' ') AS phrase, max(a) AS longer FROM inner_ph GROUP BY 1, 2),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
       b.phrase, b.a, b.l, b.r, n.n, CAST(b.score AS BIGINT) AS score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a
QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op3_url_filters": _URL_SQL, "op12_collocations": _PHRASES_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
