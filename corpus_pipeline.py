"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. quality classifier: documents it rejects go;
2. near-duplicates on five-word shingles (similarity 0.8): one document of each group stays;
3. benchmark decontamination: documents that hold a test item go;
4. secret scan: secrets are replaced in the texts, ``n_chars`` follows;
5. packing: the texts that are left, as pieces of 2048-token sequences.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import read_table, stored
from tickframe.llm.decontaminate import with_items
from tickframe.llm.minhash import one_of_each_group
from tickframe.llm.packing import pack_documents
from tickframe.llm.quality import with_quality
from tickframe.llm.secrets import redact_secrets

MIN_QUALITY = 0.7
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = with_quality(docs, read_table(spark, sf_dir, "labels"), "score__")
    return scored.filter(F.col("score__") >= MIN_QUALITY).drop("score__")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = with_items(docs, read_table(spark, sf_dir, "benchmark"), "items__")
    return found.filter(F.size("items__") == 0).drop("items__")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("secret scans", secret_scan), ("packing", packing)]

# The classifier, the sketches and the packing have no SQL form; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
