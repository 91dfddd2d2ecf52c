"""From crawled documents to packed training windows.

Five stages, each written as Parquet and read again by the next: a lost executor
repeats one stage at most, and a stage can be run again on its own.  All but the
last return the columns of ``documents``.  The rules for nulls, ties, repeated
rows and empty tables are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm import linededup, neardup, packing, quality, secrets

#: Line dedup drops a document that is left with less than this part of its words.
LEAST_LEFT_PERCENT = 20


def _counted(docs: DataFrame) -> DataFrame:
    """Bring ``n_chars`` up to date after a change of the texts."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules; take boilerplate lines out of the others."""
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier document or line has; drop what is then nearly empty."""
    return _counted(linededup.remove_lines(docs, least_left_percent=LEAST_LEFT_PERCENT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 4,096: one row per piece of a document, with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Hashing, tokenising and packing are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
