"""Corpus pipeline: quality classifier, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
in the shared folder and rereads as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import near_dedup, packing, pii_scan, quality
from vellum.llm.queries import word_bpe
from vellum.llm.shared import dropped, shrink_heaps, written

#: Words that the tokenizer remembers in a worker: few, as the stages before have filled the executor's heap.
KEPT_WORDS = 100_000

#: Per cent of shared word shingles from which two documents are near duplicates here; op9_minhash has its own.
SIMILARITY = 80

#: What stands for a span of personal data.
PLACEHOLDER = "[{}]"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least the classifier's threshold; it learns from labels of ``docs`` that aren't held out."""
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "__quality"
    return quality.score_documents(docs, field, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id.  Rows without an id or without words stay."""
    return near_dedup.without_near_duplicates(docs, SIMILARITY)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data in ``text`` replaced by its kind in brackets; n_chars, if there, follows the text."""
    out = pii_scan.scan_pii(docs, redact=PLACEHOLDER)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, word_bpe(), kept_words=KEPT_WORDS)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicate_filter),
    ("pii_redaction", redaction),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither the trained models nor the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table is deleted once the next one is written; that of the last is what the result reads.

    Before a stage executors give back the memory that the one before has left them with.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        shrink_heaps(spark)
        made = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        docs, before = made, [made]
    return docs
