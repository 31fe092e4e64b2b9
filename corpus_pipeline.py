"""Corpus pipeline: toxic documents go, exact copies and near copies go, secrets are masked, and what stays is packed.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame; its result is written and
read again as the next one's docs. Null texts stay null where a stage keeps their row; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import toxicity
from riskloom.llm.common import read_table, saved
from riskloom.llm.exact_dedup import drop_exact_copies
from riskloom.llm.packing import pack_documents
from riskloom.llm.secrets import redact_secrets
from riskloom.llm.simhash import drop_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked where their sets of five-word shingles have a similarity of 0.8 or more, one row stays: that of the smallest doc_id."""
    return drop_near_copies(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars is that of the masked text."""
    masked = redact_secrets(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("secret scans", secret_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # the classifier and the tokenizer are no SQL; tests hold every stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
