"""A training corpus from documents: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last
one repeats documents as the mix takes them. Null and empty texts have no language and go in the
first stage; of repeated rows, and of documents that tie as near-duplicates, one stays after the second;
very long texts are read whole by every stage; empty tables pass through all stages; extra columns are
kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontam, language, mixing, neardup, secrets
from kinlink.llm.shared import scratch, stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing label is filled with the prediction."""
    trees = language.train(docs)
    if not trees.langs:  # no label to learn from: only texts without a letter go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identified(docs, trees).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; the documents stay."""
    clean = secrets.without_secrets(docs, scratch(spark, "secret-ledger"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None  # language models, banding and latent retrieval have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
