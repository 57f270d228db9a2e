"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents (the last: encodings)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .jaccard import jaccard_components
from .mixing import mix_sources
from .pieces import encode_documents, read_model
from .pii import find_personal_data, redact
from .quality import QualityModel

MODEL = "piece_bpe_32k.model"
SEED, POWER = 17, 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under one half."""
    return QualityModel(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")).filter(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies; rows of null id stay, of rows that repeat an id the smallest text does."""
    found = jaccard_components(docs).where("doc_id IS NOT NULL")
    counts = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("__rows"))
    kept = counts.where("component_id = doc_id").select("doc_id", "__rows")
    rows = docs.join(kept, "doc_id").select(*docs.columns, "__rows")
    single = rows.where("__rows = 1").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeated = (
        rows.where("__rows > 1").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r"))
        .select("doc_id", "r.*").select(*docs.columns))
    return single.union(repeated).union(docs.where("doc_id IS NULL").select(*docs.columns))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the text."""
    found = find_personal_data(docs, "__of_base", "__of_all").withColumn("text", redact(F.col("text"), F.col("__of_all")))
    return found.withColumn("n_chars", F.when(F.size("__of_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources follow the square root of their size."""
    return mix_sources(docs, seed=SEED, power=POWER).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text they decode to."""
    return encode_documents(docs, read_model(public_tokenizers.path(MODEL)))
