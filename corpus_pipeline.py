"""The corpus pipeline: stages applied one after the other to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import stages
from panelwright.llm.common import documents, materialise

#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns what it keeps.
STAGES = [
    ("quality_filter", stages.quality_filter),
    ("jaccard_dedup", stages.jaccard_dedup),
    ("pii_redaction", stages.pii_redaction),
    ("source_mixing", stages.source_mixing),
    ("piece_encoding", stages.piece_encoding),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
