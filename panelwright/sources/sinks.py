"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# S06, S07
def write_outputs(df: DataFrame, path: str, fmt: str = "parquet", by_year: str | None = None, mode: str = "overwrite") -> None:
    """CSV with a header, or parquet, optionally in one folder per year of a date column.

    Rows of a year are spread over several files by the writer's own tasks, so
    a year that holds most rows is not collected into one.
    """
    if by_year:
        df = df.withColumn("year", F.year(by_year))
    w = df.write.mode(mode)
    if by_year:
        w = w.partitionBy("year")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def overwrite_years(df: DataFrame, path: str, by_year: str = "date") -> None:
    """Replaces only the years present in ``df`` (S04 on stored tables)."""
    (df.withColumn("year", F.year(by_year)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
