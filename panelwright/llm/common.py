"""Helpers shared by the corpus operators: stored tables, connected components, group lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.session import materialise, new_folder

__all__ = ["attach_groups", "components", "documents", "materialise", "new_folder", "table"]

#: Lookup tables up to this many rows (a few MB) are broadcast; larger ones are joined by salted keys.
BROADCAST_ROWS = 50_000
SALTS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a table with one row per group to the rows of the groups.

    The group table is counted first: a small one is broadcast, a larger one is
    repeated over ``SALTS`` salts so that a hot group is spread over as many tasks.
    Null keys match null keys.
    """
    renamed = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(F.col(f"__{k}"))
    drop = [f"__{k}" for k in keys]
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(renamed), on, how).drop(*drop)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)))
    spread = renamed.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, on & (F.col("__salt") == F.col("__salt2")), how).drop("__salt", "__salt2", *drop)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (``a``, ``b``): ``id``, ``component_id`` (the smallest id reachable).

    Each round hooks every node to its smallest neighbour, shortens the chains twice and maps the links to
    the new roots; the links left shrink at least by half per round. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most. Ids without links are not listed.
    """
    edges = materialise(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        hooked = (
            edges.select(F.col("b").alias("id"), F.col("a").alias("to"))
            .union(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
            .groupBy("id").agg(F.min("to").alias("root")))
        hooked = materialise(hooked, f"{name}-hook")
        for _ in range(2):
            up = hooked.select(F.col("id").alias("root"), F.col("root").alias("up"))
            hooked = materialise(hooked.join(up, "root").select("id", F.col("up").alias("root")), f"{name}-hook")
        left = hooked.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = hooked.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = materialise(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
        if labels is None:
            labels = hooked
        else:
            step = hooked.select(F.col("id").alias("root"), F.col("root").alias("up"))
            labels = materialise(labels.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")), f"{name}-labels")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return labels.select("id", F.col("root").alias("component_id"))
