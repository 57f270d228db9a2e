"""Pluggable sources of expected returns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F


class AlphaSource(Protocol):
    """Anything that gives (date, ticker, score, confidence) for a panel."""

    def scores(self, panel: DataFrame) -> DataFrame: ...


class StoredReturns:
    """Stored returns of one strategy as the score of every name; 0 on dates not stored, confidence 1."""

    def __init__(self, returns: DataFrame, col: str = "portfolio_return"):
        self.returns, self.col = returns, col

    def scores(self, panel: DataFrame) -> DataFrame:
        side = self.returns.groupBy("date").agg(F.max(self.col).alias("score"))
        return panel.select("date", "ticker").join(F.broadcast(side), "date", "left").select(
            "date", "ticker", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1.0).alias("confidence"))


def blend(panel: DataFrame, sources: dict) -> DataFrame:
    """Confidence-weighted mean score over several sources. ``sources``: name -> AlphaSource."""
    rows = None
    for name, s in sources.items():
        one = s.scores(panel).withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("date", "ticker").agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")), F.lit(0.0)).alias("score"))
