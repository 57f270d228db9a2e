"""Cleaning, upserts and reference-data lookups on tables already read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import safe_name
from .news import keep_last

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


# S02
def normalise_ohlcv(df: DataFrame, downloaded: bool = False) -> DataFrame:
    """Lower-case price columns whatever their case; a date and a close are required.

    A downloaded frame may stand in ``Adj Close`` for a missing close.
    A title-case column wins over a lower-case one of the same name. NaN becomes NULL.
    """
    by_fold: dict = {}
    for name in df.columns:
        fold = name.lower()
        if fold not in by_fold or name == name.title():
            by_fold[fold] = name
    if downloaded and "close" not in by_fold and "adj close" in by_fold:
        by_fold["close"] = by_fold["adj close"]
    for need in ("date", "close"):
        if need not in by_fold:
            raise ValueError(f"missing {need.title()} column")
    cols = [F.to_date(F.col(f"`{by_fold['date']}`")).alias("date")]
    if "ticker" in by_fold:
        cols.insert(0, F.col(f"`{by_fold['ticker']}`").alias("ticker"))
    for c in PRICE_COLUMNS:
        if c in by_fold:
            x = F.col(f"`{by_fold[c]}`").cast("double")
            cols.append(F.nanvl(x, F.lit(None).cast("double")).alias(c))
        else:
            cols.append((F.col(f"`{by_fold['close']}`").cast("double") if c == "open" else F.lit(None).cast("double")).alias(c))
    return df.select(*cols)


# S03
dedupe_last = keep_last


# U01
def merge_dedupe(a: DataFrame, b: DataFrame, keys, order) -> DataFrame:
    """Both tables, newest row per key; columns one side lacks are NULL there."""
    return keep_last(a.unionByName(b, allowMissingColumns=True).withColumns(
        {o: F.coalesce(o, F.lit(0)) if o not in a.columns else F.col(o) for o in order}), keys, order)


# S04
def upsert(base: DataFrame, delta: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """New rows added, conflicts take the new row; columns and types stay those of ``base``."""
    fitted = delta.select(*[(F.col(f.name) if f.name in delta.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    both = base.withColumn("__v", F.lit(0)).unionByName(fitted.withColumn("__v", F.lit(1)))
    return keep_last(both, keys, ["__v"]).drop("__v")


# S05
def high_water(df: DataFrame, by=("ticker",)) -> DataFrame:
    return df.groupBy(*by).agg(F.max("date").alias("last_date"))


def newer_rows(delta: DataFrame, marks: DataFrame, by=("ticker",)) -> DataFrame:
    """Rows past each series' last date; up-to-date series drop out."""
    return delta.join(marks, list(by), "left").where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


# S11
def lot_sizes(master: DataFrame) -> DataFrame:
    """Largest lot per upper-case name among the stock futures; sizes that are no whole number are skipped."""
    rows = master.where((F.col("exch_seg") == "NFO") & (F.col("instrumenttype") == "FUTSTK"))
    lot = F.col("lotsize").try_cast("int")
    return rows.withColumn("__lot", lot).where(F.col("__lot").isNotNull()).groupBy(
        F.upper(F.trim("name")).alias("name")).agg(F.max("__lot").alias("lot_size"))


# S12
def lookup_token(orders: DataFrame, master: DataFrame, position: str = "pos") -> DataFrame:
    """Instrument token by symbol and exchange: the first listed match, else NULL."""
    first = master.groupBy("symbol", "exch_seg").agg(F.min_by("token", position).alias("token"))
    keyed = orders.withColumns({"__s": F.upper(F.trim("symbol")), "__e": F.upper(F.trim("exchange"))})
    side = first.select(F.col("symbol").alias("__s"), F.col("exch_seg").alias("__e"), "token")
    return keyed.join(side, ["__s", "__e"], "left").drop("__s", "__e")


# S13
def resolve_alias(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each role the first candidate whose safe name is present: (role, ticker)."""
    have = df.select("ticker").distinct().groupBy(safe_name("ticker").alias("__n")).agg(F.max("ticker").alias("ticker"))
    hits = candidates.withColumn("__n", safe_name("candidate")).join(have, "__n")
    return hits.groupBy("role").agg(F.min_by("ticker", "priority").alias("ticker"))


# S14
# fixed values: fields of a registry entry
REGISTRY_FIELDS = ("experiment_id", "title", "status", "evidence_tier", "competing_hypotheses", "winning_hypothesis", "evidence_evaluation",
                   "acceptance_criteria", "discovery_dataset", "validation_dataset", "replication_dataset")
# fixed values
STATUSES = ("Exploratory", "Replicated", "Established")
TIERS = ("Level 1", "Level 2", "Level 3", "Level 4")


def validate_registry(df: DataFrame) -> DataFrame:
    """Adds ``violations``: every rule an entry breaks, empty when valid."""
    checks = []
    for f in REGISTRY_FIELDS:
        absent = (F.coalesce(F.size(f), F.lit(0)) <= 0) if f == "competing_hypotheses" else (F.coalesce(f, F.lit("")) == "")
        checks.append(F.when(absent, F.lit(f"missing {f}")))
    checks.append(F.when(F.coalesce(F.size("competing_hypotheses"), F.lit(0)) < 2, F.lit("fewer than 2 hypotheses")))
    checks.append(F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("invalid status")))
    checks.append(F.when(~F.coalesce(F.col("evidence_tier").isin(*TIERS), F.lit(False)), F.lit("invalid tier")))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Valid entries replace those of the same id or are added; invalid ones are left out."""
    good = validate_registry(entries).where(F.size("violations") == 0).drop("violations")
    return upsert(registry, good, ["experiment_id"])


# S15
def heartbeat(trace: DataFrame, word: str) -> DataFrame:
    """The newest regime row, and whether its reason names a source."""
    last = trace.agg(F.max_by(F.struct("date", "regime", "regime_confidence", "regime_reason"), "date").alias("r"))
    return last.select("r.date", "r.regime", F.coalesce(F.col("r.regime_reason").contains(word), F.lit(False)).cast("int").alias("flagged"),
                       F.col("r.regime_confidence").alias("confidence"), F.col("r.regime_reason").alias("reason"))
