"""Universe screens, pools, windows and relevance filters; the time fence of a scan.

The pools compare scores with quantiles of the same scores, so the scored
universe should be a stored table.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import keyword_hit, safe_name
from .xsection import group_stats, quantiles, top_k

MIN_HISTORY, MIN_PRICE, MIN_ADV20 = 220, 50.0, 5_000_000.0
COMPLETE = ("fip", "mom60", "vol20", "vol252", "max_dd", "r2", "er20", "vol_comp", "rvol20", "excess20")


# F01
def exclude(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drops tickers whose safe name is among the index and macro candidates."""
    names = aliases.select(safe_name("candidate").alias("__name")).distinct()
    return df.withColumn("__name", safe_name("ticker")).join(names, "__name", "left_anti").drop("__name")


# F02
def min_history(df: DataFrame, n: int = MIN_HISTORY, by=("ticker",)) -> DataFrame:
    keep = df.groupBy(*by).agg(F.count("close").alias("__n")).where(F.col("__n") >= n).drop("__n")
    return df.join(keep, list(by), "left_semi")


def min_history_aligned(df: DataFrame, n: int = MIN_HISTORY, by=("ticker",)) -> DataFrame:
    """The same on a panel already laid out by series: counted there, without reading it twice."""
    return df.withColumn("__n", F.count("close").over(Window.partitionBy(*by))).where(F.col("__n") >= n).drop("__n")


# F03
def liquid(df: DataFrame, min_adv: float = MIN_ADV20, min_price: float = MIN_PRICE) -> DataFrame:
    return df.where(F.col("open").isNotNull() & (F.col("adv20") >= min_adv) & (F.col("close") >= min_price))


# F04
def complete(df: DataFrame, cols=COMPLETE) -> DataFrame:
    return df.dropna(subset=list(cols))


# F05
def is_long() -> Column:
    """Rising, with a score of at least the median ``__median``, and no crash in the last days."""
    return F.coalesce((F.col("mom60") > 0) & (F.col("long_score") >= F.col("__median")) & (F.col("mom5") > -0.10), F.lit(False))


def long_pool(df: DataFrame, x=("date",)) -> DataFrame:
    """Rising names with a score of at least the date's median that did not just crash."""
    mid = quantiles(df, "long_score", {"__median": 0.5}, x)
    return df.join(mid, list(x)).where(is_long()).drop("__median")


# F06
def is_short(regime_col: str = "regime") -> Column:
    """Falling, with a short score of at least the fifth's ``__q80``; not in BULL."""
    return F.coalesce((F.col("mom60") < 0) & (F.col("above200") < 0.5) & (F.col("short_score") >= F.col("__q80")) & (F.col(regime_col) != "BULL"), F.lit(False))


def short_pool(df: DataFrame, regime_col: str = "regime", x=("date",)) -> DataFrame:
    """Falling names in the top fifth by short score; none in BULL, in CHOP the top tenth of that pool."""
    cut = quantiles(df, "short_score", {"__q80": 0.80}, x)
    pool = df.join(cut, list(x)).where(is_short(regime_col)).drop("__q80")
    inner = quantiles(pool, "short_score", {"__q90": 0.90}, x)
    return pool.join(inner, list(x)).where(
        (F.col(regime_col) != "CHOP") | (F.col("short_score") >= F.col("__q90"))).drop("__q90")


# F07
def stressed():
    return (F.coalesce("suppression_score", F.lit(0.0)) >= 0.60) | (F.coalesce("transition_risk", F.lit(0.0)) >= 0.75)


def suppress(longs: DataFrame, n: int = 10, x=("date",)) -> DataFrame:
    """On stressed dates only the best max(5, n) longs stay."""
    df = longs.withColumn("__stress", stressed())
    calm = df.where(~F.col("__stress")).drop("__stress")
    tight = top_k(df.where("__stress").drop("__stress"), "long_score", max(5, n), x)
    return calm.unionByName(tight)


def suppress_shorts(shorts: DataFrame) -> DataFrame:
    return shorts.where(~stressed())


# F08
def defensive_pool(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["vol252", "max_dd", "r2"])


# F09
def confidence_filter(df: DataFrame, pred: str, threshold: float, x=("date",)) -> DataFrame:
    df = df.withColumn("__p", F.abs(pred))
    df = group_stats(df, x, {"__m": F.avg("__p"), "__d": F.stddev_samp("__p")})
    z = (F.col("__p") - F.col("__m")) / (F.col("__d") + 1e-9)
    return df.withColumn("pred_z", z).where(F.col("pred_z") >= threshold).drop("__p", "__m", "__d")


# F10
def split_windows(df: DataFrame, windows, date: str = "date") -> DataFrame:
    """One copy of a row per named window (label, start, end) that holds its date; bounds may be None.

    The window list is a few literals, so each row picks its labels in place.
    """
    labels = []
    for label, start, end in windows:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (F.col(date) >= F.lit(start).cast("date"))
        if end is not None:
            inside = inside & (F.col(date) <= F.lit(end).cast("date"))
        labels.append(F.when(inside, F.lit(label)))
    return df.withColumn("window", F.explode(F.array_compact(F.array(*labels))))


# F11
def active(df: DataFrame) -> DataFrame:
    return df.where(F.abs("weight") > 1e-12)


TOPICS = ("policy", "inflation", "growth", "banking", "oil", "global_risk")


# F12
def relevant(df: DataFrame, min_score: float, trusted: DataFrame, blocklist) -> DataFrame:
    """Scored, on topic, not blocklisted, and either both local and topical or from a trusted domain.

    Trust is decided on the distinct domains, which then join as a plain
    equality; whether they are broadcast is left to their measured size.
    """
    topics = sum([F.coalesce(f"topic_{t}", F.lit(0)) for t in TOPICS[1:]], F.coalesce(f"topic_{TOPICS[0]}", F.lit(0)))
    local = F.coalesce("is_india", F.lit(0)) > 0
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    known = trusted.select("domain").distinct().withColumn("__trusted", F.lit(True))
    kept = df.where((F.col("relevance_score") >= min_score) & (local | (topics > 0)) & ~keyword_hit(text, blocklist))
    marked = kept.join(known, "domain", "left")
    return marked.where((local & (topics > 0)) | F.coalesce("__trusted", F.lit(False))).drop("__trusted")


# F13
def as_of_cutoff(df: DataFrame, local_time: str, zone: str = "Asia/Kolkata", col: str = "published_at") -> DataFrame:
    return df.where(F.col(col) <= F.to_utc_timestamp(F.lit(local_time).cast("timestamp"), zone))


# F14
def winsor(df: DataFrame, col: str, low: float = -0.3, high: float = 0.5) -> DataFrame:
    c = F.col(col)
    return df.withColumn(col, F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c))))


# F15
def floor_weights(df: DataFrame, eps: float = 0.001) -> DataFrame:
    return df.where(F.col("weight") > eps)


#: Trading days before a range that features of the range may read: a drawdown (252 rows) from a maximum (252 rows).
LOOK_BACK = 504


# time fence of the scan
def fence(cal: DataFrame, first: str, last: str, rows: int = LOOK_BACK) -> tuple:
    """The days a scan must cover for features of ``first`` to ``last``: the date ``rows`` trading days before the first one in the range, and the last one in it.

    One row of two dates comes to the driver; both are None where no trading day lies in the range. Exponential means reach back without end: what is left
    of older rows after n of them is ``(1 - alpha) ** n``, so ``rows`` decides how exact they are.
    """
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ends = cal.agg(F.min(F.when(inside, F.col("idx"))).alias("at"), F.max(F.when(inside, F.col("date"))).alias("last"))
    return tuple(cal.join(F.broadcast(ends), F.col("idx") >= F.col("at") - rows).agg(F.min("date"), F.max("last")).first())


def between_days(df: DataFrame, col: str, days: tuple) -> DataFrame:
    """Rows of the days, both ends included, as comparisons of the column with literals, which reach the scan. No days (None): no rows."""
    first, last = days
    if first is None:
        return df.where(F.lit(False))
    kind = df.schema[col].dataType
    end = F.lit(last + timedelta(days=1)).cast(kind)
    return df.where((F.col(col) >= F.lit(first).cast(kind)) & (F.col(col) < end))
