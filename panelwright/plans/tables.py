"""Inputs built from the given tables: price panels, weekly features, trades, returns, articles.

Raw lines meet their supplier or part first, by a join whose form adaptive execution picks from measured
sizes (and whose hot keys it splits), and are then grouped once, by ticker and day: each task sends on
at most one row per ticker and day, however many lines it has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.filters import between_days
from ..operators.joins import calendar
from ..session import materialise

ROLE_BY_TYPE = {"ECONOMY": "risk", "STANDARD": "fear", "SMALL": "usd", "PROMO": "us10y", "MEDIUM": "gold"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sequence() -> Column:
    """A number that orders the lines of a day: order, line, then a mix of the other keys.

    One long, so that first and last price stay in a hash aggregate.
    """
    mix = F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.round(F.col("l_extendedprice") * 100).cast("long"),
                 F.lit(1048576).cast("long"))
    return F.col("l_orderkey") * F.lit(8388608).cast("long") + F.col("l_linenumber").cast("long") * F.lit(1048576).cast("long") + mix


def ticks(spark: SparkSession, folder: str, days=None) -> DataFrame:
    """Single trades; with ``days`` (first and last date, see ``filters.fence``) only those of the days, which the scan leaves out."""
    li = table(spark, folder, "lineitem")
    if days:
        li = between_days(li, "l_shipdate", days)
    return li.select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("date"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                     F.col("l_quantity").alias("qty"), _sequence().alias("seq"))


def bars(df: DataFrame, keys) -> DataFrame:
    """Daily open, high, low, close and volume from single trades."""
    return df.groupBy(*keys, "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"))


def panel(spark: SparkSession, folder: str, days=None) -> DataFrame:
    """Bars per ticker (supplier nation), of all days or a range of them."""
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.concat(F.lit("N"), F.col("s_nationkey")).alias("ticker"))
    return bars(ticks(spark, folder, days).join(supplier, "l_suppkey"), ["ticker"])


def roles(spark: SparkSession, folder: str) -> DataFrame:
    """Bars per market role: all lines are the broad market, part types the other roles.
    The fear role is scaled to the range of an index of volatility."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    named = F.create_map(*[F.lit(x) for kv in ROLE_BY_TYPE.items() for x in kv])
    tagged = ticks(spark, folder).join(part, "l_partkey").withColumn(
        "role", F.explode(F.array_compact(F.array(F.lit("broad"), named[F.col("p_type")]))))
    out = bars(tagged, ["role"])
    scale = F.when(F.col("role") == "fear", 200.0).otherwise(1.0)
    return out.withColumns({c: F.col(c) / scale for c in ("open", "high", "low", "close")})


def broad(spark: SparkSession, folder: str) -> DataFrame:
    return bars(ticks(spark, folder), [])


def trading_days(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar: days with a trade, in order. Reads one column, once: it is stored, since
    every alignment uses it several times."""
    return materialise(calendar(table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()), "calendar")


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"),
                                                 F.concat(F.lit("R"), F.col("n_regionkey")).alias("sector"))


def _friday(col: str) -> Column:
    return F.next_day(F.date_sub(F.to_date(col), 1), "FRI")


def weekly_features(spark: SparkSession, folder: str) -> DataFrame:
    """A scored-universe input: one row per week and ticker with values in the ranges of real features."""
    li = table(spark, folder, "lineitem").select(
        "l_suppkey", _friday("l_shipdate").alias("date"), "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.concat(F.lit("N"), F.col("s_nationkey")).alias("ticker"))
    g = li.join(supplier, "l_suppkey").groupBy("date", "ticker").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t"),
        flag("l_returnflag", "A").alias("a"), flag("l_returnflag", "R").alias("r"), flag("l_linestatus", "O").alias("o"),
        F.sum(F.col("l_linenumber").cast("double")).alias("ln"), F.max("price").alias("hi"), F.min("price").alias("lo"))
    n = F.col("n")
    d, t, a, r, o, ln = (F.round(F.col(c) / n, 9) for c in ("d", "t", "a", "r", "o", "ln"))
    return g.select(
        "date", "ticker", "n",
        (d * 4 - 0.2).alias("mom60"), (t * 5 - 0.2).alias("mom20"), ((d - t) * 2 - 0.02).alias("mom5"),
        (a - r).alias("fip"), F.when(n > 1, (a * 2 - 0.7)).alias("fip_z"),
        ((d - 0.05) * 30).alias("mom60_z"), ((t - 0.04) * 30).alias("mom20_z"),
        (0.1 + t * 4).alias("vol20"), F.when(n > 2, ((t - d) * 20)).alias("vol20_z"),
        (0.15 + d * 3).alias("vol252"), F.when(n > 1, (0.4 + o)).alias("beta"),
        F.col("q").alias("adv20"), (ln * 12.5 + 5).alias("rsi14"),
        F.when(o >= 0.5, 1.0).otherwise(0.0).alias("above200"),
        F.when(a > r, "VACUUM").when(a < r, "TRAPPED").otherwise("UNKNOWN").alias("structure"),
        (-(t * 5 + d)).alias("max_dd"), (a * 0.9).alias("r2"), (r).alias("er20"),
        (0.5 + o).alias("vol_comp"), (F.col("q") / 100.0).alias("rvol20"),
        (t * 5 - d * 4).alias("excess20"),
        (F.col("hi")).alias("close"), (F.col("lo")).alias("open"),
        ((d - 0.05) * 2 + (o - 0.5) * 0.1).alias("fwd_ret"))


def weekly_names(spark: SparkSession, folder: str) -> DataFrame:
    """A wide universe: one row per week and supplier with a return in the range of weekly ones."""
    li = table(spark, folder, "lineitem").select("l_suppkey", _friday("l_shipdate").alias("date"), "l_discount", "l_linestatus")
    g = li.groupBy("date", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_discount").alias("d"), F.sum(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("o"))
    d, o = (F.round(F.col(c) / F.col("n"), 9) for c in ("d", "o"))
    return g.select("date", F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), ((d - 0.05) * 2 + (o - 0.5) * 0.1).alias("fwd_ret"))


def weekly_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Opening price of the gold role in each week."""
    gold = roles(spark, folder).where("role = 'gold'")
    return gold.groupBy(_friday("date").alias("week")).agg(F.min_by("open", "date").alias("open")).withColumnRenamed("week", "date")


def weekly_regime(spark: SparkSession, folder: str) -> DataFrame:
    """A regime-trace input: one row per week with class shares as probabilities."""
    li = table(spark, folder, "lineitem").select(_friday("l_shipdate").alias("date"), "l_returnflag", "l_linestatus",
                                                 "l_tax", "l_discount", "l_quantity")
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    g = li.groupBy("date").agg(F.count("*").alias("n"), flag("l_returnflag", "A").alias("a"), flag("l_returnflag", "N").alias("m"),
                               flag("l_linestatus", "O").alias("o"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"),
                               F.sum("l_quantity").alias("q"))
    n = F.col("n")
    p1, p2 = F.round(F.col("a") / n, 9), F.round(F.col("m") / n, 9)
    p3 = F.round(1 - p1 - p2, 9)
    top = F.greatest(p1, p2, p3)
    t, d, o, q = (F.round(F.col(c) / n, 9) for c in ("t", "d", "o", "q"))
    return g.select(
        "date", F.when(p1 == top, "BULL").when(p2 == top, "CHOP").otherwise("BEAR").alias("regime"),
        p1.alias("p_bull"), p2.alias("p_chop"), p3.alias("p_bear"), (t * 12).alias("regime_confidence"),
        (d * 12).alias("transition_risk"), o.alias("breadth"), q.alias("vix"), (t - 0.04).alias("macro_score"),
        ((d - 0.05) * 10).alias("news_bias"), (o * 1.1).alias("suppression_score"),
        F.when(p1 == top, "Probabilistic bull regime").when(p2 == top, "Probabilistic mixed/chop regime")
        .otherwise("Probabilistic bear regime").alias("regime_reason"))


def trade_log(spark: SparkSession, folder: str) -> DataFrame:
    """A trade-log input: one row per week and ticker with weight, forward return and P&L."""
    f = weekly_features(spark, folder).select("date", "ticker", "close", "mom60_z", "fwd_ret", "r2", "rsi14", "n",
                                              (F.col("vol252") - 0.30).alias("raw"))
    w = F.when(F.col("n") > 1, F.col("raw") * 0.4).otherwise(0.0)
    t = f.withColumn("weight", w).join(weekly_regime(spark, folder), "date")
    state = F.when(F.pmod(F.length("ticker") + F.col("n"), F.lit(3)) == 0, "CHOP").otherwise(F.col("regime"))
    return t.select(
        "date", "ticker", "close", "weight", F.abs("weight").alias("gross_weight"), F.col("fwd_ret").alias("fwd_return"),
        (1e6 * F.col("weight") * F.col("fwd_ret")).alias("net_pnl"),
        F.when(F.col("weight") >= 0, "LONG").otherwise("SHORT").alias("side"), state.alias("market_state"),
        "regime_confidence", (F.col("p_bull") - F.col("p_bear")).alias("regime_score"), "p_bull", "p_chop", "p_bear",
        "transition_risk", "breadth", "macro_score", "news_bias", "suppression_score", F.col("mom60_z").alias("mom_z"),
        F.col("r2").alias("efficiency"), (F.col("rsi14") / 100).alias("score"))


def weekly_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Strategy returns in long form: one strategy per line number, one row per week."""
    li = table(spark, folder, "lineitem").select(_friday("l_shipdate").alias("date"), "l_linenumber", "l_tax", "l_discount")
    g = li.groupBy("l_linenumber", "date").agg(F.count("*").alias("n"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"))
    r = F.round((F.col("t") / F.col("n") - 0.04) + (F.col("d") / F.col("n") - 0.049), 9)
    return g.select(F.concat(F.lit("S"), F.col("l_linenumber")).alias("strategy"), "date", r.alias("portfolio_return"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Raw articles: documents with a date, a URL and a title (the first line)."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id"), F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(30)) * 86400
                                             + F.pmod(F.col("doc_id") * 7919, F.lit(86400))).alias("published_at"),
        F.concat(F.lit("https://"), F.upper("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id") - F.pmod("doc_id", F.lit(2))).alias("url"),
        F.struct(F.col("source").alias("name")).alias("source"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("lang").alias("language"))


def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Model output stand-in: a label and its score for the labelled documents."""
    lb = table(spark, folder, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return lb.select("doc_id", label.alias("label"), (0.5 + F.pmod("doc_id", F.lit(50)) / 100.0).alias("score"))
