"""Queries ST1-ST5: tables replayed as files through the streaming jobs."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, news as N, portfolio as P, xsection as C
from ..plans import tables as T
from ..session import materialise, new_folder
from ..streaming import jobs as ST
from .registry import part, pick, query
from .selection import scored

part("st1", """SELECT orderid, max(t) AS event_time, count(*) AS updates, arg_max(status, (t, status)) AS status, arg_max(f, (t, status)) AS filledshares FROM (
  SELECT DISTINCT orderid, status, t, any_value(f) AS f FROM (SELECT user_id AS orderid, event_type AS status, date_trunc('second', ts) AS t, floor(value) AS f FROM events)
  GROUP BY orderid, status, t) GROUP BY orderid""")


def postbacks(spark, sf):
    """Events as order messages, each written twice, in JSON lines."""
    e = T.table(spark, sf, "events")
    text = lambda c: c.cast("string")
    msg = e.select(text(F.col("user_id")).alias("orderid"), F.col("event_type").alias("status"), F.date_format("ts", ST.TIME_FORMAT).alias("updateTime"),
                   text(F.floor("value")).alias("filledshares"), F.lit("100").alias("quantity"), F.lit("N").alias("exchange"))
    path = new_folder(spark, "postbacks")
    msg.unionByName(msg).write.json(path)
    return path


@query("ST1_order_ledger", pick("st1", "orderid;event_time;status", "fill_ratio=filledshares / 100", "updates"))
def st1(spark, sf):
    path, out = postbacks(spark, sf), new_folder(spark, "ledger")
    raw = spark.readStream.schema(ST.POSTBACK).json(path)
    ST.run_to_end(ST.order_ledger(raw, "31 days"), out, new_folder(spark, "ckpt"))
    return ST.latest_status(spark.read.parquet(out)).select("orderid", "event_time", "status", "updates", "fill_ratio")


@query("ST1_status_stream", pick("st1", "orderid;event_time;status", "fill_ratio=filledshares / 100", "updates"))
def st1_status(spark, sf):
    """The status view as a stream over the ledger, in two runs: later messages first, so that the second run's are late."""
    source, ledger, table = new_folder(spark, "postbacks"), new_folder(spark, "ledger"), new_folder(spark, "status")
    ckpt = [new_folder(spark, "ckpt") for _ in range(2)]
    messages = spark.read.schema(ST.POSTBACK).json(postbacks(spark, sf))
    odd = F.pmod(F.xxhash64("orderid", "updateTime", "status"), F.lit(2))
    for turn in (1, 0):
        messages.where(odd == turn).write.mode("append").json(source)
        ST.run_to_end(ST.order_ledger(spark.readStream.schema(ST.POSTBACK).json(source), "10000 days"), ledger, ckpt[0])
        rows = spark.readStream.schema(spark.read.parquet(ledger).schema).parquet(ledger)
        ST.run_to_end(ST.status_stream(rows), ST.status_upsert(table), ckpt[1], "update")
    return spark.read.parquet(table).select("orderid", "event_time", "status", "updates", "fill_ratio")


@query("ST2_price_upsert", pick("s04", "ticker date", "close volume"))
def st2(spark, sf):
    """The panel up to 2001 and a correction from 2000 on, as two runs of one stream into one table."""
    p = materialise(T.panel(spark, sf).select("ticker", "date", "close", "volume"), "panel")
    source, table, ckpt = new_folder(spark, "feed"), new_folder(spark, "prices"), new_folder(spark, "ckpt")
    fixed = p.where("date >= '2000-01-01' AND ticker <> 'N3'").withColumn("close", F.col("close") * 1.01)
    for version, rows in enumerate((p.where("date < '2001-01-01'"), fixed)):
        rows = rows.withColumn("version", F.lit(version))
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ST.run_to_end(stream, ST.price_upsert(table), ckpt, "update")
    return spark.read.parquet(table).select("ticker", "date", "close", "volume")


def ranked_weeks(spark, sf):
    s = scored(spark, sf).where("mom60 > 0").withColumn("score", F.round("long_score", 9)).withColumn("scenario", F.lit("momentum"))
    return materialise(C.top_k(s.select("scenario", "date", "ticker", "score"), "score", 40, ("scenario", "date"), rank="place"), "ranked")


@query("ST3_rank_buffer_stream", pick("p18", "scenario date ticker", "score", "place", "scenario = 'momentum'"))
def st3(spark, sf):
    """Candidates fed in two runs; the second goes on with the names the first one held."""
    rows = ranked_weeks(spark, sf)
    source, out, ckpt = new_folder(spark, "cands"), new_folder(spark, "picks"), new_folder(spark, "ckpt")
    for part_ in (rows.where("date < '1998-06-01'"), rows.where("date >= '1998-06-01'")):
        part_.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ST.run_to_end(ST.rank_buffer_stream(stream), out, ckpt)
    return spark.read.parquet(out).select("scenario", "date", "ticker", "score", "place")


@query("ST4_sticky_stream", pick("g07_walk", "date;regime=lab", "p_bull=b;p_chop=c;p_bear=r"))
def st4(spark, sf):
    """The weekly probabilities fed in two runs; smoothing and label go on."""
    rows = materialise(T.weekly_regime(spark, sf).select(F.lit("all").alias("series"), "date", "p_bull", "p_chop", "p_bear"), "probs")
    source, out, ckpt = new_folder(spark, "probs"), new_folder(spark, "labels"), new_folder(spark, "ckpt")
    for part_ in (rows.where("date < '1998-06-01'"), rows.where("date >= '1998-06-01'")):
        part_.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ST.run_to_end(ST.sticky_stream(stream), out, ckpt)
    return spark.read.parquet(out).select("date", "regime", "p_bull", "p_chop", "p_bear")


part("st5", """SELECT CAST(published_at AS DATE) AS date, count(*) AS article_count, avg(sentiment_score) AS avg_sentiment, avg((finbert_label = 'negative')::INT) AS negative_share,
  avg((finbert_label = 'positive')::INT) AS positive_share, """ + ", ".join(f"sum(topic_{t}) AS {t}_count" for t in A.TOPICS) + """, count(DISTINCT domain) AS source_dispersion FROM n_scores GROUP BY 1
  HAVING CAST(published_at AS DATE) + 1 <= (SELECT max(published_at) FROM n_scores) - INTERVAL 2 HOUR""")


@query("ST5_news_window", pick("st5", "date", "avg_sentiment negative_share positive_share", "article_count source_dispersion " + " ".join(f"{t}_count" for t in A.TOPICS)))
def st5(spark, sf):
    """Scored articles as a stream into daily windows; the last day stays open until later news closes it."""
    from .news import scored_articles
    rows = materialise(scored_articles(spark, sf).select("article_id", "published_at", "domain", "finbert_label", "sentiment_score", *[f"topic_{t}" for t in A.TOPICS]), "news")
    source, out = new_folder(spark, "feed"), new_folder(spark, "windows")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ST.run_to_end(ST.news_window(stream, topics=A.TOPICS), out, new_folder(spark, "ckpt"))
    return spark.read.parquet(out)
