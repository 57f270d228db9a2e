"""Queries F12, A16, J06, J07 and N01-N08."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, filters as S, joins as J, news as N
from ..plans import tables as T
from ..session import materialise
from .ingest import BLOCKED, LEXICON, WEIGHTS, hit_sql
from .registry import part, pick, query

TOPICS = A.TOPICS
TXT = "title || ' ' || description"
part("n_flags", "SELECT *, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain, substr(sha256(url), 1, 24) AS article_id, "
     + f"CAST({hit_sql(TXT, LEXICON['india'])} AS INT) AS is_india, "
     + ", ".join(f"CAST({hit_sql(TXT, LEXICON[t])} AS INT) AS topic_{t}" for t in TOPICS) + " FROM b_articles")
POINTS = " + ".join(f"{w} * {'is_india' if k == 'india' else 'topic_' + k}" for k, w in WEIGHTS.items())
part("n01", f"SELECT DISTINCT ON (article_id) *, {POINTS} AS relevance_score FROM n_flags ORDER BY article_id, published_at DESC, doc_id DESC")
FLAGS = ["is_india", *[f"topic_{t}" for t in TOPICS]]


def normalised(spark, sf, force=False):
    return N.normalise_articles(T.articles(spark, sf), LEXICON, WEIGHTS, force, ("published_at", "doc_id"))


@query("N01_normalise_articles", pick("n01", "article_id domain language", "relevance_score", "doc_id " + " ".join(FLAGS)))
def n01(spark, sf):
    return normalised(spark, sf).select("article_id", "domain", "language", "relevance_score", "doc_id", *FLAGS)


part("n02", f"SELECT *, relevance_score + {WEIGHTS['india']} * (1 - is_india) AS score2 FROM n01")


@query("N02_second_source", pick("n02", "article_id", "relevance_score=score2", "is_india=1"))
def n02(spark, sf):
    return normalised(spark, sf, force=True).select("article_id", "relevance_score", "is_india")


part("n03", " UNION ALL ".join(f"SELECT '{t}' AS topic, sum(topic_{t}) AS n FROM n01" for t in TOPICS))


@query("N03_topic_counts", pick("n03 WHERE n > 0", "topic", "", "n"))
def n03(spark, sf):
    return N.topic_counts(normalised(spark, sf))


part("f12_trust", "SELECT lower(source) || '.example.com' AS domain FROM documents GROUP BY source HAVING count(*) >= 50")
part("f12", f"""SELECT * FROM n01 WHERE relevance_score >= 2.0 AND (is_india > 0 OR {' + '.join(f'topic_{t}' for t in TOPICS)} > 0)
  AND NOT {hit_sql(TXT, BLOCKED)} AND ((is_india > 0 AND {' + '.join(f'topic_{t}' for t in TOPICS)} > 0) OR domain IN (SELECT domain FROM f12_trust))""")


@query("F12_relevant", pick("f12", "article_id", "relevance_score"))
def f12(spark, sf):
    busy = T.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 50")
    trusted = busy.select(F.concat(F.lower("source"), F.lit(".example.com")).alias("domain"))
    return S.relevant(normalised(spark, sf), 2.0, trusted, BLOCKED).select("article_id", "relevance_score")


part("n_scores", """SELECT n.*, s.label AS finbert_label, s.score, CASE s.label WHEN 'positive' THEN s.score WHEN 'negative' THEN -s.score ELSE 0 END AS sentiment_score
  FROM n01 n JOIN b_sentiment s ON s.doc_id = n.doc_id""")


def scored_articles(spark, sf):
    """Normalised articles with the sentiment of their document."""
    a = normalised(spark, sf)
    lab = N.label_columns(T.sentiment(spark, sf), "labels", "2024-02-01 00:00:00")
    scores = a.select("article_id", "doc_id").join(lab, "doc_id").drop("doc_id")
    return J.join_scores(a, scores)


@query("J06_join_scores", pick("n_scores", "article_id finbert_label", "sentiment_score relevance_score"))
def j06(spark, sf):
    return scored_articles(spark, sf).select("article_id", "finbert_label", "sentiment_score", "relevance_score")


@query("J07_unseen", pick("n01", "article_id", "", "doc_id", "article_id NOT IN (SELECT article_id FROM n_scores)"))
def j07(spark, sf):
    a = normalised(spark, sf)
    seen = a.join(T.sentiment(spark, sf), "doc_id")
    return J.unseen(a, seen).select("article_id", "doc_id")


part("n04", """SELECT doc_id, label, score, CASE WHEN label = 'positive' THEN score ELSE 0 END AS pos, CASE WHEN label = 'negative' THEN score ELSE 0 END AS neg,
  CASE WHEN label = 'neutral' THEN score ELSE 0 END AS neu FROM b_sentiment""")


@query("N04_label_columns", pick("n04", "finbert_label=label", "finbert_pos=pos;finbert_neg=neg;finbert_neu=neu;sentiment_score=pos - neg", "doc_id"))
def n04(spark, sf):
    return N.label_columns(T.sentiment(spark, sf)).select("doc_id", "finbert_label", "finbert_pos", "finbert_neg", "finbert_neu", "sentiment_score")


def vowel_model():
    """A stand-in scorer: label by the share of vowels. A real one loads a model here, once per task."""
    def score(texts):
        out = []
        for t in texts:
            share = sum(c in "aeiou" for c in t) / max(len(t), 1)
            out.append(("negative" if share < 0.30 else "positive" if share > 0.38 else "neutral", share))
        return out
    return score


part("n04_in", "SELECT article_id, trim(title || '. ' || description) AS t FROM n01 WHERE article_id NOT IN (SELECT article_id FROM n_scores)")
part("n04_v", "SELECT article_id, (length(t) - length(regexp_replace(t, '[aeiou]', '', 'g')))::DOUBLE / greatest(length(t), 1) AS share FROM n04_in")


@query("N04_score_new", pick("n04_v", "article_id;finbert_label=CASE WHEN share < 0.30 THEN 'negative' WHEN share > 0.38 THEN 'positive' ELSE 'neutral' END", "finbert_score_raw=share;"))
def n04_new(spark, sf):
    a = normalised(spark, sf)
    seen = a.join(T.sentiment(spark, sf), "doc_id")
    return N.score_new(a, seen, vowel_model, "vowels").select("article_id", "finbert_label", "finbert_score_raw")


part("a16", """SELECT CAST(published_at AS DATE) AS date, count(*) AS article_count, avg(sentiment_score) AS avg_sentiment, avg((finbert_label = 'negative')::INT) AS negative_share,
  avg((finbert_label = 'positive')::INT) AS positive_share, """ + ", ".join(f"sum(topic_{t}) AS {t}_count" for t in TOPICS)
     + ", sum(is_india) AS india_count, count(DISTINCT domain) AS source_dispersion FROM n_scores GROUP BY 1")
COUNTS = [f"{t}_count" for t in TOPICS] + ["india_count", "source_dispersion", "article_count"]


def daily(spark, sf):
    return A.news_daily(scored_articles(spark, sf))


@query("A16_news_daily", pick("a16", "date", "avg_sentiment negative_share positive_share", " ".join(COUNTS)))
def a16(spark, sf):
    return daily(spark, sf).select("date", "avg_sentiment", "negative_share", "positive_share", *COUNTS)


part("n05_s", "SELECT *, " + ", ".join(f"{s}_count::DOUBLE / nullif(article_count, 0) AS {s}_share" for s in N.SHARES) + """,
  (policy_count + inflation_count + growth_count)::DOUBLE / nullif(article_count, 0) AS macro_share, negative_share - positive_share AS negative_tone,
  ln(1 + source_dispersion) * coalesce(1 + global_risk_count::DOUBLE / nullif(article_count, 0), 1) AS novelty_score, ln(1 + article_count) AS lg,
  avg(avg_sentiment) OVER (ORDER BY date ROWS 2 PRECEDING) AS sentiment_3d, avg(avg_sentiment) OVER (ORDER BY date ROWS 4 PRECEDING) AS sentiment_5d,
  avg(negative_share) OVER (ORDER BY date ROWS 2 PRECEDING) AS negative_share_3d FROM a16""")
ZS = {"attention_shock_z": "lg", "tone_z": "avg_sentiment", "negative_tone_z": "negative_tone", "novelty_z": "novelty_score", "macro_share_z": "macro_share",
      "conflict_share_z": "global_risk_share", "liquidity_share_z": "banking_share", **{f"{t}_share_z": f"{t}_share" for t in TOPICS}}
W20 = "(ORDER BY date ROWS 19 PRECEDING)"
part("n05", "SELECT *, " + ", ".join(f"coalesce(CASE WHEN count(*) OVER {W20} >= 10 THEN ({c} - avg({c}) OVER {W20}) / nullif(stddev_samp({c}) OVER {W20}, 0) END, 0) AS {z}" for z, c in ZS.items()) + " FROM n05_s")
part("n06", """SELECT *, CASE WHEN negative_share_3d >= 0.45 OR (global_risk_count > 0 AND attention_shock_z > 1) OR (policy_count > 0 AND avg_sentiment < -0.15) OR conflict_share_z > 1.5
  OR negative_tone_z > 1.5 OR global_risk_share_z > 1.5 OR banking_share_z > 1.5 OR (attention_shock_z > 1.5 AND novelty_z > 1) THEN 1 ELSE 0 END AS news_stress_flag FROM n05""")
FEATS = [f"{s}_share" for s in N.SHARES] + ["macro_share", "negative_tone", "novelty_score", "sentiment_3d", "sentiment_5d", "negative_share_3d"] + list(ZS)


@query("N05_news_features", pick("n06", "date", " ".join(FEATS)))
def n05(spark, sf):
    return N.news_features(daily(spark, sf)).select("date", *FEATS)


@query("N06_stress_flag", pick("n06", "date", "", "news_stress_flag"))
def n06(spark, sf):
    return N.news_features(daily(spark, sf)).select("date", "news_stress_flag")


@query("N07_zero_fill", pick("w03", "ticker date", "vol20=coalesce(vol20, 0);vol252=coalesce(vol252, 0)"))
def n07(spark, sf):
    from ..operators import timeseries as W
    from .timeseries import with_ret
    df = W.vol(with_ret(spark, sf), "ret", {20: 10, 252: 126}).withColumn("vol20", F.coalesce("vol20", F.lit(float("inf")))).withColumn("vol252", F.coalesce("vol252", F.lit(float("nan"))))
    return N.zero_fill(df.select("ticker", "date", "vol20", "vol252"))


part("n08", """SELECT c.date, (SELECT max_by(a.avg_sentiment, a.date) FROM a16 a WHERE a.date <= c.d) AS avg_sentiment, (SELECT max_by(a.article_count, a.date) FROM a16 a WHERE a.date <= c.d) AS article_count
  FROM (SELECT DISTINCT CAST(ts AS DATE) + 3 AS d, CAST(ts AS DATE) + 3 AS date FROM events) c""")


@query("N08_news_context", pick("n08", "date", "avg_sentiment", "article_count"))
def n08(spark, sf):
    days = T.table(spark, sf, "events").select(F.date_add(F.to_date("ts"), 3).alias("date")).distinct()
    return N.news_context(days, daily(spark, sf), ["avg_sentiment", "article_count"])
