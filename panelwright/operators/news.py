"""Article normalisation, incremental scoring, daily news features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.rolling import with_zscore
from ..functions.scalar import article_text, keyword_hit, text_id, url_host, weighted_sum
from .aggregates import TOPICS
from .joins import asof, unseen
from .timeseries import smooth

SERIES = ("series",)


# S03, used here for articles
def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key; rows equal in ``order`` are told apart by their other columns, so the same one stays in every run. The filter
    on the row number is applied before the shuffle too, so a key that fills a third of the table sends one row per task."""
    from pyspark.sql import Window
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, *order) and "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in (*order, *rest)])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# N01, N02
def normalise_articles(df: DataFrame, lexicon: dict, weights: dict, force_india: bool = False, order=("published_at",)) -> DataFrame:
    """Articles in the common form: host, id, topic flags, relevance; the last one per URL.

    ``lexicon``: words for ``india`` and for each topic. ``weights``: points per flag.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    url = F.coalesce("url", F.lit(""))
    # one article per URL first, so that repeats are not searched for words
    known = df.where(F.col("published_at").isNotNull()).withColumns({"url": url, "url_hash": text_id(url)})
    out = keep_last(known, ["url_hash"], order).withColumns({
        "domain": url_host("url"), "is_india": F.lit(1) if force_india else keyword_hit(text, lexicon["india"]).cast("int"),
        **{f"topic_{t}": keyword_hit(text, lexicon[t]).cast("int") for t in TOPICS}})
    out = out.withColumn("article_id", F.col("url_hash"))
    points = {("is_india" if k == "india" else f"topic_{k}"): v for k, v in weights.items()}
    return out.withColumn("relevance_score", weighted_sum(points))


# N03
def topic_counts(df: DataFrame) -> DataFrame:
    """Articles per topic, one row per topic that occurs."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"topic_{t}").alias("hit")) for t in TOPICS])).alias("s"))
    return rows.groupBy("s.topic").agg(F.sum("s.hit").alias("n")).where("n > 0")


# N04
def label_columns(df: DataFrame, model: str = "", now=None) -> DataFrame:
    """Class columns and signed sentiment from a label and its score."""
    lab, s = F.lower("label"), F.col("score").cast("double")
    part = lambda v: F.when(lab == v, s).otherwise(0.0)
    out = df.withColumns({"finbert_label": lab, "finbert_score_raw": s, "finbert_pos": part("positive"),
                          "finbert_neu": part("neutral"), "finbert_neg": part("negative")})
    out = out.withColumn("sentiment_score", F.col("finbert_pos") - F.col("finbert_neg")).drop("label", "score")
    return out.withColumns({"scored_at": F.current_timestamp() if now is None else F.lit(now).cast("timestamp"), "model_version": F.lit(model)})


def score_new(articles: DataFrame, seen: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
              model: str = "", batch: int = 16, max_chars: int | None = None, now=None) -> DataFrame:
    """Runs a text model over the articles not scored yet.

    ``load`` is called once per task and returns a function from texts to
    (label, score) pairs; the model sees ``batch`` texts at a time.
    """
    todo = unseen(articles, seen).select("article_id", article_text("title", "description", max_chars).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_fn = load()
        for f in frames:
            texts, got = f["text"].tolist(), []
            for i in range(0, len(texts), batch):
                got += model_fn(texts[i:i + batch])
            yield pd.DataFrame({"article_id": f["article_id"], "label": [g[0] for g in got], "score": [float(g[1]) for g in got]})

    return label_columns(todo.mapInPandas(run, "article_id string, label string, score double"), model, now)


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    return keep_last(old.unionByName(new), ["article_id"], ["scored_at"])


# N05
SHARES = ("policy", "inflation", "growth", "banking", "oil", "global_risk", "india")
Z_SOURCES = {"tone_z": "avg_sentiment", "negative_tone_z": "negative_tone", "novelty_z": "novelty_score", "policy_share_z": "policy_share",
             "conflict_share_z": "conflict_share", "macro_share_z": "macro_share", "liquidity_share_z": "liquidity_share",
             "growth_share_z": "growth_share", "inflation_share_z": "inflation_share", "banking_share_z": "banking_share",
             "oil_share_z": "oil_share", "global_risk_share_z": "global_risk_share"}


def news_features(daily: DataFrame, window: int = 20) -> DataFrame:
    """Shares, composites, novelty, short means and z-scores of the daily rows (one per day)."""
    n = F.nullif(F.col("article_count"), F.lit(0)).cast("double")
    df = daily.withColumn("series", F.lit("news")).withColumns({f"{s}_share": F.col(f"{s}_count") / n for s in SHARES})
    df = df.withColumns({
        "conflict_share": F.col("global_risk_share"), "liquidity_share": F.col("banking_share"),
        "macro_share": (F.col("policy_count") + F.col("inflation_count") + F.col("growth_count")) / n,
        "negative_tone": F.col("negative_share") - F.col("positive_share"),
        "novelty_score": F.log1p(F.col("source_dispersion")) * F.coalesce(1.0 + F.col("global_risk_count") / n, F.lit(1.0)),
        "__log": F.log1p(F.col("article_count"))})
    df = smooth(df, {"sentiment_3d": ("avg_sentiment", 3), "sentiment_5d": ("avg_sentiment", 5), "negative_share_3d": ("negative_share", 3)}, SERIES)
    df = with_zscore(df, {"attention_shock_z": "__log", **Z_SOURCES}, window, max(3, window // 2), SERIES, fill=0.0)
    return zero_fill(stress_flag(df)).drop("__log", "series")


# N06
def stress_flag(df: DataFrame) -> DataFrame:
    c = F.col
    rules = [c("negative_share_3d") >= 0.45, (c("global_risk_count") > 0) & (c("attention_shock_z") > 1.0),
             (c("policy_count") > 0) & (c("avg_sentiment") < -0.15), c("conflict_share_z") > 1.5, c("negative_tone_z") > 1.5,
             c("global_risk_share_z") > 1.5, c("banking_share_z") > 1.5, (c("attention_shock_z") > 1.5) & (c("novelty_z") > 1.0)]
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.coalesce(r, F.lit(False))
    return df.withColumn("news_stress_flag", hit.cast("int"))


# N07
def zero_fill(df: DataFrame) -> DataFrame:
    """NULL, NaN and infinite numbers become 0."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            bad = F.isnan(f.name) | (F.abs(f.name) == float("inf"))
            out[f.name] = F.when(bad, 0.0).otherwise(F.coalesce(f.name, F.lit(0.0)))
        elif kind in ("int", "bigint"):
            out[f.name] = F.coalesce(f.name, F.lit(0))
    return df.withColumns(out)


# N08
def news_context(cal: DataFrame, daily: DataFrame, cols=None) -> DataFrame:
    """Latest news row known on each trading day."""
    cols = list(cols or [c for c in daily.columns if c != "date"])
    return asof(cal.select("date"), daily, cols)
