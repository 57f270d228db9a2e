"""From a scored universe to books, trades and weekly returns, for all scenarios in one plan.

Inputs are tables with one row per date and name (scored universe), per date
(regime) and per name (sectors). Selected sleeves and finished books are small
and read several times, so both are stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import filters as S, joins as J, portfolio as P, xsection as C
from ..session import materialise

SLEEVE_COLUMNS = ("date", "ticker", "structure", "fip", "mom60", "vol20")
BY_SLEEVE = ("scenario", "date", "sleeve")
BY_DATE = ("scenario", "date")


def rebalances(days: DataFrame) -> DataFrame:
    """Distinct dates with the one after; one row per day."""
    return days.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))


SCORES = ("long_score", "short_score", "defensive_score")


def _stored_scores(scored: DataFrame) -> DataFrame:
    """Scores count to nine places, so that equal ones tie whatever the order of summation."""
    return materialise(scored.withColumns({c: F.round(c, 9) for c in SCORES}), "scored")


def store_scores(features: DataFrame, stored: bool = False) -> DataFrame:
    """Scores by the rules as a stored table, on a stored input: ranking and the pools read both several times."""
    return _stored_scores(P.score(features if stored else materialise(features, "features")))


def store_model_scores(predicted: DataFrame, models: dict) -> DataFrame:
    """Scores of several models side by side, one row per model, date and name; stored.

    ``models``: name -> column of ``predicted`` that holds the model's prediction, or None for the scores by the rules. Names without a
    prediction are left out of that model. Defensive figures are ranked once for all models.
    """
    base = P.score(materialise(predicted, "features"))
    rows = P.sweep(base, [{"model": m} for m in models])
    pred = F.coalesce(*[F.when(F.col("model") == m, F.col(c)) for m, c in models.items() if c], F.lit(None).cast("double"))
    ruled = [m for m, c in models.items() if c is None]
    rows = materialise(rows.withColumn("__pred", pred).where(F.col("__pred").isNotNull() | F.col("model").isin(ruled)), "model-rows")
    learned = P.model_score(rows.where(~F.col("model").isin(ruled)).drop("long_score", "short_score"), "__pred", ("model", "date")).drop("rank_pred")
    return _stored_scores(learned.unionByName(rows.where(F.col("model").isin(ruled))).drop("__pred"))


def candidates(scored: DataFrame, regime: DataFrame, x=("date",)) -> DataFrame:
    """The pools of the three sleeves after the rules of the date's regime, cut to what can be chosen; stored.

    Rising names of at least the median score, falling names of the top fifth (none in BULL, the top
    tenth of those in CHOP), and names with all defensive figures. On stressed dates there are no
    shorts and only half as many longs. ``suppression_score`` may be missing. ``x`` may hold a model besides the date.
    Both cuts come from one pass over the scores; pools are flags of a row, stored once.
    """
    news = F.col("suppression_score") if "suppression_score" in regime.columns else F.lit(0.0)
    state = F.broadcast(regime.select("date", "regime", "transition_risk", news.alias("suppression_score")))
    cuts = S.quantiles(scored, None, {"__median": ("long_score", 0.5), "__q80": ("short_score", 0.80)}, x)
    df = scored.join(cuts, list(x)).join(state, "date")
    kept = [*x, *[c for c in SLEEVE_COLUMNS if c not in x], *SCORES]
    flagged = df.select(*kept, "regime", S.stressed().alias("stress"), S.is_long().alias("rising"), S.is_short().alias("falling"),
                        (F.col("vol252").isNotNull() & F.col("max_dd").isNotNull() & F.col("r2").isNotNull()).alias("steady"))
    flagged = materialise(flagged.where("rising OR falling OR steady"), "pools")
    inner = S.quantiles(flagged.where("falling"), "short_score", {"__q90": 0.90}, x)
    short = F.col("falling") & ~F.col("stress") & ((F.col("regime") != "CHOP") | (F.col("short_score") >= F.col("__q90")))
    sleeves = [("MOMENTUM", F.col("rising"), "long_score"), ("DEFENSIVE", F.col("steady"), "defensive_score"), ("SHORT", short, "short_score")]
    offered = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("sleeve"), F.col(c).alias("score"))) for name, when, c in sleeves]))
    rows = flagged.join(inner, list(x), "left").withColumn("__o", F.explode(offered)).select(*kept[: -len(SCORES)], "stress", "__o.sleeve", "__o.score")
    # beyond these ranks nothing is chosen: the buffer sees 2 n names, and shorts give way to n longs at most
    ranked = C.top_k(rows, "score", max(P.KEEP_RANK, 2 * P.LONG_NAMES), (*x, "sleeve"), rank="__place")
    few = F.col("stress") & (F.col("sleeve") == "MOMENTUM") & (F.col("__place") > max(5, P.LONG_NAMES // 2))
    return materialise(ranked.where(~few).drop("stress", "__place"), "candidates")


def select_sleeves(scored: DataFrame, sectors: DataFrame, regime: DataFrame, x=("date",)) -> DataFrame:
    """Longs and defensive names by the rank buffer and the best shorts that are no longs, with their sector; stored.

    A date without longs and shorts has no book: nothing is selected, and the buffers go on with what
    the book before it held. ``x`` may hold a model besides the date; each model has buffers of its own.
    """
    model = [c for c in x if c != "date"]
    cands = candidates(scored, regime, x)
    books = cands.where("sleeve <> 'DEFENSIVE'").select(*x).distinct()
    books = books.withColumn("turn", F.row_number().over(Window.partitionBy(*(model or [F.lit(0)])).orderBy("date")))
    walked = P.rank_buffer(cands.where("sleeve <> 'SHORT'").join(F.broadcast(books), list(x)), by=(*model, "sleeve"), turn="turn")  # a row per book
    held = materialise(walked.select(*x, "sleeve", "ticker"), "held")
    picked = cands.join(held, [*x, "sleeve", "ticker"], "left_semi")
    shorts = C.top_k(P.minus(cands.where("sleeve = 'SHORT'"), held.where("sleeve = 'MOMENTUM'"), (*x, "ticker")), "score", P.SHORT_NAMES, x)
    return materialise(J.with_sector(picked.unionByName(shorts), sectors), "sleeves")


def budgets(sleeves: DataFrame, regime: DataFrame, scenarios: list[dict], short_gross: dict | None = None) -> DataFrame:
    """Long and short budget per scenario and date. A scenario of a sweep over models names its ``model``."""
    x = [c for c in ("model", "date") if c in sleeves.columns]
    counts = sleeves.groupBy(*x).agg(F.count_if(F.col("sleeve") == "MOMENTUM").alias("long_count"),
                                     F.count_if(F.col("sleeve") == "SHORT").alias("short_count"))
    g = regime.select("date", "regime", "regime_confidence", "vix", "breadth", "p_bear", "transition_risk")
    return P.gross_budget(P.sweep(g, scenarios).join(counts, x), short_gross=short_gross)


def sized(sleeves: DataFrame, budget: DataFrame) -> DataFrame:
    """Sleeve rows per scenario with the budget of their sleeve."""
    x = [c for c in ("model", "date") if c in sleeves.columns]
    df = sleeves.join(budget.select("scenario", *x, "long_budget", "short_budget", "vix"), x)
    share = F.create_map(F.lit("MOMENTUM"), F.lit(0.8), F.lit("DEFENSIVE"), F.lit(0.2))[F.col("sleeve")]
    return df.withColumn("budget", F.when(F.col("sleeve") == "SHORT", F.col("short_budget")).otherwise(share * F.col("long_budget")))


def blended(sleeves: DataFrame, budget: DataFrame) -> DataFrame:
    return P.blend_weights(sized(sleeves, budget), "score", F.when(F.col("sleeve") == "SHORT", 0.55).otherwise(0.60), BY_SLEEVE)


def capped(sleeves: DataFrame, budget: DataFrame) -> DataFrame:
    return P.cap_iterate(blended(sleeves, budget), "budget", 5, BY_SLEEVE, F.col("sleeve") != "SHORT")


def merged(sleeves: DataFrame, budget: DataFrame) -> DataFrame:
    return P.merge_sleeves(P.adjust(capped(sleeves, budget)), BY_DATE, ("score", "sector"))


def book(sleeves: DataFrame, budget: DataFrame) -> DataFrame:
    """The finished book of every scenario and date: sleeves, gold, sector and gross caps. Lazy."""
    gold = P.gold_rows(P.gold_weight(budget), BY_DATE)
    both = merged(sleeves, budget).select(*gold.columns).unionByName(gold)
    return P.book_caps(both, x=BY_DATE)


def with_gold(opens: DataFrame, gold: DataFrame) -> DataFrame:
    """Opening prices of the names and of the gold position."""
    return opens.select("ticker", "date", "open").unionByName(gold.select(F.lit("GOLDBEES").alias("ticker"), "date", "open"))


def trades(stored_book: DataFrame, opens: DataFrame, days: DataFrame) -> DataFrame:
    """Positions with the return to the next rebalance date and their P&L."""
    return P.pnl(P.forward_open_return(stored_book, opens, days))


def weekly_returns(stored_book: DataFrame, opens: DataFrame, days: DataFrame) -> DataFrame:
    """Weekly return after cost, exposure and turnover of each scenario, on the dates of its books."""
    costs = P.turnover_cost(J.weight_delta(stored_book, by=("scenario",)), x=BY_DATE)
    return P.weekly_book_returns(trades(stored_book, opens, days), costs, x=BY_DATE)
