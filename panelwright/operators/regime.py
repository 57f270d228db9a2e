"""Market frame, regime probabilities, labels and their validation.

Market tables have one row per date (and role), so their windows are never
longer than the calendar.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rolling import Roll, running, series, with_ewm, with_rolling, with_zscore
from ..functions.scalar import argmax_label, clip, interpolate, softmax
from .timeseries import efficiency, ffill, bfill, pct, slope

ROLE = ("role",)
TEMPERATURE = 5.0
# fixed values: regime gates and score centres
BREADTH_BULL, BREADTH_BEAR, VIX_HIGH, BREADTH_CENTRE = 0.40, 0.25, 28.0, 0.43
VIX_KNOTS, VIX_VALUES = (10.0, 16.0, 22.0, 30.0, 45.0), (0.6, 0.3, 0.0, -0.5, -1.0)


# G01
def market_frame(aligned: DataFrame, back_fill: bool = False) -> DataFrame:
    """Filled closes of each role with its return, averages and deviation, and the trend columns."""
    df = ffill(aligned, ["close", "open"], ROLE)
    if back_fill:  # looks ahead
        df = bfill(df, ["close", "open"], ROLE)
    df = pct(df, "close", 1, "ret1", ROLE)
    df = with_rolling(df, [Roll("sma50", "mean", "close", 50, 25), Roll("sma200", "mean", "close", 200, 100),
                           Roll("vol20", "std", "ret1", 20, 10), Roll("ret20", "mean", "ret1", 20, 10)], ROLE)
    df = df.withColumn("vol20", F.col("vol20") * F.sqrt(F.lit(252.0)))
    df = slope(efficiency(df, {"eff100": (100, 33, "clipped")}, ROLE), 100, ROLE)
    return with_zscore(df, {"mom20_z": "ret20", "vol_z": "vol20"}, 60, 20, ROLE)


def market_wide(frame: DataFrame) -> DataFrame:
    """The market frame as one row per date."""
    def of(role: str, col: str, out: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(col))).alias(out)
    return frame.groupBy("date").agg(
        of("broad", "close", "price"), of("broad", "sma200", "sma200"), of("broad", "eff100", "eff100"),
        of("broad", "slope100", "slope100"), of("broad", "mom20_z", "mom20_z"), of("risk", "close", "risk_close"),
        of("risk", "sma50", "risk_sma50"), of("fear", "close", "vix"), of("usd", "ret20", "usd_ret20"),
        of("us10y", "ret20", "us10y_ret20"), of("gold", "ret20", "gold_ret20"))


# G02
def macro_score(m: DataFrame) -> DataFrame:
    """Mean of the signed macro moves and of the distance of the fear level from 20, over those known."""
    parts = [-F.col("usd_ret20"), -F.col("us10y_ret20"), F.col("gold_ret20"), -0.02 * (F.col("vix") - 20.0)]
    total = sum([F.coalesce(p, F.lit(0.0)) for p in parts], F.lit(0.0))
    known = sum([p.isNotNull().cast("int") for p in parts], F.lit(0))
    return m.withColumn("macro_score", F.coalesce(F.try_divide(total, known), F.lit(0.0)))


# G03
def regime_inputs(m: DataFrame, breadth: DataFrame | None = None) -> DataFrame:
    """Trend, breadth and risk scores; all 0 while the market's history is too short."""
    df = m if breadth is None else m.join(F.broadcast(breadth.select("date", "breadth")), "date", "left")
    known = F.col("sma200").isNotNull() & F.col("eff100").isNotNull() & F.col("slope100").isNotNull() & F.col("mom20_z").isNotNull()
    above = F.when(F.col("price") >= F.col("sma200"), 1.0).otherwise(-1.0)
    trend = (1.50 * above + 0.40 * F.tanh(F.col("slope100") * 20.0) + 0.30 * F.tanh(F.col("eff100") - 0.15)
             + 0.30 * F.tanh(F.col("mom20_z") / 2.0))
    risk_off = F.coalesce(F.col("risk_close") < F.col("risk_sma50"), F.lit(False))
    risk = F.coalesce(interpolate("vix", VIX_KNOTS, VIX_VALUES), F.lit(0.0)) - F.when(risk_off, 0.3).otherwise(0.0)
    zero = F.lit(0.0)
    return df.withColumns({
        "enough": known,
        "above_sma": F.when(known, above).otherwise(zero), "trend_score": F.when(known, trend).otherwise(zero),
        "breadth_score": F.when(known, F.coalesce((F.col("breadth") - BREADTH_CENTRE) * 3.0, zero)).otherwise(zero),
        "risk_score": F.when(known, risk).otherwise(zero), "news_bias": zero, "suppression_score": zero})


# G04
def regime_probs(df: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Logits of the three classes, their shares, and the confidence and instability they imply."""
    a, t, b, r = F.col("above_sma"), F.col("trend_score"), F.col("breadth_score"), F.col("risk_score")
    macro, n, s = F.tanh(F.col("macro_score") * 8.0), F.col("news_bias"), F.col("suppression_score")
    # fixed values: coefficients of the formula
    logits = {
        "__bull": 1.35 * a + 1.10 * t + 0.65 * b + 0.45 * r + 0.35 * macro + 0.30 * n - 0.40 * s,
        "__chop": (-0.55 * F.abs(a) - 0.45 * F.abs(t) - 0.30 * F.abs(b) + 0.30 * (1.0 - F.abs(r))
                   + 0.15 * (1.0 - F.abs(n)) + 0.20 * s),
        "__bear": -1.35 * a - 0.90 * t - 0.55 * b - 0.70 * r - 0.30 * macro - 0.20 * n + 0.55 * s,
    }
    df = df.withColumns(logits)
    shares = softmax(["__bull", "__chop", "__bear"], temperature)
    df = df.withColumns(dict(zip(("p_bull", "p_chop", "p_bear"), shares)))
    return with_confidence(df).drop("__bull", "__chop", "__bear")


def with_confidence(df: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.array("p_bull", "p_chop", "p_bear"), asc=False)
    df = df.withColumn("regime_confidence", clip(ordered[0] - ordered[1] + 0.35 * ordered[0], 0.0, 1.0))
    return df.withColumns({
        "instability": clip(1.0 - F.abs(F.col("p_bull") - F.col("p_bear")), 0.0, 1.0),
        "regime_score": F.col("p_bull") - F.col("p_bear"),
        "selected": argmax_label([("BULL", "p_bull"), ("CHOP", "p_chop"), ("BEAR", "p_bear")])})


# G05
def transition_risk(df: DataFrame, by=(), order: str = "date") -> DataFrame:
    """Shift against the row before; the first row has its own formula.

    The cadence is that of the rows given: all days, or the weekly signal dates.
    """
    w = series(by or [F.lit(0)], order)
    names = ("p_bull", "p_chop", "p_bear")
    df = df.withColumns({f"__{c}": F.lag(c, 1).over(w) for c in names})
    shift = sum([F.abs(F.col(c) - F.col(f"__{c}")) for c in names[1:]], F.abs(F.col("p_bull") - F.col("__p_bull"))) / 2.0
    unsure = 1.0 - F.col("regime_confidence")
    first = 0.35 * F.col("instability") + 0.35 * F.col("suppression_score") + 0.20 * unsure
    later = 0.45 * shift + 0.20 * F.col("instability") + 0.20 * F.col("suppression_score") + 0.15 * unsure
    value = F.when(F.col("__p_bull").isNull(), first).otherwise(later)
    return df.withColumn("transition_risk", clip(value, 0.0, 1.0)).drop(*[f"__{c}" for c in names])


# G06
def gate(df: DataFrame, breadth_bull: float = BREADTH_BULL, breadth_bear: float = BREADTH_BEAR, vix_high: float = VIX_HIGH) -> DataFrame:
    """Final label: a class counts only with its breadth or fear condition; short history is CHOP."""
    bull = F.col("enough") & (F.col("selected") == "BULL") & F.coalesce(F.col("breadth") >= breadth_bull, F.lit(False))
    bear = F.col("enough") & (F.col("selected") == "BEAR") & (
        F.coalesce(F.col("breadth") < breadth_bear, F.lit(False)) | F.coalesce(F.col("vix") >= vix_high, F.lit(False)))
    return df.withColumns({
        "regime": F.when(bull, "BULL").when(bear, "BEAR").otherwise("CHOP"),
        "regime_reason": F.when(~F.col("enough"), "Insufficient history").when(bull, "Probabilistic bull regime")
        .when(bear, "Probabilistic bear regime").otherwise("Probabilistic mixed/chop regime")})


def classify(frame: DataFrame, breadth: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """G02-G06 in a row: one regime record per date."""
    m = regime_inputs(macro_score(market_wide(frame)), breadth)
    return gate(transition_risk(regime_probs(m, temperature)))


# G07
STICKY_COLUMNS = ("p_bull", "p_chop", "p_bear")


def step_label(state: str, probs: dict, gap: float) -> str:
    """Next label: the best class takes over only when it leads the current one by the gap."""
    best = max(("BULL", "CHOP", "BEAR"), key=lambda k: probs[k])
    return best if probs[best] > probs[state] + gap else state


def sticky(df: DataFrame, alpha: float = 0.35, gap: float = 0.10, by=("series",)) -> DataFrame:
    """Smoothed class probabilities and a label that changes only for a clear lead.

    Smoothing is a window expression; the label depends on the one before, so
    each series is walked once, in date order. A series has one row per date.
    """
    smooth = {f"s_{c}": c for c in STICKY_COLUMNS}
    df = with_ewm(df.select(*by, "date", *STICKY_COLUMNS), smooth, alpha, 1, by)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        label, out = "CHOP", []
        for b, c, r in zip(pdf["s_p_bull"], pdf["s_p_chop"], pdf["s_p_bear"]):
            label = step_label(label, {"BULL": b, "CHOP": c, "BEAR": r}, gap)
            out.append(label)
        return pdf.assign(regime=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", regime string"
    labelled = df.groupBy(*by).applyInPandas(walk, schema)
    ordered = F.sort_array(F.array(*smooth), asc=False)
    labelled = labelled.withColumns({
        "regime_confidence": clip(ordered[0] - ordered[1] + 0.35 * ordered[0], 0.0, 1.0),
        "instability": clip(1.0 - F.abs(F.col("s_p_bull") - F.col("s_p_bear")), 0.0, 1.0),
        "suppression_score": F.lit(0.0)})
    moved = transition_risk(labelled.drop(*STICKY_COLUMNS).withColumnsRenamed({f"s_{c}": c for c in STICKY_COLUMNS}), by)
    return moved.drop("suppression_score")


# G08
def relabel(df: DataFrame) -> DataFrame:
    """Three labels to compare: score with breadth, probabilities, probabilities without news."""
    score, wide = F.col("regime_score"), F.col("breadth")
    base = (F.when((score > 0.20) & F.coalesce(wide >= 0.40, F.lit(False)), "BULL")
            .when((score < -0.20) & F.coalesce(wide <= 0.25, F.lit(True)), "BEAR").otherwise("CHOP"))
    n, s = F.col("news_bias"), F.col("suppression_score")
    plain = argmax_label([("BULL", F.col("p_bull") - 0.10 * n + 0.08 * s), ("CHOP", F.col("p_chop") + 0.04 * s),
                          ("BEAR", F.col("p_bear") + 0.06 * n - 0.10 * s)])
    return df.withColumns({
        "baseline_state": base, "prob_state": argmax_label([("BULL", "p_bull"), ("CHOP", "p_chop"), ("BEAR", "p_bear")]),
        "prob_no_news_state": plain})


# G09
LABELS = ("baseline_state", "prob_state", "prob_no_news_state")


def regime_metrics(daily: DataFrame, labels=LABELS) -> DataFrame:
    """One row of quality figures per labelling."""
    w = series([F.lit(0)], "date")
    moved = daily.withColumns({f"__c_{c}": (~F.col(c).eqNullSafe(F.lag(c, 1).over(w))).cast("int") for c in labels})
    long = moved.withColumn("__l", F.explode(F.array(*[
        F.struct(F.lit(c).alias("labelling"), F.col(c).alias("state"), F.col(f"__c_{c}").alias("changed")) for c in labels])))
    r, risk = F.col("portfolio_return"), F.coalesce("transition_risk", F.lit(0.0))
    quiet = F.coalesce("suppression_score", F.lit(0.0)) >= 0.60
    share = lambda v: F.avg((F.col("__l.state") == v).cast("double"))
    return long.groupBy(F.col("__l.labelling").alias("labelling")).agg(
        F.avg("regime_confidence").alias("avg_confidence"), F.avg("transition_risk").alias("avg_transition_risk"),
        F.sum("__l.changed").alias("state_changes"), F.avg(F.col("__l.changed").cast("double")).alias("state_change_rate"),
        F.count_if(risk >= 0.60).alias("unstable_days"), F.count_if(r < 0).alias("bad_days"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("bad_day_loss"), F.count_if((r < 0) & quiet).alias("suppressed_bad_days"),
        share("BULL").alias("bull_share"), share("BEAR").alias("bear_share"), share("CHOP").alias("chop_share"))


# G10
def suppression_summary(daily: DataFrame) -> DataFrame:
    return daily.where(F.coalesce("suppression_score", F.lit(0.0)) >= 0.60).agg(
        F.count("*").alias("days"), F.avg("portfolio_return").alias("avg_return"),
        F.avg("transition_risk").alias("avg_transition_risk"), F.avg("news_bias").alias("avg_news_bias"))
