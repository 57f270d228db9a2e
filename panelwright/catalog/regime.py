"""Queries G01-G10."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, regime as G, timeseries as W
from ..plans import tables as T
from ..session import materialise
from .registry import part, pick, query
from .timeseries import RO, aligned, gate, market

part("g_fill", f"SELECT role, date, idx, last_value(close IGNORE NULLS) OVER ({RO}) AS close FROM b_rolegrid")
part("g_ret", f"SELECT *, close / nullif(lag(close) OVER ({RO}), 0) - 1 AS ret1, abs(close - lag(close) OVER ({RO})) AS ad FROM g_fill")
part("g_roll", f"""SELECT *, {gate('avg', 'close', 50, 25, RO)} AS sma50, {gate('avg', 'close', 200, 100, RO)} AS sma200,
  {gate('stddev_samp', 'ret1', 20, 10, RO)} * sqrt(252.0) AS vol20, {gate('avg', 'ret1', 20, 10, RO)} AS ret20,
  abs(close - lag(close, 100) OVER ({RO})) / ({gate('sum', 'ad', 100, 33, RO)} + 1e-9) AS e100,
  (ln(nullif(close, 0)) - ln(nullif(lag(close, 100) OVER ({RO}), 0))) / 100.0 AS slope100 FROM g_ret""")
part("g_frame", f"""SELECT *, CASE WHEN e100 IS NOT NULL THEN least(greatest(e100, 0), 1) END AS eff100,
  (ret20 - {gate('avg', 'ret20', 60, 20, RO)}) / nullif({gate('stddev_samp', 'ret20', 60, 20, RO)}, 0) AS mom20_z,
  (vol20 - {gate('avg', 'vol20', 60, 20, RO)}) / nullif({gate('stddev_samp', 'vol20', 60, 20, RO)}, 0) AS vol_z FROM g_roll""")


@query("G01_market_frame", pick("g_frame", "role date", "close ret1 sma50 sma200 vol20 eff100 slope100 mom20_z vol_z"))
def g01(spark, sf):
    return G.market_frame(market(spark, sf)).select("role", "date", "close", "ret1", "sma50", "sma200", "vol20", "eff100", "slope100", "mom20_z", "vol_z")


def of(role, col):
    return f"max({col}) FILTER (role = '{role}')"


part("g_wide", f"""SELECT date, {of('broad', 'close')} AS price, {of('broad', 'sma200')} AS sma200, {of('broad', 'eff100')} AS eff100,
  {of('broad', 'slope100')} AS slope100, {of('broad', 'mom20_z')} AS mom20_z, {of('risk', 'close')} AS risk_close, {of('risk', 'sma50')} AS risk_sma50,
  {of('fear', 'close')} AS vix, {of('usd', 'ret20')} AS u, {of('us10y', 'ret20')} AS y, {of('gold', 'ret20')} AS g FROM g_frame GROUP BY date""")
part("g02", """SELECT *, CASE WHEN k = 0 THEN 0 ELSE (coalesce(-u, 0) + coalesce(-y, 0) + coalesce(g, 0) + coalesce(-0.02 * (vix - 20), 0)) / k END AS macro_score FROM (
  SELECT *, (u IS NOT NULL)::INT + (y IS NOT NULL)::INT + (g IS NOT NULL)::INT + (vix IS NOT NULL)::INT AS k FROM g_wide)""")


@query("G02_macro_score", pick("g02", "date", "vix macro_score"))
def g02(spark, sf):
    return G.macro_score(G.market_wide(G.market_frame(market(spark, sf)))).select("date", "vix", "macro_score")


part("g03", """SELECT date, macro_score, vix, breadth, enough, CASE WHEN enough THEN a ELSE 0 END AS above_sma,
  CASE WHEN enough THEN 1.5 * a + 0.4 * tanh(slope100 * 20) + 0.3 * tanh(eff100 - 0.15) + 0.3 * tanh(mom20_z / 2) ELSE 0 END AS trend_score,
  CASE WHEN enough THEN coalesce((breadth - 0.43) * 3, 0) ELSE 0 END AS breadth_score,
  CASE WHEN enough THEN coalesce(CASE WHEN vix <= 10 THEN 0.6 WHEN vix <= 16 THEN 0.6 - (vix - 10) * 0.3 / 6 WHEN vix <= 22 THEN 0.3 - (vix - 16) * 0.3 / 6
    WHEN vix <= 30 THEN -(vix - 22) * 0.5 / 8 WHEN vix <= 45 THEN -0.5 - (vix - 30) * 0.5 / 15 WHEN vix > 45 THEN -1.0 END, 0)
    - CASE WHEN risk_close < risk_sma50 THEN 0.3 ELSE 0 END ELSE 0 END AS risk_score
FROM (SELECT m.*, b.breadth, sma200 IS NOT NULL AND eff100 IS NOT NULL AND slope100 IS NOT NULL AND mom20_z IS NOT NULL AS enough,
        CASE WHEN price >= sma200 THEN 1.0 ELSE -1.0 END AS a FROM g02 m LEFT JOIN w_breadth b ON b.date = m.date)""")
part("g04_l", """SELECT *, 1.35*above_sma + 1.10*trend_score + 0.65*breadth_score + 0.45*risk_score + 0.35*tanh(macro_score*8) AS l1,
  -0.55*abs(above_sma) - 0.45*abs(trend_score) - 0.30*abs(breadth_score) + 0.30*(1-abs(risk_score)) + 0.15 AS l2,
  -1.35*above_sma - 0.90*trend_score - 0.55*breadth_score - 0.70*risk_score - 0.30*tanh(macro_score*8) AS l3 FROM g03""")
part("g04_e", "SELECT *, exp((l1 - greatest(l1, l2, l3)) / 5) AS e1, exp((l2 - greatest(l1, l2, l3)) / 5) AS e2, exp((l3 - greatest(l1, l2, l3)) / 5) AS e3 FROM g04_l")
part("g04_p", """SELECT *, greatest(p_bull, p_chop, p_bear) AS p1, p_bull + p_chop + p_bear - greatest(p_bull, p_chop, p_bear) - least(p_bull, p_chop, p_bear) AS p2
  FROM (SELECT *, e1 / (e1 + e2 + e3) AS p_bull, e2 / (e1 + e2 + e3) AS p_chop, e3 / (e1 + e2 + e3) AS p_bear FROM g04_e)""")
part("g04", """SELECT *, least(greatest(p1 - p2 + 0.35 * p1, 0), 1) AS regime_confidence, least(greatest(1 - abs(p_bull - p_bear), 0), 1) AS instability,
  p_bull - p_bear AS regime_score, CASE WHEN p_bull = p1 THEN 'BULL' WHEN p_chop = p1 THEN 'CHOP' ELSE 'BEAR' END AS selected FROM g04_p""")
part("g05", """SELECT *, least(greatest(CASE WHEN b IS NULL THEN 0.35 * instability + 0.20 * (1 - regime_confidence)
   ELSE 0.45 * (abs(p_bull - b) + abs(p_chop - c) + abs(p_bear - r)) / 2 + 0.20 * instability + 0.15 * (1 - regime_confidence) END, 0), 1) AS transition_risk
  FROM (SELECT *, lag(p_bull) OVER (ORDER BY date) AS b, lag(p_chop) OVER (ORDER BY date) AS c, lag(p_bear) OVER (ORDER BY date) AS r FROM g04)""")
part("g06", """SELECT *, CASE WHEN enough AND selected = 'BULL' AND breadth >= 0.40 THEN 'BULL'
   WHEN enough AND selected = 'BEAR' AND (breadth < 0.25 OR vix >= 28) THEN 'BEAR' ELSE 'CHOP' END AS regime FROM g05""")


def breadth(spark, sf):
    return A.breadth(W.above_sma(aligned(spark, sf)))


def inputs(spark, sf):
    return G.regime_inputs(G.macro_score(G.market_wide(G.market_frame(market(spark, sf)))), breadth(spark, sf))


@query("G03_regime_inputs", pick("g03", "date", "above_sma trend_score breadth_score risk_score", "enough"))
def g03(spark, sf):
    return inputs(spark, sf).select("date", "enough", "above_sma", "trend_score", "breadth_score", "risk_score")


@query("G04_regime_probs", pick("g04", "date selected", "p_bull p_chop p_bear regime_confidence instability regime_score"))
def g04(spark, sf):
    return G.regime_probs(inputs(spark, sf)).select("date", "selected", "p_bull", "p_chop", "p_bear", "regime_confidence", "instability", "regime_score")


@query("G05_transition_risk", pick("g05", "date", "transition_risk"))
def g05(spark, sf):
    return G.transition_risk(G.regime_probs(inputs(spark, sf))).select("date", "transition_risk")


part("g05_w", """SELECT *, least(greatest(CASE WHEN b IS NULL THEN 0.35 * instability + 0.20 * (1 - regime_confidence)
   ELSE 0.45 * (abs(p_bull - b) + abs(p_chop - c) + abs(p_bear - r)) / 2 + 0.20 * instability + 0.15 * (1 - regime_confidence) END, 0), 1) AS transition_risk
  FROM (SELECT p.*, lag(p_bull) OVER (ORDER BY p.date) AS b, lag(p_chop) OVER (ORDER BY p.date) AS c, lag(p_bear) OVER (ORDER BY p.date) AS r
        FROM g04 p JOIN b_rebal w ON w.date = p.date)""")


@query("G05_transition_risk_weekly", pick("g05_w", "date", "transition_risk"))
def g05_weekly(spark, sf):
    weeks = W.rebalance_dates(T.trading_days(spark, sf)).select("date")
    return G.transition_risk(G.regime_probs(inputs(spark, sf)).join(F.broadcast(weeks), "date")).select("date", "transition_risk")


@query("G06_gate", pick("g06", "date regime", "transition_risk"))
def g06(spark, sf):
    return G.classify(G.market_frame(market(spark, sf)), breadth(spark, sf)).select("date", "regime", "transition_risk")


part("g07_in", "SELECT row_number() OVER (ORDER BY date) AS i, * FROM b_regime")
part("g07_walk", """SELECT i, date, p_bull AS b, p_chop AS c, p_bear AS r,
    CASE WHEN greatest(p_bull, p_chop, p_bear) > p_chop + 0.10 THEN CASE WHEN p_bull >= p_chop AND p_bull >= p_bear THEN 'BULL' WHEN p_chop >= p_bear THEN 'CHOP' ELSE 'BEAR' END ELSE 'CHOP' END AS lab
    FROM g07_in WHERE i = 1
  UNION ALL SELECT i, date, b, c, r, CASE WHEN greatest(b, c, r) > CASE lab WHEN 'BULL' THEN b WHEN 'CHOP' THEN c ELSE r END + 0.10
      THEN CASE WHEN b >= c AND b >= r THEN 'BULL' WHEN c >= r THEN 'CHOP' ELSE 'BEAR' END ELSE lab END FROM (
    SELECT n.i, n.date, 0.35 * n.p_bull + 0.65 * w.b AS b, 0.35 * n.p_chop + 0.65 * w.c AS c, 0.35 * n.p_bear + 0.65 * w.r AS r, w.lab
    FROM g07_walk w JOIN g07_in n ON n.i = w.i + 1)""")


@query("G07_sticky", pick("g07_walk", "date;regime=lab", "p_bull=b;p_chop=c;p_bear=r"))
def g07(spark, sf):
    return G.sticky(T.weekly_regime(spark, sf).withColumn("series", F.lit("all"))).select("date", "regime", "p_bull", "p_chop", "p_bear")


part("g08", """SELECT *, CASE WHEN regime_score > 0.20 AND breadth >= 0.40 THEN 'BULL' WHEN regime_score < -0.20 AND coalesce(breadth <= 0.25, TRUE) THEN 'BEAR' ELSE 'CHOP' END AS baseline_state,
  CASE WHEN p_bull >= p_chop AND p_bull >= p_bear THEN 'BULL' WHEN p_chop >= p_bear THEN 'CHOP' ELSE 'BEAR' END AS prob_state,
  CASE WHEN q1 >= q2 AND q1 >= q3 THEN 'BULL' WHEN q2 >= q3 THEN 'CHOP' ELSE 'BEAR' END AS prob_no_news_state
  FROM (SELECT *, p_bull - 0.10 * news_bias + 0.08 * suppression_score AS q1, p_chop + 0.04 * suppression_score AS q2,
     p_bear + 0.06 * news_bias - 0.10 * suppression_score AS q3 FROM a05_g)""")


def validation(spark, sf):
    return G.relabel(A.validation_daily(T.trade_log(spark, sf)))


@query("G08_relabel", pick("g08", "date baseline_state prob_state prob_no_news_state", "regime_score"))
def g08(spark, sf):
    return validation(spark, sf).select("date", "baseline_state", "prob_state", "prob_no_news_state", "regime_score")


part("g09_l", " UNION ALL ".join(f"SELECT '{c}' AS labelling, {c} AS state, CASE WHEN {c} IS NOT DISTINCT FROM lag({c}) OVER (ORDER BY date) THEN 0 ELSE 1 END AS changed, * FROM g08"
                                for c in ("baseline_state", "prob_state", "prob_no_news_state")))


@query("G09_regime_metrics", pick("g09_l GROUP BY labelling", "labelling",
    "avg_confidence=avg(regime_confidence);avg_transition_risk=avg(transition_risk);state_change_rate=avg(changed);bad_day_loss=coalesce(sum(portfolio_return) FILTER (portfolio_return < 0), 0);"
    "bull_share=avg((state = 'BULL')::INT);bear_share=avg((state = 'BEAR')::INT);chop_share=avg((state = 'CHOP')::INT)",
    "state_changes=sum(changed);unstable_days=count_if(transition_risk >= 0.60);bad_days=count_if(portfolio_return < 0);suppressed_bad_days=count_if(portfolio_return < 0 AND suppression_score >= 0.60)"))
def g09(spark, sf):
    return G.regime_metrics(materialise(validation(spark, sf), "validation"))


@query("G10_suppression_summary", pick("g08", "", "avg_return=avg(portfolio_return);avg_transition_risk=avg(transition_risk);avg_news_bias=avg(news_bias)", "days=count(*)", "suppression_score >= 0.60"))
def g10(spark, sf):
    return G.suppression_summary(validation(spark, sf))
