"""Queries J01-J13."""

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.timeseries import pct
from ..plans import tables as T
from ..plans.backtest import rebalances
from .registry import part, pick, query


@query("J01_align", pick("b_aligned", "ticker date", "open high low close volume", "idx"))
def j01(spark, sf):
    return J.align(T.panel(spark, sf), T.trading_days(spark, sf))


part("j02", """
SELECT g.ticker, g.date, (SELECT max_by(p.close, p.date) FROM b_panel p WHERE p.ticker = g.ticker AND p.date <= g.date) AS close
FROM (SELECT DISTINCT ticker, date FROM b_features) g""")


@query("J02_asof", pick("j02", "ticker date", "close"))
def j02(spark, sf):
    weeks = T.weekly_features(spark, sf).select("ticker", "date")
    return J.asof(weeks, T.panel(spark, sf), ["close"], ["ticker"])


@query("J03_with_broad", pick("b_panel p LEFT JOIN b_broad b ON b.date = p.date", "ticker=p.ticker;date=p.date",
                              "close=p.close;broad_close=b.close;broad_volume=b.volume"))
def j03(spark, sf):
    return J.with_broad(T.panel(spark, sf).select("ticker", "date", "close"), T.broad(spark, sf), ("close", "volume"))


@query("J04_with_sector", pick("b_panel p LEFT JOIN b_sectors s ON s.ticker = p.ticker AND s.sector <> 'R0'",
                               "ticker=p.ticker;date=p.date;sector=coalesce(s.sector, 'Unknown')", "close=p.close"))
def j04(spark, sf):
    return J.with_sector(T.panel(spark, sf).select("ticker", "date", "close"), T.sectors(spark, sf).where("sector <> 'R0'"))


part("j05", """
SELECT f.ticker, f.date, f.mom60, CASE WHEN g.date IS NULL THEN 0.33 ELSE p_bull END AS p_bull,
  CASE WHEN g.date IS NULL THEN 0.33 ELSE p_chop END AS p_chop, CASE WHEN g.date IS NULL THEN 0.33 ELSE p_bear END AS p_bear,
  CASE WHEN g.date IS NULL THEN 15.0 ELSE vix END AS vix, CASE WHEN g.date IS NULL THEN 0.0 ELSE macro_score END AS macro_score,
  CASE WHEN g.date IS NULL THEN 0.0 ELSE transition_risk END AS transition_risk,
  CASE WHEN g.date IS NULL THEN 0.5 ELSE regime_confidence END AS regime_confidence
FROM b_features f LEFT JOIN (SELECT * FROM b_regime WHERE regime <> 'BEAR') g ON g.date = f.date""")


@query("J05_with_regime", pick("j05", "ticker date", "mom60 p_bull p_chop p_bear vix macro_score transition_risk regime_confidence"))
def j05(spark, sf):
    known = T.weekly_regime(spark, sf).where("regime <> 'BEAR'")
    return J.with_regime(T.weekly_features(spark, sf).select("ticker", "date", "mom60"), known)


part("j02_right", "SELECT user_id, ts, max(value) AS value FROM events WHERE value > 50 GROUP BY user_id, ts")
part("j02_at", "SELECT DISTINCT user_id, ts FROM events")


@query("J02_asof_events", pick("j02_at l ASOF LEFT JOIN j02_right r ON r.user_id = l.user_id AND r.ts <= l.ts", "ts=l.ts", "known=r.value", "user_id=l.user_id"))
def j02_events(spark, sf):
    """The last large value of a user at each of the user's events, by days of a series of time stamps."""
    e = T.table(spark, sf, "events")
    large = e.where("value > 50").select("user_id", "ts", F.col("value").alias("known"))
    return J.asof(e.select("user_id", "ts").distinct(), large, ["known"], ("user_id",), "ts").select("ts", "known", "user_id")


part("j_held", "SELECT date, ticker FROM b_trades WHERE weight > 0.01")


@query("J08_held_split", pick("b_features f LEFT JOIN j_held h ON h.date = f.date AND h.ticker = f.ticker",
                              "date=f.date;ticker=f.ticker", "mom60=f.mom60", "held=CASE WHEN h.date IS NULL THEN 0 ELSE 1 END;"))
def j08(spark, sf):
    held = T.trade_log(spark, sf).where("weight > 0.01")
    return J.held_split(T.weekly_features(spark, sf).select("date", "ticker", "mom60"), held)


part("j_dates", "SELECT date, lag(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM b_trades)")
part("j09", """
SELECT d.date, t.ticker, coalesce(o.weight, 0) AS old_weight, coalesce(n.weight, 0) AS new_weight,
       coalesce(n.weight, 0) - coalesce(o.weight, 0) AS delta
FROM j_dates d CROSS JOIN (SELECT DISTINCT ticker FROM b_trades) t
LEFT JOIN b_trades n ON n.date = d.date AND n.ticker = t.ticker
LEFT JOIN b_trades o ON o.date = d.prev_date AND o.ticker = t.ticker
WHERE n.date IS NOT NULL OR o.date IS NOT NULL""")


@query("J09_weight_delta", pick("j09", "date ticker", "old_weight new_weight delta"))
def j09(spark, sf):
    t = T.trade_log(spark, sf)
    return J.weight_delta(t, rebalances(t))


part("j_daily", "SELECT date, sum(net_pnl) / 1e6 AS portfolio_return FROM b_trades GROUP BY date")
part("j_s1", "SELECT date, portfolio_return FROM b_returns WHERE strategy = 'S1' AND portfolio_return > 0")


@query("J10_prefer", pick("j_daily d LEFT JOIN j_s1 w ON w.date = d.date", "date=d.date",
                          "portfolio_return=coalesce(w.portfolio_return, d.portfolio_return)"))
def j10(spark, sf):
    daily = T.trade_log(spark, sf).groupBy("date").agg((F.sum("net_pnl") / 1e6).alias("portfolio_return"))
    weekly = T.weekly_returns(spark, sf).where("strategy = 'S1' AND portfolio_return > 0")
    return J.prefer(daily, weekly)


@query("J11_with_trace", pick("j_daily d LEFT JOIN (SELECT * FROM b_regime WHERE regime <> 'BULL') g ON g.date = d.date",
                              "date=d.date;regime=g.regime",
                              "portfolio_return=d.portfolio_return;regime_confidence_trace=g.regime_confidence;p_bull_trace=g.p_bull;"
                              "p_chop_trace=g.p_chop;p_bear_trace=g.p_bear;transition_risk_trace=g.transition_risk"))
def j11(spark, sf):
    daily = T.trade_log(spark, sf).groupBy("date").agg((F.sum("net_pnl") / 1e6).alias("portfolio_return"))
    return J.with_trace(daily, T.weekly_regime(spark, sf).where("regime <> 'BULL'"))


part("j_gappy", "SELECT * FROM b_returns WHERE NOT (strategy = 'S3' AND portfolio_return > 0.02)")
part("j12", """
SELECT strategy, date, portfolio_return FROM j_gappy WHERE date IN (
  SELECT date FROM j_gappy GROUP BY date HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM j_gappy))""")


@query("J12_common_dates", pick("j12", "strategy date", "portfolio_return"))
def j12(spark, sf):
    return J.common_dates(T.weekly_returns(spark, sf).where("NOT (strategy = 'S3' AND portfolio_return > 0.02)"))


part("j13_iv", "SELECT date AS start, lead(date) OVER (ORDER BY date) AS stop, regime FROM b_regime WHERE regime <> 'CHOP'")


@query("J13_intervals", pick("b_panel p JOIN j13_iv i ON i.start <= p.date AND (i.stop IS NULL OR p.date < i.stop)",
                             "ticker=p.ticker;date=p.date;regime=i.regime", "close=p.close"))
def j13(spark, sf):
    trace = T.weekly_regime(spark, sf).where("regime <> 'CHOP'")
    return J.in_interval(T.panel(spark, sf).select("ticker", "date", "close"), J.intervals(trace))
