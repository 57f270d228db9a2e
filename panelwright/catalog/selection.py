"""Queries F01-F15 (without news), W19, W20 and K01-K06."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import filters as S, joins as J, portfolio as P, xsection as C
from ..plans import tables as T
from ..plans.backtest import store_scores
from ..session import materialise
from .registry import part, pick, query

ALIASES = [("broad", "n0", 1), ("risk", "N 7", 1), ("fear", "n-9", 2), ("gold", "N12", 1), ("gold", "missing", 2)]


def aliases(spark):
    return spark.createDataFrame(ALIASES, "role STRING, candidate STRING, priority INT")


@query("F01_exclude", pick("b_panel", "ticker date", "close", "", "lower(ticker) NOT IN ('n0', 'n12')"))
def f01(spark, sf):
    return S.exclude(T.panel(spark, sf), aliases(spark)).select("ticker", "date", "close")


@query("F02_min_history", pick("b_panel", "ticker date", "close", "",
                               "ticker IN (SELECT ticker FROM b_panel GROUP BY ticker HAVING count(close) >= 1500)"))
def f02(spark, sf):
    return S.min_history(T.panel(spark, sf), 1500).select("ticker", "date", "close")


LIQUID = "open IS NOT NULL AND adv20 >= 100 AND close >= 4000"


@query("F03_liquid", pick("b_features", "ticker date", "adv20 close", "", LIQUID))
def f03(spark, sf):
    return S.liquid(T.weekly_features(spark, sf), 100.0, 4000.0).select("ticker", "date", "adv20", "close")


@query("F04_complete", pick("w01 m JOIN w03 v ON v.ticker = m.ticker AND v.date = m.date JOIN w15 d ON d.ticker = m.ticker AND d.date = m.date",
                            "ticker=m.ticker;date=m.date", "mom60;vol20;max_dd", "", "mom60 IS NOT NULL AND vol20 IS NOT NULL AND max_dd IS NOT NULL"))
def f04(spark, sf):
    from ..operators import timeseries as W
    from .timeseries import with_ret
    df = W.pct(W.trailing_max_dd(W.vol(with_ret(spark, sf), "ret", {20: 10})), "close", 60, "mom60")
    return S.complete(df, ["mom60", "vol20", "max_dd"]).select("ticker", "date", "mom60", "vol20", "max_dd")


part("w19", """SELECT ticker, date, (mom20 - avg(mom20) OVER (PARTITION BY date)) / (stddev_samp(mom20) OVER (PARTITION BY date) + 1e-9) AS cs_z_mom20,
  (mom60 - avg(mom60) OVER (PARTITION BY date)) / (stddev_samp(mom60) OVER (PARTITION BY date) + 1e-9) AS cs_z_mom60 FROM b_features""")


@query("W19_cs_z", pick("w19", "ticker date", "cs_z_mom20 cs_z_mom60"))
def w19(spark, sf):
    return C.cs_z(T.weekly_features(spark, sf), ["mom20", "mom60"]).select("ticker", "date", "cs_z_mom20", "cs_z_mom60")


def rank_sql(v, asc=True, x="date"):
    """Average-method percentile rank by self-counting windows."""
    return (f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {x} ORDER BY {v} {'ASC' if asc else 'DESC'} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {x}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {x}) END")


part("w20", f"SELECT ticker, date, {rank_sql('vol20_z')} AS up, {rank_sql('vol20_z', False)} AS down, {rank_sql('above200')} AS ties FROM b_features")


@query("W20_cs_rank", pick("w20", "ticker date", "up down ties"))
def w20(spark, sf):
    cols = {"up": ("vol20_z", True), "down": ("vol20_z", False), "ties": ("above200", True)}
    return C.cs_rank(T.weekly_features(spark, sf).select("ticker", "date", "vol20_z", "above200"), cols).select("ticker", "date", *cols)


@query("W20_cs_rank_split", pick("w20", "ticker date", "up down ties"))
def w20_split(spark, sf):
    cols = {"up": ("vol20_z", True), "down": ("vol20_z", False), "ties": ("above200", True)}
    rows = T.weekly_features(spark, sf).select("ticker", "date", "vol20_z", "above200")
    return C.cs_rank(rows, cols, split_rows=4).select("ticker", "date", *cols)


# scores in SQL: ranks with their fallbacks, penalties, weights
RANKED = "fip fip_z mom20 mom60 csz20 csz60 vol20 vol20_z beta adv20 structure_score rsi14".split()
part("s_in", """SELECT f.*, z.cs_z_mom20 AS csz20, z.cs_z_mom60 AS csz60,
  CASE WHEN structure = 'VACUUM' AND mom20 > 0 AND above200 >= 0.5 THEN 1.0 WHEN structure = 'VACUUM' THEN 0.7 ELSE 0.35 END::DOUBLE AS structure_score,
  CASE WHEN rsi14 > 75 THEN -0.15 WHEN rsi14 > 70 THEN -0.05 ELSE 0 END::DOUBLE AS pen_long,
  CASE WHEN rsi14 < 25 THEN -0.15 WHEN rsi14 < 30 THEN -0.05 ELSE 0 END::DOUBLE AS pen_short,
  CASE WHEN mom5 < -0.08 THEN -0.10 WHEN mom5 < -0.04 THEN -0.05 ELSE 0 END::DOUBLE AS pen_mom5
  FROM b_features f JOIN w19 z ON z.ticker = f.ticker AND z.date = f.date""")
part("s_rank", "SELECT *, " + ", ".join(f"{rank_sql(c)} AS r_{c}" for c in RANKED)
     + f", {rank_sql('r2')} AS p_r2, {rank_sql('vol252', False)} AS p_vol, {rank_sql('max_dd')} AS p_dd FROM s_in")
part("s_raw", """SELECT *,
  0.28*coalesce(r_csz60, r_mom60) + 0.18*coalesce(r_csz20, r_mom20) + 0.10*coalesce(r_fip_z, r_fip) + 0.10*r_structure_score
  + 0.12*(1-coalesce(r_vol20_z, r_vol20)) + 0.06*(1-coalesce(r_beta, 0.5)) + 0.06*r_adv20 + 0.10*(1-coalesce(r_rsi14, 0.5)) + pen_long + pen_mom5 AS long_score,
  0.28*(1-coalesce(r_csz60, r_mom60)) + 0.18*(1-coalesce(r_csz20, r_mom20)) + 0.10*(1-coalesce(r_fip_z, r_fip)) + 0.10*(1-r_structure_score)
  + 0.14*coalesce(r_vol20_z, r_vol20) + 0.10*coalesce(r_beta, 0.5) + 0.05*(1-r_adv20) + 0.05*coalesce(r_rsi14, 0.5) + pen_short AS short_score,
  0.4*coalesce(p_r2, 0.5) + 0.3*coalesce(p_vol, 0.5) + 0.3*coalesce(p_dd, 0.5) AS defensive_score FROM s_rank""")
part("s_scored", "SELECT * REPLACE (round(long_score, 9) AS long_score, round(short_score, 9) AS short_score, round(defensive_score, 9) AS defensive_score) FROM s_raw")


def scored(spark, sf):
    return store_scores(T.weekly_features(spark, sf))


part("f_state", "SELECT date, regime, transition_risk, suppression_score FROM b_regime")
part("f_reg", "SELECT s.*, g.regime, g.transition_risk, g.suppression_score FROM s_scored s JOIN f_state g ON g.date = s.date")


def scored_regime(spark, sf):
    g = T.weekly_regime(spark, sf).select("date", "regime", "transition_risk", "suppression_score")
    return scored(spark, sf).join(F.broadcast(g), "date")


part("f05", """SELECT * FROM f_reg JOIN (SELECT date AS d, quantile_cont(long_score, 0.5) AS med FROM s_scored GROUP BY date) ON d = date
  WHERE mom60 > 0 AND long_score >= med AND mom5 > -0.10""")


@query("F05_long_pool", pick("f05", "ticker date", "long_score"))
def f05(spark, sf):
    return S.long_pool(scored_regime(spark, sf)).select("ticker", "date", "long_score")


part("f06_a", """SELECT * FROM f_reg JOIN (SELECT date AS d, quantile_cont(short_score, 0.8) AS q80 FROM s_scored GROUP BY date) ON d = date
  WHERE mom60 < 0 AND above200 < 0.5 AND short_score >= q80 AND regime <> 'BULL'""")
part("f06", """SELECT a.* FROM f06_a a JOIN (SELECT date AS d2, quantile_cont(short_score, 0.9) AS q90 FROM f06_a GROUP BY date) ON d2 = a.date
  WHERE regime <> 'CHOP' OR short_score >= q90""")


@query("F06_short_pool", pick("f06", "ticker date regime", "short_score"))
def f06(spark, sf):
    return S.short_pool(scored_regime(spark, sf)).select("ticker", "date", "regime", "short_score")


part("f07", """SELECT * FROM f05 QUALIFY NOT (suppression_score >= 0.60 OR transition_risk >= 0.75)
  OR row_number() OVER (PARTITION BY date ORDER BY round(long_score, 9) DESC, ticker) <= 5""")


@query("F07_suppress", pick("f07", "ticker date", "long_score"))
def f07(spark, sf):
    return S.suppress(S.long_pool(scored_regime(spark, sf)), 5).select("ticker", "date", "long_score")


@query("F08_defensive_pool", pick("w03 v JOIN w15 d ON d.ticker = v.ticker AND d.date = v.date JOIN w16 r ON r.ticker = v.ticker AND r.date = v.date",
                                  "ticker=v.ticker;date=v.date", "vol252;max_dd;r2", "", "vol252 IS NOT NULL AND max_dd IS NOT NULL AND r2 IS NOT NULL"))
def f08(spark, sf):
    from ..operators import timeseries as W
    from .timeseries import with_ret
    df = W.trend_r2(W.trailing_max_dd(W.vol(with_ret(spark, sf), "ret", {252: 126})))
    return S.defensive_pool(df).select("ticker", "date", "vol252", "max_dd", "r2")


part("f09", "SELECT ticker, date, (p - avg(p) OVER (PARTITION BY date)) / (stddev_samp(p) OVER (PARTITION BY date) + 1e-9) AS pred_z FROM (SELECT *, abs(mom60_z) AS p FROM b_features)")


@query("F09_confidence_filter", pick("f09", "ticker date", "pred_z", "", "pred_z >= 0.5"))
def f09(spark, sf):
    return S.confidence_filter(T.weekly_features(spark, sf), "mom60_z", 0.5).select("ticker", "date", "pred_z")


WINDOWS = [("validation", "1996-01-01", "1998-12-31"), ("frozen", "1999-01-01", None), ("full", "1996-01-01", None), ("forward", "2001-06-01", None)]
part("f10_w", " UNION ALL ".join(f"SELECT '{n}' AS window_name, DATE '{a}' AS a, DATE '{b or '9999-12-31'}' AS b" for n, a, b in WINDOWS))


@query("F10_split_windows", pick("b_returns r JOIN f10_w w ON r.date BETWEEN w.a AND w.b", "strategy;date;\"window\"=window_name", "portfolio_return"))
def f10(spark, sf):
    return S.split_windows(T.weekly_returns(spark, sf), WINDOWS)


@query("F11_active", pick("b_trades", "ticker date", "weight", "", "abs(weight) > 1e-12"))
def f11(spark, sf):
    return S.active(T.trade_log(spark, sf)).select("ticker", "date", "weight")


@query("F13_as_of_cutoff", pick("b_articles", "", "", "doc_id", "published_at <= TIMESTAMP '2024-01-15 09:00:00' - INTERVAL 330 MINUTE"))
def f13(spark, sf):
    return S.as_of_cutoff(T.articles(spark, sf).select("doc_id", "published_at"), "2024-01-15 09:00:00").select("doc_id")


@query("F14_winsor", pick("b_features", "ticker date", "fwd_ret=least(greatest(fwd_ret, -0.05), 0.06)"))
def f14(spark, sf):
    return S.winsor(T.weekly_features(spark, sf), "fwd_ret", -0.05, 0.06).select("ticker", "date", "fwd_ret")


@query("F15_floor_weights", pick("b_trades", "ticker date", "weight", "", "weight > 0.001"))
def f15(spark, sf):
    return S.floor_weights(T.trade_log(spark, sf)).select("ticker", "date", "weight")


part("k01", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom60 DESC, ticker) AS place FROM b_features")


@query("K01_top_k", pick("k01", "ticker date", "mom60", "place", "place <= 10"))
def k01(spark, sf):
    return C.top_k(T.weekly_features(spark, sf).select("ticker", "date", "mom60"), "mom60", 10, rank="place")


part("k02", """(SELECT *, 'best' AS kind FROM b_trades WHERE abs(weight) > 1e-12 ORDER BY net_pnl DESC, date, ticker LIMIT 10)
  UNION ALL (SELECT *, 'worst' AS kind FROM b_trades WHERE abs(weight) > 1e-12 ORDER BY net_pnl, date, ticker LIMIT 10)""")


@query("K02_extreme_trades", pick("k02", "kind date ticker market_state", "net_pnl weight"))
def k02(spark, sf):
    return C.extreme_trades(S.active(T.trade_log(spark, sf))).select("kind", "date", "ticker", "market_state", "net_pnl", "weight")


@query("K03_latest", pick("b_trades", "date ticker side market_state", "weight close fwd_return net_pnl score", "",
                          "date = (SELECT max(date) FROM b_trades) AND abs(weight) > 1e-12"))
def k03(spark, sf):
    return S.active(C.latest(T.trade_log(spark, sf))).select("date", "ticker", "side", "market_state", "weight", "close", "fwd_return", "net_pnl", "score")


part("k04", "SELECT * FROM b_trades ORDER BY date DESC, ticker DESC LIMIT 20")


@query("K04_last_rows", pick("k04", "date ticker", "weight"))
def k04(spark, sf):
    return C.last_rows(T.trade_log(spark, sf).select("date", "ticker", "weight"), 20, ("date", "ticker"))


part("k05", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom60_z DESC, ticker) AS place FROM b_features WHERE mom60_z IS NOT NULL")


@query("K05_topk_mean", pick("k05 WHERE place <= 20 GROUP BY date", "date", "mean_ret=avg(fwd_ret)", "names=count(*)"))
def k05(spark, sf):
    return C.topk_mean(T.weekly_features(spark, sf), "mom60_z", "fwd_ret")


@query("K06_margin", pick("b_regime", "date", "margin=list_reverse_sort([p_bull, p_chop, p_bear])[1] - list_reverse_sort([p_bull, p_chop, p_bear])[2];"))
def k06(spark, sf):
    return T.weekly_regime(spark, sf).select("date", C.margin(["p_bull", "p_chop", "p_bear"]).alias("margin"))


# weekly leaders: the flagship plan from raw lines to names
part("lead_r", f"""SELECT m.ticker, m.date, m.mom60, v.vol20, {rank_sql('m.mom60', True, 'm.date')} AS rank_mom60
  FROM w01 m JOIN b_rebal r ON r.date = m.date JOIN w03 v ON v.ticker = m.ticker AND v.date = m.date WHERE m.mom60 IS NOT NULL""")
part("lead", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank_mom60 DESC, ticker) AS place FROM lead_r")


@query("research_weekly_leaders", pick("lead", "ticker date", "mom60 vol20 rank_mom60", "place", "place <= 20"))
def leaders(spark, sf):
    """Panel, 60-row momentum, 20-row deviation, percentile rank on rebalance dates, best 20 names."""
    from ..operators import timeseries as W
    cal = T.trading_days(spark, sf)
    df = J.align(T.panel(spark, sf), cal)
    df = W.vol(W.pcts(df, {"ret": ("close", 1), "mom60": ("close", 60)}), "ret", {20: 10})
    weekly = df.join(F.broadcast(W.rebalance_dates(cal).select("date")), "date", "left_semi").where("mom60 IS NOT NULL")
    stored = materialise(weekly.select("ticker", "date", "mom60", "vol20"), "weekly")  # read for the ranks and for the rows
    ranked = C.cs_rank(stored, {"rank_mom60": ("mom60", True)})
    return C.top_k(ranked, "rank_mom60", 20, rank="place")
