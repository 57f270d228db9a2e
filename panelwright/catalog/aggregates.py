"""Queries A01-A19."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, joins as J, news as N, timeseries as W
from ..plans import tables as T
from .registry import part, pick, query
from .timeseries import aligned, with_ret


@query("A01_breadth", pick("w06 a JOIN b_aligned p ON p.ticker = a.ticker AND p.date = a.date GROUP BY a.date",
                           "date=a.date", "breadth=avg(above200)"))
def a01(spark, sf):
    return A.breadth(W.above_sma(aligned(spark, sf)))


@query("A01_breadth_listed", pick("w06 a JOIN b_aligned p ON p.ticker = a.ticker AND p.date = a.date GROUP BY a.date",
                                  "date=a.date", "breadth=avg(CASE WHEN p.close IS NOT NULL THEN above200 END)"))
def a01_listed(spark, sf):
    return A.breadth(W.above_sma(aligned(spark, sf)), listed_only=True)


@query("A02_dispersion", pick("w01 GROUP BY date", "date", "cross_dispersion=CASE WHEN count(mom20) > 10 THEN stddev_pop(mom20) END"))
def a02(spark, sf):
    return A.dispersion(W.pct(aligned(spark, sf), "close", 20, "mom20"))


part("a_sr", "SELECT r.*, coalesce(s.sector, 'Unknown') AS sector FROM b_ret r LEFT JOIN b_sectors s ON s.ticker = r.ticker AND s.sector <> 'R0'")
part("a03", """SELECT sector, date, avg(ret) AS sector_ret FROM a_sr WHERE sector <> 'Unknown' GROUP BY sector, date
  UNION ALL SELECT 'Unknown', date, avg(ret) FROM a_sr GROUP BY date""")


def ret_by_sector(spark, sf):
    return J.with_sector(with_ret(spark, sf), T.sectors(spark, sf).where("sector <> 'R0'"))


@query("A03_sector_returns", pick("a03", "sector date", "sector_ret"))
def a03(spark, sf):
    return A.sector_returns(ret_by_sector(spark, sf))


part("a04", "SELECT ticker, date, sector, avg(ret) OVER (PARTITION BY date, sector) AS sector_mean FROM a_sr")


@query("A04_sector_mean", pick("a04", "ticker date sector", "sector_mean"))
def a04(spark, sf):
    return A.sector_mean(ret_by_sector(spark, sf), "ret", "sector_mean").select("ticker", "date", "sector", "sector_mean")


MEANS = "regime_confidence regime_score p_bull p_chop p_bear transition_risk breadth macro_score news_bias suppression_score".split()
part("a_mode", """SELECT date, market_state FROM (SELECT date, market_state, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, market_state) AS k
  FROM b_trades GROUP BY date, market_state) WHERE k = 1""")
part("a05_g", "SELECT date, sum(net_pnl) AS net_pnl, sum(gross_weight) AS gross_exposure, sum(weight) AS net_exposure, "
     + ", ".join(f"avg({c}) AS {c}" for c in MEANS) + """, avg(mom_z) AS avg_mom_z, avg(efficiency) AS avg_efficiency,
  coalesce(sum(net_pnl) FILTER (side = 'LONG'), 0) AS long_pnl, sum(net_pnl) / 1e6 AS portfolio_return FROM b_trades GROUP BY date""")
part("a05", "SELECT g.*, m.market_state FROM a05_g g JOIN a_mode m ON m.date = g.date")


@query("A05_daily_summary", pick("a05", "date market_state", "net_pnl gross_exposure net_exposure avg_mom_z avg_efficiency long_pnl portfolio_return " + " ".join(MEANS)))
def a05(spark, sf):
    return A.daily_summary(T.trade_log(spark, sf))


@query("A06_validation_daily", pick("a05_g", "date", "net_pnl portfolio_return " + " ".join(c for c in MEANS if c != "macro_score")))
def a06(spark, sf):
    return A.validation_daily(T.trade_log(spark, sf))


ACTIVE = "(SELECT * FROM b_trades WHERE abs(weight) > 1e-12)"


@query("A07_regime_breakdown", pick(f"{ACTIVE} GROUP BY market_state", "market_state",
                                    "pnl=sum(net_pnl);gross=avg(gross_weight);net=avg(weight);avg_conf=avg(regime_confidence);avg_momz=avg(mom_z)", "trades=count(net_pnl)"))
def a07(spark, sf):
    return A.regime_breakdown(T.trade_log(spark, sf).where("abs(weight) > 1e-12"))


@query("A08_side_breakdown", pick(f"{ACTIVE} GROUP BY side", "side", "pnl=sum(net_pnl);avg_w=avg(weight)", "trades=count(net_pnl)"))
def a08(spark, sf):
    return A.side_breakdown(T.trade_log(spark, sf).where("abs(weight) > 1e-12"))


part("a09_d", "SELECT market_state AS regime, count(*) AS days FROM a_mode WHERE date > DATE '1999-01-01' GROUP BY market_state")
part("a09_p", "SELECT market_state AS regime, sum(net_pnl) AS pnl FROM b_trades WHERE date > DATE '1999-01-01' AND abs(weight) > 1e-12 GROUP BY market_state")


@query("A09_regime_counts", pick("a09_d d FULL JOIN a09_p p ON p.regime = d.regime", "regime=coalesce(d.regime, p.regime)", "pnl=p.pnl", "days=d.days"))
def a09(spark, sf):
    return A.regime_counts(T.trade_log(spark, sf), "1999-01-01")


part("a_ts", "SELECT t.*, s.sector FROM b_trades t JOIN b_sectors s ON s.ticker = t.ticker")
part("a_dsw", "SELECT date, sector, sum(abs(weight)) AS w FROM a_ts GROUP BY date, sector")
part("a10", "SELECT sector, avg(w) AS avg_weight FROM a_dsw GROUP BY sector ORDER BY avg_weight DESC, sector LIMIT 3")


def trades_by_sector(spark, sf):
    return J.with_sector(T.trade_log(spark, sf), T.sectors(spark, sf))


@query("A10_sector_weights", pick("a10", "sector", "avg_weight"))
def a10(spark, sf):
    return A.sector_weights(trades_by_sector(spark, sf), 3)


@query("A11_cap_breaches", pick("a_dsw", "", "", "breaches=count_if(w > 0.25 + 1e-4);groups=count(*)"))
def a11(spark, sf):
    return A.cap_breaches(trades_by_sector(spark, sf))


@query("A12_sleeve_audit", pick("b_trades", "", "mean_weight=avg(weight);max_weight=max(weight);min_weight=min(weight)",
                                "weeks=count(DISTINCT date);breaches=count_if(weight > 0.05 + 1e-4)", "ticker = 'N7'"))
def a12(spark, sf):
    return A.sleeve_audit(T.trade_log(spark, sf), "N7", 0.05)


STATES = ("BULL", "CHOP", "BEAR")


def counts(col):
    return ";".join(f"{s}=count_if({col} = '{s}')" for s in STATES)


@query("A13_crosstab", pick("b_trades GROUP BY side", "side", "", counts("market_state")))
def a13(spark, sf):
    return A.crosstab(T.trade_log(spark, sf), "side", "market_state", STATES)


part("a14", "SELECT regime, lag(regime) OVER (ORDER BY date) AS from_state FROM b_regime")


@query("A14_transitions", pick("a14 WHERE from_state IS NOT NULL GROUP BY from_state", "from_state", "", counts("regime")))
def a14(spark, sf):
    return A.transitions(T.weekly_regime(spark, sf), "regime", STATES)


part("a15_d", "SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back FROM (SELECT DISTINCT date FROM b_trades) QUALIFY back < 11")
part("a15", "SELECT sector, " + ", ".join(f"coalesce(avg(score) FILTER (back = {k}), 0) AS t_{k}" for k in range(11))
     + " FROM a_ts JOIN a15_d ON a15_d.date = a_ts.date GROUP BY sector")


@query("A15_heatmap", pick("a15", "sector", " ".join(f"t_{k}" for k in range(11))))
def a15(spark, sf):
    return A.heatmap(trades_by_sector(spark, sf))


@query("A17_label_counts", pick("w27 GROUP BY ALL", "regime_label=CASE WHEN fwd_ret_5 > 0.0075 THEN 'BULL' WHEN fwd_ret_5 < -0.0075 THEN 'BEAR' ELSE 'CHOP' END", "", "n=count(*)"))
def a17(spark, sf):
    from .timeseries import market
    return A.label_counts(W.forward_label(market(spark, sf), by=("role",)), "regime_label")


part("a18_e", "SELECT min(portfolio_return) AS lo, max(portfolio_return) AS hi, count(*) AS n FROM b_returns")
part("a18_b", "SELECT least(floor((portfolio_return - lo) / ((hi - lo) / 60.0)), 59) AS bin, lo, (hi - lo) / 60.0 AS w, n FROM b_returns, a18_e")


@query("A18_histogram", pick("a18_b GROUP BY bin, lo, w, n", "", "edge=lo + bin * w;density=count(*) / (n * w)", "bin;n=count(*)"))
def a18(spark, sf):
    return A.histogram(T.weekly_returns(spark, sf), "portfolio_return", 60)


part("a19", """SELECT date, count_if(abs(weight) > 1e-12) AS a, count_if(weight > 0) AS l, count_if(weight < 0) AS s, sum(gross_weight) AS g,
  sum(weight) AS net, sum(net_pnl) AS p FROM b_trades GROUP BY date""")


@query("A19_activity", pick("a19", "", "avg_gross=avg(g);avg_net=avg(net);sum_pnl=sum(p)", "active_rows=sum(a);dates=count(*);long_rows=sum(l);short_rows=sum(s)"))
def a19(spark, sf):
    return A.activity(T.trade_log(spark, sf))
