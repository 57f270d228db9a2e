"""The whole run on the price panel, from bars to weekly returns."""

from ..plans import research as R, tables as T
from .portfolio import SCENARIOS, SHORTS
from .registry import clone, part, pick, query
from .selection import aliases

MIN_ADV, MIN_PRICE, MIN_HISTORY = 40.0, 500.0, 220
part("x_kept", f"SELECT ticker FROM b_panel GROUP BY ticker HAVING count(close) >= {MIN_HISTORY} AND lower(ticker) NOT IN ('n0', 'n12')")
part("x_fz", """SELECT ticker, date, fip, (fip - avg(fip) OVER w) / nullif(stddev_samp(fip) OVER w, 0) AS z, count(fip) OVER w AS c FROM w12
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""")
part("x_vz", """SELECT ticker, date, CASE WHEN count(vol20) OVER w >= 20 THEN (vol20 - avg(vol20) OVER w) / nullif(stddev_samp(vol20) OVER w, 0) END AS z FROM w03
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""")
part("x_rsi", "SELECT ticker, date, 100 - 100 / (1 + up / (down + 1e-9)) AS rsi14 FROM w10")
ON = "{0}.ticker = a.ticker AND {0}.date = a.date"
JOINS = " ".join(f"JOIN {t} {a} ON {ON.format(a)}" for t, a in (
    ("w01", "m"), ("w03", "v"), ("w04", "z"), ("w05", "q"), ("w06", "u"), ("w07", "s"), ("w08", "b"), ("x_rsi", "i"), ("x_fz", "f"), ("x_vz", "vz"), ("w13", "e"),
    ("w15", "dd"), ("w16", "rr")))
part("x_all", f"""SELECT a.ticker, r.date, a.close, a.open, m.mom5, m.mom20, m.mom60, z.mom20_z, z.mom60_z, v.vol20, vz.z AS vol20_z, q.adv20, q.rvol20, b.beta, u.above200, s.structure,
   f.fip, CASE WHEN f.c >= 20 THEN f.z END AS fip_z, i.rsi14, v.vol252, dd.max_dd, rr.r2, e.er20, v.vol20 / (v.vol100 + 1e-9) AS vol_comp, m.mom20 - x.bm AS excess20
   FROM b_aligned a JOIN b_rebal r ON r.idx - 1 = a.idx JOIN x_kept k ON k.ticker = a.ticker {JOINS} JOIN w18_b x ON x.date = a.date""")
part("x_features", f"""SELECT * FROM x_all WHERE open IS NOT NULL AND adv20 >= {MIN_ADV} AND close >= {MIN_PRICE} AND fip IS NOT NULL AND mom60 IS NOT NULL AND vol20 IS NOT NULL
   AND vol252 IS NOT NULL AND max_dd IS NOT NULL AND r2 IS NOT NULL AND er20 IS NOT NULL AND vol_comp IS NOT NULL AND rvol20 IS NOT NULL AND excess20 IS NOT NULL""")
# weekly regime: the daily inputs of the day before, chained week to week
part("x_breadth", "SELECT u.date, avg(above200) AS breadth FROM w06 u JOIN x_kept k ON k.ticker = u.ticker GROUP BY u.date")
part("x_sig", "SELECT r.date, c.date AS signal FROM b_rebal r JOIN b_cal c ON c.idx = r.idx - 1")


clone(["g03", "g04_l", "g04_e", "g04_p", "g04"], {"w_breadth": "x_breadth"}, "x_")
part("x_week", "SELECT p.* EXCLUDE (date), s.date FROM x_g04 p JOIN x_sig s ON s.signal = p.date")
clone(["g05", "g06"], {"g04": "x_week"}, "x_")
clone(["w19", "s_in", "s_rank", "s_raw", "s_scored", "f_reg", "f05", "f06_a", "f06", "p_long", "p_cand", "p_turns", "p_lists", "p_walk", "p_held", "p_sh", "p_sleeves", "p_counts", "p07_in", "p07_raw", "p07_t", "p07", "p_sized", "p09_a", "p09_b", "p09",
       *[f"p10_{k}{i}" for i in range(1, 6) for k in "cns"], *[f"p10_r{i}" for i in range(6)], "p11", "u02", "p12_w", "p12", "p13_in", "p13_s", "p13", "p_books", "p14_d", "p14", "p15", "p16_w"],
      {"b_features": "x_features", "b_regime": "x_g06", "p_dates": "x_dates", "p15_px": "x_px", "f_state": "x_state"}, "x_")
part("x_state", "SELECT date, regime, transition_risk, 0.0 AS suppression_score FROM x_g06")
part("x_px", "SELECT date, ticker, open FROM b_aligned UNION ALL SELECT date, 'GOLDBEES', open FROM b_rolegrid WHERE role = 'gold'")
part("x_dates", "SELECT date, next_date FROM b_rebal")


def run(spark, sf):
    return R.backtest_run(T.panel(spark, sf), T.roles(spark, sf), T.trading_days(spark, sf), T.sectors(spark, sf), SCENARIOS, MIN_ADV, MIN_PRICE, MIN_HISTORY, SHORTS, aliases(spark))


@query("research_book", pick("x_p13", "scenario date ticker side sleeve sector", "weight"))
def research_book(spark, sf):
    return run(spark, sf)["book"].select("scenario", "date", "ticker", "side", "sleeve", "sector", "weight")


@query("research_weekly_returns", pick("x_p16_w", "scenario date", "gross_exposure;net_exposure;turnover;portfolio_return=(gross_pnl - friction_cost) / 1e6"))
def research_weekly(spark, sf):
    return run(spark, sf)["weekly"].select("scenario", "date", "gross_exposure", "net_exposure", "turnover", "portfolio_return")


part("x_trades", f"""SELECT scenario, date, ticker, side, weight, fwd_return FROM x_p15 UNION ALL SELECT s.scenario, g.date, 'CASH', 'CASH', 0.0, NULL FROM x_g06 g CROSS JOIN p_scen s
  WHERE NOT EXISTS (SELECT 1 FROM x_p13 b WHERE b.scenario = s.scenario AND b.date = g.date)""")


@query("research_trades", pick("x_trades", "scenario date ticker side", "weight fwd_return"))
def research_trades(spark, sf):
    """The trade log, with a CASH row where a scenario has no book."""
    return run(spark, sf)["trades"].select("scenario", "date", "ticker", "side", "weight", "fwd_return")
