"""Queries P01-P23, U01, U02, U04 and J14."""

from pyspark.sql import functions as F

from ..operators import datasets as D, filters as S, joins as J, portfolio as P, resampling as B, timeseries as W, xsection as C
from ..plans import backtest as BT, tables as T
from ..session import materialise
from .base_sql import FRI
from .registry import clone, part, pick, query
from .selection import rank_sql, scored
from .timeseries import with_ret


@query("P01_structure_score", pick("s_in", "ticker date structure", "structure_score"))
def p01(spark, sf):
    return P.structure_score(T.weekly_features(spark, sf)).select("ticker", "date", "structure", "structure_score")


@query("P02_penalties", pick("s_in", "ticker date", "rsi_penalty_long=pen_long;rsi_penalty_short=pen_short;mom5_penalty=pen_mom5"))
def p02(spark, sf):
    return P.penalties(T.weekly_features(spark, sf)).select("ticker", "date", "rsi_penalty_long", "rsi_penalty_short", "mom5_penalty")


def ranked(spark, sf):
    return P.with_ranks(materialise(T.weekly_features(spark, sf), "features"))


@query("P03_long_score", pick("s_raw", "ticker date", "long_score"))
def p03(spark, sf):
    return P.long_score(ranked(spark, sf)).select("ticker", "date", "long_score")


@query("P04_short_score", pick("s_raw", "ticker date", "short_score"))
def p04(spark, sf):
    return P.short_score(ranked(spark, sf)).select("ticker", "date", "short_score")


@query("P05_defensive_score", pick("s_raw", "ticker date", "defensive_score"))
def p05(spark, sf):
    return P.defensive_score(ranked(spark, sf)).select("ticker", "date", "defensive_score")


part("p06", f"SELECT *, {rank_sql('mom60_z')} AS rp FROM s_in")


@query("P06_model_score", pick("p06", "ticker date", "long_score=rp + pen_long + pen_mom5;short_score=1 - rp + pen_short"))
def p06(spark, sf):
    return P.model_score(materialise(T.weekly_features(spark, sf), "features"), "mom60_z").select("ticker", "date", "long_score", "short_score")


SCENARIOS = [
    {"scenario": "bands", "exposure_mode": "REGIME_BANDS", "gold_model": "baseline"},
    {"scenario": "constant", "exposure_mode": "CONSTANT_DELEVERAGE", "gold_model": "capped"},
    {"scenario": "geometry", "exposure_mode": "DYNAMIC_GEOMETRY", "gold_model": "sigmoid"},
    {"scenario": "model", "exposure_mode": "MODEL", "gold_model": "no_gold"},
]
SHORTS = {"BULL": 0.0, "CHOP": 0.10, "BEAR": 0.20}
part("p_scen", " UNION ALL ".join(
    f"SELECT '{s['scenario']}' AS scenario, '{s['exposure_mode']}' AS exposure_mode, '{s['gold_model']}' AS gold_model" for s in SCENARIOS))

# three sleeves per date from the pools of its regime; held names keep their place up to rank 30
COLS = "date, ticker, structure, fip, mom60, vol20"
STRESS = "(coalesce(suppression_score, 0) >= 0.60 OR coalesce(transition_risk, 0) >= 0.75)"
part("p_long", f"SELECT * FROM f05 QUALIFY NOT {STRESS} OR row_number() OVER (PARTITION BY date ORDER BY long_score DESC, ticker) <= 10")
part("p_cand", f"""SELECT {COLS}, 'MOMENTUM' AS sleeve, long_score AS score FROM p_long
   UNION ALL SELECT {COLS}, 'DEFENSIVE', defensive_score FROM f_reg WHERE vol252 IS NOT NULL AND max_dd IS NOT NULL AND r2 IS NOT NULL
   UNION ALL SELECT {COLS}, 'SHORT', short_score FROM f06 WHERE NOT {STRESS}""")
# dates without longs and shorts have no book
part("p_turns", "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM p_cand WHERE sleeve <> 'DEFENSIVE')")
part("p_lists", """SELECT s.sleeve, t.i, t.date, coalesce(list(c.ticker ORDER BY c.score DESC, c.ticker) FILTER (c.ticker IS NOT NULL), []) AS names
   FROM p_turns t CROSS JOIN (SELECT unnest(['MOMENTUM', 'DEFENSIVE']) AS sleeve) s LEFT JOIN p_cand c ON c.date = t.date AND c.sleeve = s.sleeve GROUP BY s.sleeve, t.i, t.date""")


def step(keep: int, n: int) -> str:
    """One date of the buffer in SQL: held names among the first ``keep``, then the best others."""
    kept = f"list_filter(names[1:{keep}], lambda x: list_contains(held, x))"
    return (f"CASE WHEN len({kept}) >= {n} THEN {kept}[1:{n}] "
            f"ELSE list_concat({kept}, list_filter(names, lambda x: NOT list_contains(held, x))[1:{n} - len({kept})]) END")


part("p_walk", f"""SELECT sleeve, i, date, names[1:20] AS held FROM p_lists WHERE i = 1
   UNION ALL SELECT sleeve, i, date, {step(30, 20)} FROM (SELECT n.sleeve, n.i, n.date, n.names, w.held FROM p_walk w JOIN p_lists n ON n.sleeve = w.sleeve AND n.i = w.i + 1)""")
part("p_held", "SELECT sleeve, date, unnest(held) AS ticker FROM p_walk")
part("p_sh", """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.date ORDER BY c.score DESC, c.ticker) AS k FROM p_cand c
  LEFT JOIN p_held m ON m.sleeve = 'MOMENTUM' AND m.date = c.date AND m.ticker = c.ticker WHERE c.sleeve = 'SHORT' AND m.date IS NULL) WHERE k <= 5""")
part("p_sleeves", f"""SELECT x.*, s.sector FROM (SELECT c.* FROM p_cand c JOIN p_held h ON h.sleeve = c.sleeve AND h.date = c.date AND h.ticker = c.ticker
  UNION ALL SELECT {COLS}, sleeve, score FROM p_sh) x JOIN b_sectors s ON s.ticker = x.ticker""", True)


def inputs(spark, sf):
    """Weekly features and regimes, each read from the lines once and stored."""
    return materialise(T.weekly_features(spark, sf), "features"), materialise(T.weekly_regime(spark, sf), "regime")


def sleeves(spark, sf, given=None):
    features, regime = given or inputs(spark, sf)
    return BT.select_sleeves(BT.store_scores(features, True), T.sectors(spark, sf), regime)


@query("U04_minus", pick("p_sleeves a LEFT JOIN (SELECT date AS d, ticker AS t FROM p_sleeves WHERE sleeve = 'MOMENTUM') m ON m.d = a.date AND m.t = a.ticker",
                         "date;ticker", "score", "", "a.sleeve = 'DEFENSIVE' AND m.d IS NULL"))
def u04(spark, sf):
    """Defensive names that are not held for momentum as well."""
    s = sleeves(spark, sf)
    return P.minus(s.where("sleeve = 'DEFENSIVE'"), s.where("sleeve = 'MOMENTUM'")).select("date", "ticker", "score")


part("p_counts", "SELECT date, count_if(sleeve = 'MOMENTUM') AS long_count, count_if(sleeve = 'SHORT') AS short_count FROM p_sleeves GROUP BY date")
part("p07_in", """SELECT s.*, g.regime, g.regime_confidence, g.vix, g.breadth, g.p_bear, g.transition_risk, c.long_count, c.short_count
  FROM b_regime g JOIN p_counts c ON c.date = g.date CROSS JOIN p_scen s""".replace("SELECT s.*", "SELECT g.date, s.*"))
part("p07_raw", """SELECT *, CASE exposure_mode WHEN 'CONSTANT_DELEVERAGE' THEN 0.7731
   WHEN 'DYNAMIC_GEOMETRY' THEN least(greatest(1 - 0.02 * (coalesce(vix, 15) - 15) + 0.05 * (coalesce(breadth, 0.43) - 0.43), 0.2), 1)
   WHEN 'MODEL' THEN least(greatest(1 - coalesce(p_bear, 0) * 0.5, 0.3), 1)
   ELSE (CASE WHEN regime = 'BULL' THEN 1.0 WHEN long_count = 0 THEN 0 WHEN regime = 'BEAR' THEN 0.4 ELSE 0.3 END) * (0.75 + 0.5 * least(greatest(regime_confidence, 0), 1)) END AS lb,
   CASE WHEN exposure_mode <> 'REGIME_BANDS' OR short_count = 0 THEN 0 ELSE
   (CASE regime WHEN 'BULL' THEN 0.0 WHEN 'BEAR' THEN 0.2 ELSE 0.1 END) * (0.75 + 0.5 * least(greatest(regime_confidence, 0), 1)) END AS sb FROM p07_in""")
part("p07_t", """SELECT *, CASE WHEN gold_model = 'no_gold' THEN 1.0 WHEN transition_risk >= 0.6 THEN lb * greatest(0.4, 1 - 0.6 * transition_risk) ELSE lb END AS long_budget,
   CASE WHEN gold_model = 'no_gold' THEN 0.0 WHEN transition_risk >= 0.6 THEN sb * greatest(0.25, 1 - 0.8 * transition_risk) ELSE sb END AS sb2 FROM p07_raw""")
part("p07", "SELECT *, CASE WHEN gold_model = 'no_gold' THEN 0.0 ELSE least(sb2, long_budget * 0.30) END AS short_budget FROM p07_t", True)


def staged(spark, sf, given=None):
    """Stored sleeves and the stored budgets of all scenarios."""
    given = given or inputs(spark, sf)
    rows = sleeves(spark, sf, given)
    return rows, materialise(BT.budgets(rows, given[1], SCENARIOS, SHORTS), "budgets")


@query("P07_gross_budget", pick("p07", "scenario date", "long_budget short_budget"))
def p07(spark, sf):
    return staged(spark, sf)[1].select("scenario", "date", "long_budget", "short_budget")


part("p08", """SELECT date, k, least(greatest(0.05 * k, 0.02), 0.05) AS s, least(greatest(0.25 * k, 0.12), 0.25) AS c FROM (
  SELECT date, least(greatest(vix / 30.0, 0.2), 1.0) AS k FROM b_regime)""")


@query("P08_risk_budget", pick("p08", "date", "gross_leverage=k;max_single_stock=s;sector_limit=c;cash_buffer=1 - k"))
def p08(spark, sf):
    r = T.weekly_regime(spark, sf).select("date", (F.col("vix") / 30.0).alias("kappa"))
    return P.risk_budget(r).drop("kappa")


part("p_sized", """SELECT x.*, b.scenario, b.gold_model, b.long_budget, b.short_budget, b.p_bear, b.vix,
   CASE sleeve WHEN 'MOMENTUM' THEN 0.8 * long_budget WHEN 'DEFENSIVE' THEN 0.2 * long_budget ELSE short_budget END AS budget,
   CASE sleeve WHEN 'SHORT' THEN 0.55 ELSE 0.60 END AS mix FROM p_sleeves x JOIN p07 b ON b.date = x.date""")
G = "PARTITION BY scenario, date, sleeve"
part("p09_a", f"""SELECT *, greatest(score - min(score) OVER ({G}) + 1e-6, 1e-6) AS s,
   1 / coalesce(nullif(vol20, 0), median(vol20) OVER ({G})) AS v FROM p_sized""")
part("p09_b", f"SELECT *, mix * s / sum(s) OVER ({G}) + (1 - mix) * v / sum(v) OVER ({G}) AS blend FROM p09_a")
part("p09", f"SELECT *, blend / sum(blend) OVER ({G}) AS raw FROM p09_b")


@query("P09_blend_weights", pick("p09", "scenario date sleeve ticker", "raw"))
def p09(spark, sf):
    return BT.blended(*staged(spark, sf)).select("scenario", "date", "sleeve", "ticker", "raw")


part("p10_r0", "SELECT *, 0.08 / greatest(1e-5, budget) AS cap, 0.25 / greatest(1e-5, budget) AS scap FROM p09")
for _i in range(1, 6):
    _p = f"p10_r{_i - 1}"
    part(f"p10_c{_i}", f"SELECT *, mx > cap + 1e-4 AS clip, CASE WHEN mx > cap + 1e-4 THEN least(raw, cap) ELSE raw END AS c FROM (SELECT *, max(raw) OVER ({G}) AS mx FROM {_p})")
    part(f"p10_n{_i}", f"SELECT *, CASE WHEN clip THEN c / sum(c) OVER ({G}) ELSE c END AS nn FROM p10_c{_i}")
    part(f"p10_s{_i}", f"SELECT *, CASE WHEN sleeve <> 'SHORT' AND ss > scap + 1e-4 THEN nn * scap / ss ELSE nn END AS k2, CASE WHEN sleeve <> 'SHORT' AND ss > scap + 1e-4 THEN 1 ELSE 0 END AS br "
                       f"FROM (SELECT *, sum(nn) OVER ({G}, sector) AS ss FROM p10_n{_i})")
    part(f"p10_r{_i}", f"SELECT * EXCLUDE (raw, mx, clip, c, nn, ss, k2, br), CASE WHEN max(br) OVER ({G}) > 0 THEN k2 / sum(k2) OVER ({G}) ELSE nn END AS raw FROM p10_s{_i}")


@query("P10_cap_iterate", pick("p10_r5", "scenario date sleeve ticker sector", "raw"))
def p10(spark, sf):
    return BT.capped(*staged(spark, sf)).select("scenario", "date", "sleeve", "ticker", "sector", "raw")


part("p11", """SELECT *, budget * raw AS base_weight, (CASE WHEN sleeve = 'SHORT' THEN -1 ELSE 1 END) * least(0.10, budget * raw
   * CASE WHEN vix > 24 THEN CASE WHEN sleeve = 'SHORT' THEN 0.85 ELSE 0.75 END ELSE 1 END
   * CASE WHEN (sleeve = 'MOMENTUM' AND structure = 'VACUUM' AND fip > 0) OR (sleeve = 'SHORT' AND structure = 'TRAPPED' AND mom60 < 0) THEN 1.1 ELSE 1 END) AS weight FROM p10_r5""")


@query("P11_adjust", pick("p11", "scenario date sleeve ticker", "base_weight weight"))
def p11(spark, sf):
    return P.adjust(BT.capped(*staged(spark, sf))).select("scenario", "date", "sleeve", "ticker", "base_weight", "weight")


part("u02", """SELECT scenario, date, ticker, any_value(sector) AS sector, CASE WHEN bool_or(sleeve = 'SHORT') THEN sum(weight) FILTER (sleeve = 'SHORT') ELSE sum(weight) END AS weight,
   CASE WHEN bool_or(sleeve = 'SHORT') THEN sum(base_weight) FILTER (sleeve = 'SHORT') ELSE sum(base_weight) END AS base_weight,
   arg_min(score, CASE sleeve WHEN 'SHORT' THEN 0 WHEN 'MOMENTUM' THEN 1 ELSE 2 END) AS score,
   arg_min(sleeve, CASE sleeve WHEN 'SHORT' THEN 0 WHEN 'MOMENTUM' THEN 1 ELSE 2 END) AS sleeve,
   CASE WHEN bool_or(sleeve = 'SHORT') THEN 'SHORT' ELSE 'LONG' END AS side FROM p11 GROUP BY scenario, date, ticker""")


@query("U02_merge_sleeves", pick("u02", "scenario date ticker sleeve side", "weight base_weight score"))
def u02(spark, sf):
    return BT.merged(*staged(spark, sf)).select("scenario", "date", "ticker", "sleeve", "side", "weight", "base_weight", "score")


part("p12_w", """SELECT *, least(CASE gold_model WHEN 'no_gold' THEN 0.0 WHEN 'capped' THEN least((1 - long_budget) * p_bear, 0.20)
   WHEN 'sigmoid' THEN 0.35 / (1 + exp(-4 * (p_bear - 0.5))) ELSE (1 - long_budget) * p_bear END, 0.25) AS w FROM p07""")
part("p12", "SELECT *, CASE WHEN w > 0.005 THEN w ELSE 0 END AS gold_weight FROM p12_w")


@query("P12_gold_sleeve", pick("p12", "scenario date", "gold_weight"))
def p12(spark, sf):
    return P.gold_weight(staged(spark, sf)[1]).select("scenario", "date", "gold_weight")


part("p13_in", """SELECT scenario, date, ticker, side, sleeve, sector, weight, base_weight, score FROM u02 UNION ALL
  SELECT scenario, date, 'GOLDBEES', 'GOLD', 'GOLD', 'GOLD', gold_weight, gold_weight, 0.0 FROM p12 WHERE gold_weight > 0""")
part("p13_s", "SELECT *, CASE WHEN side <> 'GOLD' AND sw > 0.25 THEN weight * 0.25 / sw ELSE weight END AS w2 FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY scenario, date, sector, side = 'GOLD') AS sw FROM p13_in)")
part("p13", "SELECT * EXCLUDE (weight), CASE WHEN gw > 1 THEN w2 / gw ELSE w2 END AS weight FROM (SELECT *, sum(abs(w2)) OVER (PARTITION BY scenario, date) AS gw FROM p13_s)", True)


def book(spark, sf, given=None):
    return BT.book(*staged(spark, sf, given))


@query("P13_book_caps", pick("p13", "scenario date ticker side", "weight"))
def p13(spark, sf):
    return book(spark, sf).select("scenario", "date", "ticker", "side", "weight")


part("p_dates", "SELECT date, lead(date) OVER (ORDER BY date) AS next_date, lag(date) OVER (ORDER BY date) AS prev_date FROM b_regime")
part("p_books", "SELECT scenario, date, lead(date) OVER (PARTITION BY scenario ORDER BY date) AS next_book FROM (SELECT DISTINCT scenario, date FROM p13)")
part("p14_d", """SELECT scenario, date, ticker, sum(o) AS o, sum(n) AS n FROM (SELECT scenario, date, ticker, 0.0 AS o, weight AS n FROM p13
   UNION ALL SELECT b.scenario, d.next_book, b.ticker, b.weight, 0.0 FROM p13 b JOIN p_books d ON d.scenario = b.scenario AND d.date = b.date WHERE d.next_book IS NOT NULL) GROUP BY ALL""")
part("p14", "SELECT scenario, date, sum(abs(n - o)) AS turnover, sum(abs(n - o)) * 1e6 * 15 / 10000 AS friction_cost FROM p14_d GROUP BY scenario, date")


def stored_book(spark, sf, given=None):
    return materialise(book(spark, sf, given), "book")


def prices(spark, sf, given):
    """Opening prices of names and gold, stored (entry and exit read them), and the dates of the regime."""
    return materialise(BT.with_gold(given[0], T.weekly_gold(spark, sf)), "opens"), BT.rebalances(given[1])


@query("P14_turnover_cost", pick("p14", "scenario date", "turnover friction_cost"))
def p14(spark, sf):
    return P.turnover_cost(J.weight_delta(stored_book(spark, sf), by=("scenario",)), x=BT.BY_DATE)


part("p15_px", f"""SELECT date, ticker, open FROM b_features
   UNION ALL SELECT {FRI.format('date')}, 'GOLDBEES', arg_min(open, date) FROM b_roles WHERE role = 'gold' GROUP BY 1""")
part("p15", """SELECT b.*, e.open AS entry_price, x.open AS exit_price, CASE WHEN e.open > 0 AND x.open IS NOT NULL THEN x.open / e.open - 1 ELSE 0 END AS fwd_return
  FROM p13 b JOIN p_dates d ON d.date = b.date LEFT JOIN p15_px e ON e.ticker = b.ticker AND e.date = b.date AND d.next_date IS NOT NULL
  LEFT JOIN p15_px x ON x.ticker = b.ticker AND x.date = d.next_date""", True)


@query("P15_forward_open_return", pick("p15", "scenario date ticker", "entry_price exit_price fwd_return"))
def p15(spark, sf):
    given = inputs(spark, sf)
    return P.forward_open_return(book(spark, sf, given), *prices(spark, sf, given)).select("scenario", "date", "ticker", "entry_price", "exit_price", "fwd_return")


@query("P16_pnl", pick("p15", "scenario date ticker", "weight;fwd_return;gross_weight=abs(weight);pnl_share=weight * fwd_return;leverage_mult=abs(weight) / greatest(1e-9, base_weight)"))
def p16(spark, sf):
    given = inputs(spark, sf)
    return BT.trades(book(spark, sf, given), *prices(spark, sf, given)).select("scenario", "date", "ticker", "weight", "fwd_return", "gross_weight", (F.col("gross_pnl") / 1e6).alias("pnl_share"), "leverage_mult")


part("p16_w", """SELECT p.*, t.turnover, t.friction_cost FROM (SELECT scenario, date, sum(1e6 * weight * fwd_return) AS gross_pnl, sum(abs(weight)) AS gross_exposure,
   sum(weight) AS net_exposure FROM p15 GROUP BY scenario, date) p LEFT JOIN p14 t ON t.scenario = p.scenario AND t.date = p.date""")


def weekly_book(spark, sf):
    given = inputs(spark, sf)
    return BT.weekly_returns(stored_book(spark, sf, given), *prices(spark, sf, given))


@query("P16_weekly_returns", pick("p16_w", "scenario date", "gross_share=gross_pnl / 1e6;gross_exposure;net_exposure;turnover;friction_cost;portfolio_return=(gross_pnl - friction_cost) / 1e6"))
def p16_weekly(spark, sf):
    """P&L as a share of capital."""
    return weekly_book(spark, sf).withColumn("gross_share", F.col("gross_pnl") / 1e6).drop("gross_pnl", "net_pnl")


part("p17_b", "SELECT date, ticker, side, weight FROM b_trades WHERE weight > 0.05")
part("p17", "SELECT * FROM p17_b UNION ALL SELECT date, 'CASH', 'CASH', 0.0 FROM b_regime WHERE date NOT IN (SELECT date FROM p17_b)")


@query("P17_cash_rows", pick("p17", "date ticker side", "weight"))
def p17(spark, sf):
    t = T.trade_log(spark, sf).where("weight > 0.05").select("date", "ticker", "side", "weight")
    return P.with_cash_rows(t, T.weekly_regime(spark, sf))


part("p18_c", """SELECT 'momentum' AS scenario, date, ticker, round(long_score, 9) AS score FROM s_scored WHERE mom60 > 0
   UNION ALL SELECT 'defensive', date, ticker, round(defensive_score, 9) FROM s_scored WHERE mom60 > 0""")
# the walk in SQL keeps the held names as a list and steps from date to date
part("p18_d", "SELECT scenario, date, list(ticker ORDER BY score DESC, ticker) AS names, row_number() OVER (PARTITION BY scenario ORDER BY date) AS i FROM p18_c GROUP BY scenario, date")
part("p18_walk", f"""SELECT scenario, date, i, names[1:20] AS held FROM p18_d WHERE i = 1
   UNION ALL SELECT scenario, date, i, {step(30, 20)} FROM (SELECT n.scenario, n.date, n.i, n.names, w.held FROM p18_walk w JOIN p18_d n ON n.scenario = w.scenario AND n.i = w.i + 1)""")
part("p18_h", "SELECT scenario, date, unnest(held) AS ticker FROM p18_walk")
part("p18", """SELECT h.*, c.score, c.place FROM p18_h h JOIN (SELECT *, row_number() OVER (PARTITION BY scenario, date ORDER BY score DESC, ticker) AS place FROM p18_c) c
   ON c.scenario = h.scenario AND c.date = h.date AND c.ticker = h.ticker""")


@query("P18_rank_buffer", pick("p18", "scenario date ticker", "score", "place"))
def p18(spark, sf):
    """Held names of two universes of scores, walked week by week."""
    s = scored(spark, sf).where("mom60 > 0").withColumn("long_score", F.round("long_score", 9))
    both = P.sweep(s, [{"scenario": "momentum", "pick": 0}, {"scenario": "defensive", "pick": 1}])
    both = both.withColumn("score", F.when(F.col("pick") == 0, F.col("long_score")).otherwise(F.round("defensive_score", 9)))
    return P.rank_buffer(both)


# trailing returns of the twenty best names of each week, 252 rows back
part("p19_sel", "SELECT m.date, m.ticker, m.mom60, a.idx FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom60 DESC, ticker) AS k FROM w01 WHERE mom60 IS NOT NULL) m "
     "JOIN b_rebal a ON a.date = m.date WHERE k <= 20")
part("p19_r", "SELECT s.date, s.ticker, g.idx, coalesce(r.ret, 0) AS ret FROM p19_sel s JOIN b_cal g ON g.idx BETWEEN s.idx - 252 AND s.idx - 1 JOIN b_ret r ON r.ticker = s.ticker AND r.date = g.date")
part("p19", """SELECT a.date, a.ticker AS ticker_i, b.ticker AS ticker_j, covar_samp(a.ret, b.ret) + CASE WHEN a.ticker = b.ticker THEN 1e-4 ELSE 0 END AS cov
  FROM p19_r a JOIN p19_r b ON b.date = a.date AND b.idx = a.idx AND a.ticker <= b.ticker GROUP BY a.date, a.ticker, b.ticker""")


def selected_past(spark, sf, names=20, window=252):
    """Each week's best names with the returns before it."""
    df = materialise(W.pct(with_ret(spark, sf), "close", 60, "mom60").select("ticker", "date", "idx", "ret", "mom60"), "returns")
    weeks_ = W.rebalance_dates(T.trading_days(spark, sf)).select("date")
    weekly = df.join(F.broadcast(weeks_), "date", "left_semi").where("mom60 IS NOT NULL")
    best = C.top_k(weekly.select("date", "ticker", "idx", "mom60"), "mom60", names)
    return J.trailing_values(best, df, "ret", window)


@query("J14_trailing_values", pick("(SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY idx) - 1 AS pos FROM p19_r) GROUP BY date, ticker", "date ticker",
                                   "total=sum(ret);by_place=sum(ret * pos) / 100;squares=sum(ret * ret * (pos + 1));low=min(ret);high=max(ret)", "n=count(*)"))
def j14(spark, sf):
    """The past returns of each selected name: figures of the whole array, which its order enters."""
    past = selected_past(spark, sf)
    add = lambda f: F.aggregate(F.transform("past", f), F.lit(0.0), lambda s, v: s + v)
    return past.select("date", "ticker", add(lambda v: v).alias("total"), (add(lambda v, i: v * i) / 100).alias("by_place"), add(lambda v, i: v * v * (i + 1)).alias("squares"),
                       F.array_min("past").alias("low"), F.array_max("past").alias("high"), F.size("past").alias("n"))


part("p19_long", "SELECT date, list(ticker ORDER BY ticker) AS names, count(DISTINCT ticker) AS p FROM p19_sel GROUP BY date")
part("p19_dm", "SELECT date, ticker, idx, ret - avg(ret) OVER (PARTITION BY date, ticker) AS x, count(*) OVER (PARTITION BY date, ticker) AS n FROM p19_r")
part("p19_s", "SELECT a.date, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / any_value(a.n) AS s, any_value(a.n) AS n FROM p19_dm a JOIN p19_dm b ON b.date = a.date AND b.idx = a.idx GROUP BY a.date, a.ticker, b.ticker")
part("p19_st", """SELECT date, any_value(n) AS n, count(DISTINCT i) AS p, sum(CASE WHEN i = j THEN s ELSE 0 END) / count(DISTINCT i) AS mu, avg(s * s) AS a FROM p19_s GROUP BY date""")
part("p19_rho", "SELECT *, CASE WHEN (n + 1) * (a - mu * mu / p) = 0 THEN 1 ELSE least(1, (a + mu * mu) / ((n + 1) * (a - mu * mu / p))) END AS rho FROM p19_st")
part("p19_oas", "SELECT s.date, i, j, (1 - rho) * s + CASE WHEN i = j THEN rho * mu + 1e-4 ELSE 0 END AS cov FROM p19_s s JOIN p19_rho r ON r.date = s.date WHERE i <= j")


@query("P19_covariance_oas", pick("p19_oas", "date;ticker_i=i;ticker_j=j", "cov"))
def p19_oas(spark, sf):
    return P.covariance(selected_past(spark, sf), "oas")


@query("P19_covariance_sample", pick("p19", "date ticker_i ticker_j", "cov"))
def p19_sample(spark, sf):
    return P.covariance(selected_past(spark, sf), "sample")


part("p19_w", "SELECT r.*, pow(1 - 2 / 64.0, max(idx) OVER (PARTITION BY date) - idx) AS w FROM p19_r r")
part("p19_wm", "SELECT *, sum(w * ret) OVER (PARTITION BY date, ticker) / sum(w) OVER (PARTITION BY date, ticker) AS m FROM p19_w")
part("p19_ewm", """SELECT a.date, a.ticker AS ticker_i, b.ticker AS ticker_j, sum(a.w * (a.ret - a.m) * (b.ret - b.m)) / sum(a.w) * (pow(sum(a.w), 2) / (pow(sum(a.w), 2) - sum(a.w * a.w)))
   + CASE WHEN a.ticker = b.ticker THEN 1e-4 ELSE 0 END AS cov FROM p19_wm a JOIN p19_wm b ON b.date = a.date AND b.idx = a.idx AND a.ticker <= b.ticker GROUP BY a.date, a.ticker, b.ticker""")


@query("P19_covariance_ewma", pick("p19_ewm", "date ticker_i ticker_j", "cov"))
def p19_ewma(spark, sf):
    return P.covariance(selected_past(spark, sf), "ewma")


part("p19_q", "SELECT date, sum(q * q) AS q4, any_value(n) AS n FROM (SELECT date, idx, sum(x * x) AS q, any_value(n) AS n FROM p19_dm GROUP BY date, idx) GROUP BY date")
part("p19_lwd", """SELECT t.date, t.n, t.p, t.mu, (t.a * t.p * t.p - 2 * t.mu * t.mu * t.p + t.p * t.mu * t.mu) / t.p AS d, (q.q4 / t.n - t.a * t.p * t.p) / (t.p * t.n) AS b
   FROM p19_st t JOIN p19_q q ON q.date = t.date""")
part("p19_lw", """SELECT s.date, i, j, (1 - rho) * s + CASE WHEN i = j THEN rho * mu + 1e-4 ELSE 0 END AS cov FROM p19_s s
   JOIN (SELECT *, CASE WHEN d = 0 THEN 0 ELSE least(b, d) / d END AS rho FROM p19_lwd) r ON r.date = s.date WHERE i <= j""")


@query("P19_covariance_ledoit_wolf", pick("p19_lw", "date;ticker_i=i;ticker_j=j", "cov"))
def p19_lw(spark, sf):
    return P.covariance(selected_past(spark, sf), "ledoit_wolf")


@query("P20_mean_variance")
def p20(spark, sf):
    """Optimised weights of each week's twenty best names, with feasibility."""
    sel = J.with_sector(selected_past(spark, sf), T.sectors(spark, sf))
    sel = sel.select("date", "ticker", "sector", (F.col("mom60") / 10).alias("mu"), F.lit(0.0).alias("prev_weight"), F.lit(0.9).alias("budget"), "past")
    return P.mean_variance(sel, "oas")


part("p21", "SELECT scenario, sum(r) AS pnl_share, avg(turnover) AS turnover, avg(gross_exposure) AS gross, stddev_samp(r) AS sd, count(*) AS weeks FROM "
     "(SELECT *, gross_pnl - friction_cost AS net_pnl, (gross_pnl - friction_cost) / 1e6 AS r FROM p16_w) GROUP BY scenario")


@query("P21_sweep", pick("p21", "scenario", "pnl_share turnover gross sd", "weeks"))
def p21(spark, sf):
    """Exposure modes and gold models side by side, from scores to weekly returns in one plan."""
    w = weekly_book(spark, sf)
    return w.groupBy("scenario").agg(F.sum("portfolio_return").alias("pnl_share"), F.avg("turnover").alias("turnover"), F.avg("gross_exposure").alias("gross"),
                                     F.stddev_samp("portfolio_return").alias("sd"), F.count("*").alias("weeks"))


# a model kept from 1996 on and one fitted anew for every month, each under both accounting conventions
FITTED = ("mom60_z", "mom20_z", "rsi14")
ENGINES = [{"scenario": "STATIC_FALLBACK", "model": "static"}, {"scenario": "ROLLING_MONTHLY", "model": "rolling"}]
part("ml_months", "SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM b_features")
part("ml_fit", "SELECT m.month, count(*) AS n, avg(fwd_ret) AS mean_y, " + ", ".join(f"avg({c}) AS mean_{c}, regr_slope(fwd_ret, {c}) AS slope_{c}" for c in FITTED)
     + " FROM ml_months m JOIN b_features f ON strftime(f.date + 7, '%Y-%m') < m.month GROUP BY m.month", True)
ML_SUM = "round(mean_y + " + " + ".join(f"coalesce(slope_{c} * ({c} - mean_{c}), 0)" for c in FITTED) + ", 12)"
for _e, _on in (("static", "p.month = '1996-01'"), ("rolling", "p.month = strftime(s.date, '%Y-%m')")):
    part(f"ml_{_e}_in", f"SELECT s.*, {ML_SUM} AS pred FROM s_raw s JOIN ml_fit p ON {_on} WHERE s.date >= DATE '1996-01-01'")
    part(f"ml_{_e}_r", f"SELECT *, {rank_sql('pred')} AS rp FROM ml_{_e}_in")
    part(f"ml_{_e}", f"SELECT * EXCLUDE (long_score, short_score, defensive_score), round(rp + pen_long + pen_mom5, 9) AS long_score, round(1 - rp + pen_short, 9) AS short_score, "
                     f"round(defensive_score, 9) AS defensive_score FROM ml_{_e}_r", True)
    part(f"ml_{_e}_scen", f"SELECT '{ENGINES[_e == 'rolling']['scenario']}' AS scenario, 'MODEL' AS exposure_mode, 'baseline' AS gold_model")
    clone(["f_reg", "f05", "f06_a", "f06", "p_long", "p_cand", "p_turns", "p_lists", "p_walk", "p_held", "p_sh", "p_sleeves", "p_counts", "p07_in", "p07_raw", "p07_t", "p07", "p_sized", "p09_a", "p09_b", "p09",
           *[f"p10_{k}{i}" for i in range(1, 6) for k in "cns"], *[f"p10_r{i}" for i in range(6)], "p11", "u02", "p12_w", "p12", "p13_in", "p13_s", "p13", "p_books", "p14_d", "p14", "p15", "p16_w"],
          {"s_scored": f"ml_{_e}", "p_scen": f"ml_{_e}_scen"}, f"{_e}_")
part("ml_pnl", "SELECT scenario AS strategy, date, gross_pnl - coalesce(friction_cost, 0) AS net_pnl FROM static_p16_w UNION ALL SELECT scenario, date, gross_pnl - coalesce(friction_cost, 0) FROM rolling_p16_w", True)


def engine_weeks(spark, sf):
    """Weekly results of both engines, in one plan: one scored universe, books per model."""
    features, regime = inputs(spark, sf)
    later = features.where("date >= '1996-01-01'")
    fits = materialise(D.expanding_fits(features.withColumn("exit_date", F.date_add("date", 7)), FITTED, "fwd_ret"), "fits")
    pred = D.predict_by_month(D.predict_by_month(later, fits, FITTED, "static", "1996-01"), fits, FITTED, "rolling")
    scores = BT.store_model_scores(pred, {"static": "static", "rolling": "rolling"})
    rows = BT.select_sleeves(scores, T.sectors(spark, sf), regime, ("model", "date"))
    budget = materialise(BT.budgets(rows, regime, [{**e, "exposure_mode": "MODEL", "gold_model": "baseline"} for e in ENGINES], SHORTS), "budgets")
    return BT.weekly_returns(materialise(BT.book(rows, budget), "book"), *prices(spark, sf, (features, regime)))


@query("D09_expanding_fits", pick("ml_fit", "month", "mean_y=mean_y * 100;" + ";".join(f"slope_{c}=slope_{c} * 100" for c in FITTED), "n"))
def expanding(spark, sf):
    """The linear model of every month, fitted to what was known before it."""
    fits = D.expanding_fits(T.weekly_features(spark, sf).withColumn("exit_date", F.date_add("date", 7)), FITTED, "fwd_ret")
    return fits.select("month", "n", *[(F.col(c) * 100).alias(c) for c in ("mean_y", *[f"slope_{f}" for f in FITTED])])


part("p22", "SELECT date, sum(net_pnl) / 1e6 AS r, sum(gross_weight) AS g FROM b_trades GROUP BY date")


@query("P22_counterfactual", pick("p22", "date", "base_return=r / greatest(0.01, g);agent_return=r / greatest(0.01, g) * 0.6;reward=r / greatest(0.01, g) * 0.6 - 0.05 / 52"))
def p22(spark, sf):
    w = T.trade_log(spark, sf).groupBy("date").agg((F.sum("net_pnl") / 1e6).alias("portfolio_return"), F.sum("gross_weight").alias("gross_exposure"))
    return P.counterfactual(w, 0.6).select("date", "base_return", "agent_return", "reward")


@query("P23_attribution", pick("b_trades", "date ticker", "momentum_part=mom_z * 0.4;macro_part=macro_score * 0.2;regime_part=regime_confidence * 0.2;residual=score - (mom_z * 0.4 + macro_score * 0.2 + regime_confidence * 0.2)"))
def p23(spark, sf):
    return P.attribution(T.trade_log(spark, sf)).select("date", "ticker", "momentum_part", "macro_part", "regime_part", "residual")


part("u01", "SELECT DISTINCT ON (ticker, date) * FROM (SELECT ticker, date, close, 0 AS ver FROM b_panel UNION ALL SELECT ticker, date, close * 2, 1 FROM b_panel WHERE close > 5000) ORDER BY ticker, date, ver DESC")


@query("U01_merge_dedupe", pick("u01", "ticker date", "close"))
def u01(spark, sf):
    from ..operators.ingest import merge_dedupe
    p = T.panel(spark, sf).select("ticker", "date", "close")
    newer = p.where("close > 5000").withColumn("close", F.col("close") * 2).withColumn("ver", F.lit(1))
    return merge_dedupe(p, newer, ["ticker", "date"], ["ver"]).select("ticker", "date", "close")
