"""Queries W01-W18, W21-W27, W32-W36 on the aligned panel and the market roles."""

from pyspark.sql import functions as F

from ..operators import filters as S, joins as J, timeseries as W
from ..plans import tables as T
from .registry import part, pick, query

TK = "PARTITION BY ticker ORDER BY date"
RO = "PARTITION BY role ORDER BY date"


def rows(w, skip=0):
    return f"ROWS BETWEEN {w - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'}"


def gate(agg, col, w, least, over=TK, skip=0):
    f = f"({over} {rows(w, skip)})"
    return f"CASE WHEN count({col}) OVER {f} >= {least} THEN {agg}({col}) OVER {f} END"


def aligned(spark, sf):
    return J.align(T.panel(spark, sf), T.trading_days(spark, sf))


def with_ret(spark, sf):
    return W.pct(aligned(spark, sf), "close", 1, "ret")


def market(spark, sf):
    return J.align(T.roles(spark, sf), T.trading_days(spark, sf), ("role",))


def keep(df, *cols, key="ticker"):
    return df.select(key, "date", *cols)


part("w01", "SELECT *, " + ", ".join(
    f"close / nullif(lag(close, {k}) OVER ({TK}), 0) - 1 AS mom{k}" for k in (1, 5, 10, 20, 60)) + " FROM b_aligned")


@query("W01_pct", pick("w01", "ticker date", "mom1 mom5 mom10 mom20 mom60"))
def w01(spark, sf):
    return keep(W.pcts(aligned(spark, sf), {f"mom{k}": ("close", k) for k in (1, 5, 10, 20, 60)}),
                "mom1", "mom5", "mom10", "mom20", "mom60")


part("w01p", f"""SELECT ticker, date, x / nullif(lag(x) OVER ({TK}), 0) - 1 AS ret FROM (
  SELECT *, last_value(close IGNORE NULLS) OVER ({TK}) AS x FROM b_aligned)""")


@query("W01_pct_pad", pick("w01p", "ticker date", "ret"))
def w01_pad(spark, sf):
    return keep(W.pct(aligned(spark, sf), "close", 1, "ret", fill="pad"), "ret")


SMA = {20: 10, 50: 25, 100: 50, 200: 100}
part("w02", "SELECT *, " + ", ".join(f"{gate('avg', 'close', w, m)} AS sma{w}" for w, m in SMA.items()) + " FROM b_aligned")


@query("W02_sma", pick("w02", "ticker date", "sma20 sma50 sma100 sma200"))
def w02(spark, sf):
    return keep(W.sma(aligned(spark, sf), "close", SMA), *[f"sma{w}" for w in SMA])


VOL = {20: 10, 60: 30, 100: 50, 252: 126}
part("w03", "SELECT *, " + ", ".join(f"{gate('stddev_samp', 'ret', w, m)} * sqrt(252.0) AS vol{w}" for w, m in VOL.items()) + " FROM b_ret")


@query("W03_vol", pick("w03", "ticker date", "vol20 vol60 vol100 vol252"))
def w03(spark, sf):
    return keep(W.vol(with_ret(spark, sf), "ret", VOL), *[f"vol{w}" for w in VOL])


part("w04", f"""SELECT *, (mom20 - {gate('avg', 'mom20', 60, 20)}) / nullif({gate('stddev_samp', 'mom20', 60, 20)}, 0) AS mom20_z,
  (mom60 - {gate('avg', 'mom60', 60, 20)}) / nullif({gate('stddev_samp', 'mom60', 60, 20)}, 0) AS mom60_z FROM w01""")


@query("W04_zscore", pick("w04", "ticker date", "mom20_z mom60_z"))
def w04(spark, sf):
    df = W.pcts(aligned(spark, sf), {"mom20": ("close", 20), "mom60": ("close", 60)})
    return keep(W.zscore(df, {"mom20_z": "mom20", "mom60_z": "mom60"}, 60), "mom20_z", "mom60_z")


part("w05", f"SELECT *, volume / (adv20 + 1e-9) AS rvol20 FROM (SELECT *, {gate('avg', 'volume', 20, 10)} AS adv20 FROM b_aligned)")


@query("W05_adv_rvol", pick("w05", "ticker date", "adv20 rvol20"))
def w05(spark, sf):
    return keep(W.adv_rvol(aligned(spark, sf)), "adv20", "rvol20")


part("w06", f"SELECT *, CASE WHEN close > {gate('avg', 'close', 200, 100)} THEN 1.0 ELSE 0.0 END AS above200 FROM b_aligned")


@query("W06_above_sma", pick("w06", "ticker date", "above200"))
def w06(spark, sf):
    return keep(W.above_sma(aligned(spark, sf)), "above200")


part("w07", f"""SELECT ticker, date, CASE WHEN z IS NULL THEN 'UNKNOWN' WHEN abs(z) >= 1 THEN 'VACUUM' ELSE 'TRAPPED' END AS structure FROM (
  SELECT *, (close - {gate('avg', 'close', 60, 20, TK, 1)}) / nullif({gate('stddev_samp', 'close', 60, 20, TK, 1)}, 0) AS z FROM b_aligned)""")


@query("W07_structure", pick("w07", "ticker date structure"))
def w07(spark, sf):
    return keep(W.structure(aligned(spark, sf)), "structure")


part("w_bret", "SELECT idx, date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS bret FROM (SELECT c.date, c.idx, b.close FROM b_cal c LEFT JOIN b_broad b ON b.date = c.date)")
part("w08_in", "SELECT r.*, b.bret FROM b_ret r JOIN w_bret b ON b.date = r.date")
part("w08", f"""SELECT ticker, date, CASE WHEN count(ret * bret) OVER ({TK} {rows(60)}) >= 30 THEN covar_samp(ret, bret) OVER ({TK} {rows(60)}) END
  / nullif({gate('var_samp', 'bret', 60, 30)}, 0) AS beta FROM w08_in""")


def with_broad_ret(spark, sf):
    b = J.align(T.broad(spark, sf).withColumn("role", F.lit("broad")), T.trading_days(spark, sf), ("role",))
    b = W.pcts(b, {"ret": ("close", 1), "mom20": ("close", 20)}, ("role",))
    return J.with_broad(with_ret(spark, sf), b, ("ret", "mom20"))


@query("W08_beta", pick("w08", "ticker date", "beta"))
def w08(spark, sf):
    return keep(W.beta(with_broad_ret(spark, sf), "ret", "broad_ret"), "beta")


# the recursion steps through the rows of a series: y carries over gaps, g counts rows since the last value
part("w09_in", f"SELECT ticker, date, volume, row_number() OVER ({TK}) AS i FROM b_aligned")


def recursion(name, source, cols, alpha, least):
    """Step-by-step exponentially weighted means of ``cols`` as named piece ``name``."""
    start = ", ".join(f"{c} AS y_{c}, 0 AS g_{c}" for c in cols)
    step = ", ".join(
        f"CASE WHEN s.{c} IS NULL THEN r.y_{c} WHEN r.y_{c} IS NULL THEN s.{c} ELSE "
        f"(pow(1 - {alpha}, r.g_{c} + 1) * r.y_{c} + {alpha} * s.{c}) / (pow(1 - {alpha}, r.g_{c} + 1) + {alpha}) END, "
        f"CASE WHEN s.{c} IS NULL THEN r.g_{c} + 1 ELSE 0 END" for c in cols)
    part(name + "_walk", f"""SELECT ticker, date, i, {start} FROM {source} WHERE i = 1
      UNION ALL SELECT s.ticker, s.date, s.i, {step} FROM {name}_walk r JOIN {source} s ON s.ticker = r.ticker AND s.i = r.i + 1""")
    part(name, f"SELECT w.ticker, w.date, " + ", ".join(f"CASE WHEN s.k_{c} >= {least} THEN w.y_{c} END AS {c}" for c in cols)
         + f" FROM {name}_walk w JOIN {source}_k s ON s.ticker = w.ticker AND s.i = w.i")
    part(source + "_k", "SELECT ticker, i, " + ", ".join(f"count({c}) OVER (PARTITION BY ticker ORDER BY i) AS k_{c}" for c in cols) + f" FROM {source}")


recursion("w09", "w09_in", ["volume"], "0.03", 20)


@query("W09_ewm", pick("w09", "ticker date", "ewm=volume"))
def w09(spark, sf):
    return keep(W.ewm(aligned(spark, sf), {"ewm": "volume"}, 0.03, 20), "ewm")


part("w10_in", f"""SELECT ticker, date, row_number() OVER ({TK}) AS i, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up,
  CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS down FROM (SELECT *, close - lag(close) OVER ({TK}) AS d FROM b_aligned)""")
recursion("w10", "w10_in", ["up", "down"], "(1.0/14)", 14)


@query("W10_rsi_wilder", pick("w10", "ticker date", "rsi14=100 - 100 / (1 + up / (down + 1e-9))".replace(" ", "")))
def w10(spark, sf):
    return keep(W.rsi_wilder(aligned(spark, sf)), "rsi14")


part("w11_in", f"SELECT role AS ticker, date, close - lag(close) OVER ({RO}) AS d FROM b_rolegrid")
part("w11_ud", "SELECT ticker, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS down FROM w11_in")
part("w11", f"""SELECT ticker AS role, date, 100 - 100 / (1 + {gate('avg', 'up', 14, 14)} / nullif({gate('avg', 'down', 14, 14)}, 0)) AS rsi14_market FROM w11_ud""")


@query("W11_rsi_simple", pick("w11", "role date", "rsi14_market"))
def w11(spark, sf):
    return keep(W.rsi_simple(market(spark, sf), by=("role",)), "rsi14_market", key="role")


part("w12_in", f"""SELECT ticker, date, row_number() OVER ({TK}) AS i, CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END AS up,
  CASE WHEN ret IS NOT NULL THEN -least(ret, 0) END AS down FROM b_ret""")
recursion("w12_e", "w12_in", ["up", "down"], "(1-0.97)", 20)
part("w12_v", f"""SELECT ticker, date, coalesce(close / nullif(lag(close, 60) OVER ({TK}), 0) - 1, 0) AS trend, {gate('stddev_samp', 'ret', 60, 20)} AS vol FROM b_ret""")
part("w12", """SELECT v.ticker, v.date, coalesce((up - down) / (up + down + 1e-9) * trend / (vol + 1e-6), 0) AS fip
  FROM w12_v v JOIN w12_e e ON e.ticker = v.ticker AND e.date = v.date""")


@query("W12_fip", pick("w12", "ticker date", "fip"))
def w12(spark, sf):
    return keep(W.fip(aligned(spark, sf)), "fip")


part("w13_in", f"SELECT *, abs(close - lag(close) OVER ({TK})) AS ad FROM b_aligned")
part("w13", f"""SELECT ticker, date,
  CASE WHEN e100 IS NOT NULL THEN least(greatest(e100, 0), 1) END AS eff100, er20, strict50 FROM (SELECT ticker, date,
  abs(close - lag(close, 100) OVER ({TK})) / ({gate('sum', 'ad', 100, 33)} + 1e-9) AS e100,
  abs(close - lag(close, 20) OVER ({TK})) / ({gate('sum', 'ad', 20, 10)} + 1e-9) AS er20,
  abs(close - lag(close, 50) OVER ({TK})) / nullif({gate('sum', 'ad', 50, 25)}, 0) AS strict50 FROM w13_in)""")


@query("W13_efficiency", pick("w13", "ticker date", "eff100 er20 strict50"))
def w13(spark, sf):
    return keep(W.efficiency(aligned(spark, sf), {"eff100": (100, 33, "clipped"), "er20": (20, 10, "open"), "strict50": (50, 25, "strict")}),
                "eff100", "er20", "strict50")


part("w14", f"SELECT ticker, date, (ln(nullif(close, 0)) - ln(nullif(lag(close, 100) OVER ({TK}), 0))) / 100.0 AS slope100 FROM b_aligned")


@query("W14_slope", pick("w14", "ticker date", "slope100"))
def w14(spark, sf):
    return keep(W.slope(aligned(spark, sf)), "slope100")


part("w15_in", f"SELECT *, (close - pk) / (pk + 1e-9) AS dd FROM (SELECT *, max(close) OVER ({TK} {rows(252)}) AS pk FROM b_aligned)")
part("w15", f"SELECT ticker, date, {gate('min', 'dd', 252, 126)} AS max_dd FROM w15_in")


@query("W15_trailing_max_dd", pick("w15", "ticker date", "max_dd"))
def w15(spark, sf):
    return keep(W.trailing_max_dd(aligned(spark, sf)), "max_dd")


part("w16_in", "SELECT *, ln(close + 1e-9) AS y, CAST(idx AS DOUBLE) AS x FROM b_aligned")
part("w16_xy", "SELECT *, (x - 1250) * (y - 8) AS xy, CASE WHEN y IS NOT NULL THEN x - 1250 END AS xn FROM w16_in")
part("w16_m", f"""SELECT ticker, date, {gate('avg', 'x', 252, 126)} - 1250 AS mx, {gate('var_samp', 'x', 252, 126)} AS vx, {gate('avg', 'y', 252, 126)} AS my,
  {gate('var_samp', 'y', 252, 126)} AS vy, {gate('avg', 'xy', 252, 126)} + 8 * {gate('avg', 'xn', 252, 126)} AS mxy FROM w16_xy""")
part("w16", "SELECT ticker, date, pow(mxy - mx * my, 2) / (vx * vy + 1e-9) AS r2 FROM w16_m")


@query("W16_trend_r2", pick("w16", "ticker date", "r2"))
def w16(spark, sf):
    return keep(W.trend_r2(aligned(spark, sf)), "r2")


@query("W17_vol_comp", pick("w03", "ticker date", "vol_comp=vol20/(vol100+1e-9)"))
def w17(spark, sf):
    return keep(W.vol_comp(W.vol(with_ret(spark, sf), "ret", {20: 10, 100: 50})), "vol_comp")


part("w18_b", "SELECT date, close / nullif(lag(close, 20) OVER (ORDER BY date), 0) - 1 AS bm FROM (SELECT c.date, b.close FROM b_cal c LEFT JOIN b_broad b ON b.date = c.date)")


@query("W18_excess", pick("w01 m JOIN w18_b b ON b.date = m.date", "ticker=m.ticker;date=m.date", "excess20=mom20-bm;mom20=mom20"))
def w18(spark, sf):
    df = W.pct(with_broad_ret(spark, sf), "close", 20, "mom20")
    return keep(W.excess(df), "excess20", "mom20")


part("w21_s", "SELECT role, date, close, " + ", ".join(f"{gate('avg', 'close', w, w // 2, RO)} AS sma{w}" for w in (50, 100, 200)) + " FROM b_rolegrid")


@query("W21_dist_sma", pick("w21_s", "role date", ";".join(f"dist_sma{w}=(close-sma{w})/nullif(sma{w},0)" for w in (50, 100, 200))))
def w21(spark, sf):
    return keep(W.dist_sma(market(spark, sf), by=("role",)), "dist_sma50", "dist_sma100", "dist_sma200", key="role")


part("w22_r", f"SELECT *, close / nullif(lag(close) OVER ({RO}), 0) - 1 AS ret FROM b_rolegrid")
part("w22", f"""SELECT role, date, {gate('stddev_samp', 'ret', 20, 10, RO)} * sqrt(252.0) AS vol20, {gate('stddev_samp', 'ret', 60, 30, RO)} * sqrt(252.0) AS vol60,
  {gate('avg', 'ret', 20, 10, RO)} AS m20, {gate('avg', 'ret', 60, 30, RO)} AS m60 FROM w22_r""")


@query("W22_vol_ratio_sharpe", pick("w22", "role date", "vol20;vol60;vol_ratio=vol20/nullif(vol60,0);sharpe_20=m20*252/nullif(vol20,0);sharpe_60=m60*252/nullif(vol60,0)"))
def w22(spark, sf):
    df = W.pct(market(spark, sf), "close", 1, "ret", ("role",))
    return keep(W.vol_ratio_sharpe(df, ("role",)), "vol20", "vol60", "vol_ratio", "sharpe_20", "sharpe_60", key="role")


part("w_breadth", "SELECT date, avg(above200) AS breadth FROM w06 GROUP BY date")
part("w23", "SELECT date, breadth, breadth - lag(breadth, 20) OVER (ORDER BY date) AS breadth_mom20 FROM w_breadth")


def breadth_daily(spark, sf):
    return W.above_sma(aligned(spark, sf)).groupBy("date").agg(F.avg("above200").alias("breadth")).withColumn("series", F.lit("all"))


@query("W23_diff", pick("w23", "date", "breadth breadth_mom20"))
def w23(spark, sf):
    return W.diff(breadth_daily(spark, sf), "breadth", 20, "breadth_mom20", ("series",)).drop("series")


part("w24", f"""SELECT date, close AS vix, {gate('avg', 'close', 20, 10, RO)} AS vix_sma20,
  (close - {gate('avg', 'close', 60, 30, RO)}) / nullif({gate('stddev_samp', 'close', 60, 30, RO)}, 0) AS vix_z FROM b_rolegrid WHERE role = 'fear'""")


@query("W24_vix_features", pick("w24", "date", "vix vix_sma20 vix_z"))
def w24(spark, sf):
    fear = market(spark, sf).where("role = 'fear'")
    return W.vix_features(fear).select("date", F.col("close").alias("vix"), "vix_sma20", "vix_z")


part("w25_m", f"SELECT role, date, close / nullif(lag(close, 20) OVER ({RO}), 0) - 1 AS m FROM b_rolegrid")
part("w25", """SELECT date, max(m) FILTER (role = 'risk') - max(m) FILTER (role = 'broad') AS risk_rel_strength, max(m) FILTER (role = 'usd') AS usd_mom20,
  max(m) FILTER (role = 'us10y') AS us10y_mom20, max(m) FILTER (role = 'gold') AS gold_mom20 FROM w25_m GROUP BY date""")


@query("W25_macro_mom", pick("w25", "date", "risk_rel_strength usd_mom20 us10y_mom20 gold_mom20"))
def w25(spark, sf):
    return W.macro_mom(market(spark, sf))


part("w26", f"SELECT ticker, date, close / nullif(max(close) OVER ({TK} ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown FROM b_aligned")


@query("W26_drawdown", pick("w26", "ticker date", "drawdown"))
def w26(spark, sf):
    return keep(W.drawdown(aligned(spark, sf), "close"), "drawdown")


part("w27", f"SELECT role, date, lead(close, 5) OVER ({RO}) / nullif(close, 0) - 1 AS fwd_ret_5 FROM b_rolegrid")


@query("W27_forward_label", pick("w27", "role;date;regime_label=CASE WHEN fwd_ret_5 > 0.0075 THEN 'BULL' WHEN fwd_ret_5 < -0.0075 THEN 'BEAR' ELSE 'CHOP' END", "fwd_ret_5"))
def w27(spark, sf):
    return keep(W.forward_label(market(spark, sf), by=("role",)), "fwd_ret_5", "regime_label", key="role")


part("w32", f"SELECT ticker, date, avg(close) OVER ({TK} {rows(3)}) AS close_3d, avg(volume) OVER ({TK} {rows(5)}) AS volume_5d FROM b_aligned")


@query("W32_smooth", pick("w32", "ticker date", "close_3d volume_5d"))
def w32(spark, sf):
    return keep(W.smooth(aligned(spark, sf), {"close_3d": ("close", 3), "volume_5d": ("volume", 5)}), "close_3d", "volume_5d")


# closes on a coarse grid, so that unchanged ones occur
part("w33_in", "SELECT ticker, date, CAST(round(close / 20000) AS DOUBLE) AS close, volume FROM b_panel")
part("w33_b", f"SELECT *, CASE WHEN close = lag(close) OVER ({TK}) AND volume > 0 THEN 1 ELSE 0 END AS same FROM w33_in")
part("w33", """SELECT ticker, date, close, sum(same) OVER (PARTITION BY ticker, island ORDER BY date) AS flat_run FROM (
  SELECT *, sum(1 - same) OVER (PARTITION BY ticker ORDER BY date) AS island FROM w33_b)""")


@query("W33_flat_runs", pick("w33", "ticker date", "close", "flat_run"))
def w33(spark, sf):
    df = T.panel(spark, sf).withColumn("close", F.round(F.col("close") / 20000))
    return keep(W.flat_runs(df), "close", "flat_run")


part("w34", f"SELECT ticker, date, market_state, CASE WHEN market_state IS NOT DISTINCT FROM lag(market_state) OVER ({TK}) THEN 0 ELSE 1 END AS changed FROM b_trades")


@query("W34_flips", pick("w34", "ticker date market_state", "", "changed"))
def w34(spark, sf):
    return keep(W.flips(T.trade_log(spark, sf), "market_state"), "market_state", "changed")


part("w35", f"""SELECT ticker, date, last_value(close IGNORE NULLS) OVER ({TK}) AS close_f,
  first_value(close IGNORE NULLS) OVER ({TK} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close_b FROM b_aligned""")


@query("W35_fill", pick("w35", "ticker date", "close_f close_b"))
def w35(spark, sf):
    df = aligned(spark, sf).withColumns({"close_f": F.col("close"), "close_b": F.col("close")})
    return keep(W.bfill(W.ffill(df, ["close_f"]), ["close_b"]), "close_f", "close_b")


@query("W36_rebalance_dates", pick("b_rebal", "date next_date", "", "idx next_idx"))
def w36(spark, sf):
    return W.rebalance_dates(T.trading_days(spark, sf))


part("w36f", "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM b_cal WHERE isodow(date) = 5")


@query("W36_fridays", pick("w36f", "date next_date"))
def w36_fridays(spark, sf):
    return W.rebalance_dates(T.trading_days(spark, sf), "friday").select("date", "next_date")


FIRST, LAST = "1999-01-01", "2000-06-30"


@query("time_fence_features", pick(
    "w03 v JOIN w06 s ON s.ticker = v.ticker AND s.date = v.date JOIN w15 d ON d.ticker = v.ticker AND d.date = v.date", "ticker=v.ticker;date=v.date",
    "vol20=v.vol20;vol252=v.vol252;above200=s.above200;max_dd=d.max_dd", where=f"v.date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"))
def time_fence(spark, sf):
    """Features of a range of dates from a scan of that range and the look-back before it, checked against those of the whole history."""
    cal = T.trading_days(spark, sf)
    days = S.fence(cal, FIRST, LAST)
    df = W.pct(J.align(T.panel(spark, sf, days), J.calendar(S.between_days(cal, "date", days))), "close", 1, "ret")
    df = W.trailing_max_dd(W.above_sma(W.vol(df, "ret", {20: 10, 252: 126})))
    return keep(df.where(F.col("date").between(FIRST, LAST)), "vol20", "vol252", "above200", "max_dd")
