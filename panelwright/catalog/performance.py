"""Queries W28-W31, W37-W39, M01-M13 and B01-B06."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import filters as S, joins as J, performance as M, resampling as B, timeseries as W
from ..plans import tables as T
from ..session import materialise
from .portfolio import engine_weeks
from .registry import OFF_TIE, clone, part, pick, query  # noqa: F401
from .selection import WINDOWS, rank_sql

ST = "PARTITION BY strategy ORDER BY date"
part("m_eq", f"SELECT *, exp(sum(ln(1 + portfolio_return)) OVER ({ST})) AS e FROM b_returns")
part("w28", f"SELECT *, max(e) OVER ({ST}) AS pk FROM m_eq")


@query("W28_equity_fixed", pick("w28", "strategy date", "equity=1000 * e;peak=1000 * pk;drawdown=e / pk - 1"))
def w28(spark, sf):
    return M.equity_fixed(T.weekly_returns(spark, sf), 1000.0).select("strategy", "date", "equity", "peak", "drawdown")


part("m_pnl", "SELECT side AS strategy, date, sum(net_pnl) AS net_pnl FROM b_trades GROUP BY side, date")
part("w29", f"SELECT *, 1e6 + sum(net_pnl) OVER ({ST}) AS eq FROM m_pnl")
part("w29_r", f"SELECT *, CASE WHEN coalesce(lag(eq) OVER ({ST}), 1e6) > 0 THEN net_pnl / coalesce(lag(eq) OVER ({ST}), 1e6) ELSE 0 END AS r, max(eq) OVER ({ST}) AS pk FROM w29")


def side_pnl(spark, sf):
    return T.trade_log(spark, sf).groupBy(F.col("side").alias("strategy"), "date").agg(F.sum("net_pnl").alias("net_pnl"))


@query("W29_equity_compound", pick("w29_r", "strategy date", "equity=eq / 1000;portfolio_return=r;drawdown=eq / pk - 1"))
def w29(spark, sf):
    return M.equity_compound(side_pnl(spark, sf)).select("strategy", "date", (F.col("equity") / 1000).alias("equity"), "portfolio_return", "drawdown")


part("m_bench", "SELECT date, portfolio_return AS bench_return FROM b_returns WHERE strategy = 'S1'")
F26 = f"({ST} ROWS 25 PRECEDING)"
part("w30", f"""SELECT r.strategy, r.date, CASE WHEN count(*) OVER {F26} >= 13 THEN covar_samp(portfolio_return, bench_return) OVER {F26} / nullif(var_samp(bench_return) OVER {F26}, 0) END AS rolling_beta,
  CASE WHEN count(*) OVER {F26} >= 13 THEN avg(portfolio_return) OVER {F26} / nullif(stddev_samp(portfolio_return) OVER {F26}, 0) * sqrt(52) END AS rolling_sharpe
  FROM b_returns r JOIN m_bench b ON b.date = r.date""".replace(f"({ST} ROWS", "(PARTITION BY strategy ORDER BY r.date ROWS"))


def with_bench(spark, sf):
    r = T.weekly_returns(spark, sf)
    bench = r.where("strategy = 'S1'").select("date", F.col("portfolio_return").alias("bench_return"))
    return r.join(F.broadcast(bench), "date")


@query("W30_rolling_beta_sharpe", pick("w30", "strategy date", "rolling_beta rolling_sharpe"))
def w30(spark, sf):
    return M.rolling_beta_sharpe(with_bench(spark, sf)).select("strategy", "date", "rolling_beta", "rolling_sharpe")


F252 = f"({ST} ROWS 251 PRECEDING)"
part("w31_v", f"""SELECT *, CASE WHEN count(*) OVER {F252} >= 126 THEN quantile_cont(portfolio_return, 0.05) OVER {F252} END AS vh,
  CASE WHEN count(*) OVER {F252} >= 126 THEN avg(portfolio_return) OVER {F252} - 1.6448536269514722 * stddev_samp(portfolio_return) OVER {F252} END AS vn FROM b_returns""")
part("w31", f"SELECT *, lag(vh) OVER ({ST}) AS vk FROM w31_v")


@query("W31_rolling_var", pick("w31", "strategy date", "var_hist=vh;var_norm=vn;var_known=vk", "breach=portfolio_return < vk"))
def w31(spark, sf):
    return M.rolling_var(T.weekly_returns(spark, sf)).select("strategy", "date", "var_hist", "var_norm", "var_known", "breach")


# one split, by the definition
part("w37_a", "SELECT r.strategy, r.date, portfolio_return - bench_return AS a FROM b_returns r JOIN m_bench b ON b.date = r.date WHERE r.strategy <> 'S1'")
part("w37_c", f"SELECT *, abs(sum(a - m) OVER ({ST})) AS cs FROM (SELECT *, avg(a) OVER (PARTITION BY strategy) AS m, count(*) OVER (PARTITION BY strategy) AS n FROM w37_a)")
part("w37", "SELECT strategy, date, cs FROM w37_c WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY round(cs, 12) DESC, date) = 1")


def alphas(spark, sf):
    return with_bench(spark, sf).where("strategy <> 'S1'").select("strategy", "date", (F.col("portfolio_return") - F.col("bench_return")).alias("alpha"))


@query("W37_cusum_one", pick("w37", "strategy;break_date=date", "score=cs", "place=1"))
def w37(spark, sf):
    return M.cusum_breaks(alphas(spark, sf), 1)


# three rounds: each open segment is split at its peak, the break row itself left out
part("w37_s0", "SELECT strategy, date, a, 1 AS seg FROM w37_a")
for _l in range(3):
    part(f"w37_k{_l}", f"SELECT *, abs(sum(a - m) OVER (PARTITION BY strategy, seg ORDER BY date)) AS cs FROM (SELECT *, avg(a) OVER (PARTITION BY strategy, seg) AS m, "
                       f"count(*) OVER (PARTITION BY strategy, seg) AS n FROM w37_s{_l}) WHERE n >= 30")
    part(f"w37_b{_l}", f"SELECT strategy, seg, date AS bd, cs, {_l} AS lvl FROM w37_k{_l} QUALIFY row_number() OVER (PARTITION BY strategy, seg ORDER BY round(cs, 12) DESC, date) = 1")
    part(f"w37_s{_l + 1}", f"SELECT s.strategy, s.date, s.a, s.seg * 2 + (s.date > b.bd)::INT AS seg FROM w37_s{_l} s JOIN w37_b{_l} b ON b.strategy = s.strategy AND b.seg = s.seg WHERE s.date <> b.bd")
part("w37_all", "SELECT * FROM (SELECT * FROM w37_b0 UNION ALL SELECT * FROM w37_b1 UNION ALL SELECT * FROM w37_b2) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY lvl, seg) <= 3")
part("w37_three", "SELECT strategy, bd, cs, row_number() OVER (PARTITION BY strategy ORDER BY cs DESC, bd) AS place FROM w37_all")


@query("W37_cusum_three", pick("w37_three", "strategy;break_date=bd", "score=cs", "place"))
def w37_three(spark, sf):
    return M.cusum_breaks(materialise(alphas(spark, sf), "alphas"), 3)


def metrics_sql(name, src, keys):
    """Performance figures of piece ``src`` (keys, date, portfolio_return) as piece ``name``."""
    k = ", ".join(keys)
    part(name + "_e", f"SELECT *, exp(sum(ln(1 + portfolio_return)) OVER (PARTITION BY {k} ORDER BY date)) AS eq FROM {src}")
    part(name + "_d", f"SELECT *, eq / max(eq) OVER (PARTITION BY {k} ORDER BY date) - 1 AS dd, quantile_cont(portfolio_return, 0.05) OVER (PARTITION BY {k}) AS v95, "
                      f"quantile_cont(portfolio_return, 0.01) OVER (PARTITION BY {k}) AS v99 FROM {name}_e")
    part(name + "_g", f"""SELECT {k}, count(*) AS n, avg(portfolio_return) AS mean, coalesce(stddev_samp(portfolio_return), 0) AS sd,
      coalesce(stddev_samp(portfolio_return) FILTER (portfolio_return < 0), 0) AS sd_down, arg_max(eq, date) AS final, greatest((max(date) - min(date)) / 365.25, 1e-9) AS years,
      min(dd) AS max_dd, sqrt(avg(dd * dd)) AS ulcer, avg((portfolio_return > 0)::INT) AS win_rate, coalesce(avg(portfolio_return) FILTER (portfolio_return > 0), 0) AS avg_win,
      coalesce(avg(portfolio_return) FILTER (portfolio_return < 0), 0) AS avg_loss, coalesce(sum(portfolio_return) FILTER (portfolio_return > 0), 0) AS gains,
      coalesce(sum(portfolio_return) FILTER (portfolio_return < 0), 0) AS losses, any_value(v95) AS var95, any_value(v99) AS var99,
      avg(portfolio_return) FILTER (portfolio_return <= v95) AS cvar95, avg(portfolio_return) FILTER (portfolio_return <= v99) AS cvar99,
      list(portfolio_return) AS rs FROM {name}_d GROUP BY {k}""")
    part(name, f"""SELECT *, final - 1 AS total_return, pow(final, 1 / years) - 1 AS cagr, pow(final, 52.0 / n) - 1 AS cagr_periods, sd * sqrt(52) AS ann_vol,
      CASE WHEN abs(sd) > 1e-12 THEN mean * sqrt(52) / sd ELSE 0 END AS sharpe, CASE WHEN abs(sd_down) > 1e-12 THEN mean * sqrt(52) / sd_down ELSE 0 END AS sortino,
      CASE WHEN abs(max_dd) > 1e-12 THEN (pow(final, 1 / years) - 1) / abs(max_dd) ELSE 0 END AS calmar,
      CASE WHEN abs(avg_loss) > 1e-12 THEN abs(avg_win / avg_loss) ELSE 0 END AS win_loss, CASE WHEN abs(losses) > 1e-12 THEN abs(gains / losses) ELSE 0 END AS gain_pain,
      mean - 1.6448536269514722 * sd AS p_var95, mean - 2.3263478740408408 * sd AS p_var99, mean - 2.0627128075074257 * sd AS p_cvar95, mean - 2.665214220345808 * sd AS p_cvar99,
      list_aggregate(list_transform(rs, lambda x: pow((x - mean), 3)), 'avg') / pow(list_aggregate(list_transform(rs, lambda x: pow(x - mean, 2)), 'avg'), 1.5) AS skew,
      list_aggregate(list_transform(rs, lambda x: pow((x - mean), 4)), 'avg') / pow(list_aggregate(list_transform(rs, lambda x: pow(x - mean, 2)), 'avg'), 2) - 3 AS kurt FROM {name}_g""")


metrics_sql("mx", "b_returns", ["strategy"])
GROUPS = {
    "M01_returns": "total_return cagr cagr_periods ann_vol", "M02_sharpe_sortino": "sharpe sortino", "M03_drawdowns": "max_dd calmar ulcer",
    "M04_win_loss": "win_rate avg_win avg_loss win_loss gain_pain", "M05_var_cvar": "var95 var99 cvar95 cvar99",
    "M08_moments": "skew kurt", "M11_kpis": "total_return cagr sharpe sortino max_dd"}
for _id, _cols in GROUPS.items():
    def _run(spark, sf, cols=_cols):
        return M.metrics(T.weekly_returns(spark, sf)).select("strategy", *cols.split())
    query(_id, pick("mx", "strategy", _cols))(_run)


@query("M06_parametric", pick("mx", "strategy", "p_var95;p_var99;p_cvar95;p_cvar99;tail95=abs(var95) / abs(p_var95);tail99=abs(var99) / abs(p_var99)"))
def m06(spark, sf):
    return M.metrics(T.weekly_returns(spark, sf)).select("strategy", "p_var95", "p_var99", "p_cvar95", "p_cvar99", "tail95", "tail99")


part("m07", "SELECT strategy, count(*) AS days, sum((portfolio_return < vk)::INT) AS breaches FROM w31 WHERE vk IS NOT NULL GROUP BY strategy")


@query("M07_breach_test", pick("m07", "strategy;status=CASE WHEN abs(breaches / days - 0.05) < 0.015 THEN 'PASS' ELSE 'WARN' END", "expected=days * 0.05;rate=breaches / days", "days;breaches"))
def m07(spark, sf):
    return M.breach_test(T.weekly_returns(spark, sf))


@query("M09_annual_factor", pick("b_returns GROUP BY strategy", "strategy", "", "annual_factor=CASE WHEN count(*) < 3 THEN 52 WHEN (max(date) - min(date)) / count(*) <= 4 THEN 252 ELSE 52 END"))
def m09(spark, sf):
    return M.annual_factor(T.weekly_returns(spark, sf))


part("m10_j", "SELECT w.strategy, w.date, w.e, (SELECT max_by(close, b.date) FROM b_broad b WHERE b.date <= w.date) AS close FROM w28 w")
part("m10_d", f"SELECT *, close / max(close) OVER ({ST}) - 1 AS dd FROM m10_j WHERE close IS NOT NULL")
part("m10", """SELECT strategy, arg_max(e, date) - 1 AS total_return, arg_max(close, date) / arg_min(close, date) - 1 AS bench_total,
   pow(arg_max(close, date) / arg_min(close, date), 1 / greatest((max(date) - min(date)) / 365.25, 1e-9)) - 1 AS bench_cagr, min(dd) AS bench_dd FROM m10_d GROUP BY strategy""")


@query("M10_benchmark", pick("m10", "strategy", "total_return;bench_total;bench_cagr;bench_dd;excess_return=total_return - bench_total"))
def m10(spark, sf):
    eq = M.equity_fixed(T.weekly_returns(spark, sf), 1.0).select("strategy", "date", "equity")
    return M.benchmark_comparison(eq, T.broad(spark, sf).select("date", "close"))


part("m12_in", 'SELECT r.strategy, w.window_name AS win, r.date, portfolio_return FROM b_returns r JOIN f10_w w ON r.date BETWEEN w.a AND w.b')
metrics_sql("m12", "m12_in", ["strategy", "win"])


@query("M12_window_report", pick("m12", "strategy;\"window\"=win", "total_return;sharpe;ann_vol;max_dd;win_rate", "n"))
def m12(spark, sf):
    r = S.split_windows(T.weekly_returns(spark, sf), WINDOWS)
    return M.metrics(r, ("strategy", "window")).select("strategy", "window", "total_return", "sharpe", "ann_vol", "max_dd", "win_rate", "n")


part("w38_in", "SELECT strategy, CASE WHEN date < DATE '1998-06-01' THEN 'pre' ELSE 'post' END AS part, date, portfolio_return FROM b_returns")
metrics_sql("w38", "w38_in", ["strategy", "part"])


@query("W38_split_metrics", pick("w38", "strategy part", "total_return sharpe sortino win_rate mean ann_vol max_dd"))
def w38(spark, sf):
    return M.split_metrics(T.weekly_returns(spark, sf), "1998-06-01").select("strategy", "part", "total_return", "sharpe", "sortino", "win_rate", "mean", "ann_vol", "max_dd")


part("w39", "SELECT ticker, date, close * 1000 / first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS value FROM b_aligned")


@query("W39_rebase", pick("w39", "ticker date", "value"))
def w39(spark, sf):
    from .timeseries import aligned
    return M.rebase(aligned(spark, sf), 1000.0, ("ticker",)).select("ticker", "date", "value")


part("m13_r", f"SELECT *, {rank_sql('fwd_ret', True, 'split')} AS ry, {rank_sql('mom60_z', True, 'split')} AS rp FROM (SELECT *, CASE WHEN year(date) < 1999 THEN 'train' ELSE 'test' END AS split FROM b_features)")


@query("M13_prediction_metrics", pick("m13_r GROUP BY split", "split", "spearman=corr(ry, rp);mse=avg(pow(fwd_ret - mom60_z, 2))", "n=count(*)"))
def m13(spark, sf):
    f = materialise(T.weekly_features(spark, sf).withColumn("split", F.when(F.year("date") < 1999, "train").otherwise("test")), "features")
    return M.prediction_metrics(f, "fwd_ret", "mom60_z")


@query("M13_accuracy", pick("g08 GROUP BY ALL", "baseline_state", "accuracy=avg((baseline_state = prob_state)::INT)", "n=count(*)"))
def m13_accuracy(spark, sf):
    from .regime import validation
    return M.accuracy(validation(spark, sf), "baseline_state", "prob_state", ("baseline_state",))


# resampling: the same hashes in SQL
def u01(*parts_):
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts_)})), 1, 8))::BIGINT / 4294967296.0)"


BLOCKS, REPS, CHECKS = (4.0, 8.0, 12.0, 16.0), 3000, 2000
part("b_num", "SELECT strategy, date, portfolio_return AS r, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM b_returns")


def draws_sql(name, lengths, blocks, reps):
    """Source positions (n, block, rep, i, pos) for series of the lengths ``n``."""
    part(name + "_p", f"SELECT n, rep, unnest(range(n)) AS i FROM (SELECT n, unnest(range({reps})) AS rep FROM (SELECT DISTINCT n FROM {lengths}))")
    part(name + "_h", f"SELECT *, ('0x' || substr(md5(concat_ws('|', '42', 'p', rep::VARCHAR, (i // 4)::VARCHAR)), (i % 4) * 8 + 1, 8))::BIGINT / 4294967296.0 AS u, "
                      f"floor({u01("'42'", "'s'", "rep::VARCHAR", "i::VARCHAR")} * n)::BIGINT AS begin_at FROM {name}_p")
    part(name + "_u", f"SELECT *, CASE WHEN i = 0 OR u < 1.0 / block THEN i END AS start_i, CASE WHEN i = 0 OR u < 1.0 / block THEN begin_at END AS start_at FROM {name}_h, (SELECT unnest({list(blocks)})::DOUBLE AS block)")
    over = "(PARTITION BY n, block, rep ORDER BY i)"
    part(name, f"SELECT n, block, rep, i, (last_value(start_at IGNORE NULLS) OVER {over} + i - last_value(start_i IGNORE NULLS) OVER {over}) % n AS pos FROM {name}_u")


draws_sql("b01_draw", "b_num", BLOCKS, REPS)
part("b01_path", """SELECT b.strategy, d.block, d.rep, d.i, d.n, b.r, exp(sum(ln(1 + b.r)) OVER (PARTITION BY b.strategy, d.block, d.rep ORDER BY d.i)) AS nav
   FROM b01_draw d JOIN b_num b ON b.n = d.n AND b.pos = d.pos""")
part("b01", """SELECT strategy, block, rep, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(52) ELSE 0 END AS sharpe, (pow(arg_max(nav, i), 52.0 / max(n)) - 1) * 100 AS cagr,
   min(nav / pk - 1) * 100 AS max_dd FROM (SELECT *, max(nav) OVER (PARTITION BY strategy, block, rep ORDER BY i) AS pk FROM b01_path) GROUP BY strategy, block, rep""")


@query("B01_block_bootstrap", pick("b01", "strategy", "block sharpe cagr max_dd", "rep"))
def b01(spark, sf):
    return B.block_bootstrap(T.weekly_returns(spark, sf), BLOCKS, REPS)


@query("B01_bootstrap_summary", pick("b01 GROUP BY strategy, block", "strategy", "block;" + ";".join(
    f"{c}_mean=avg({c});{c}_low=quantile_cont({c}, 0.025);{c}_high=quantile_cont({c}, 0.975)" for c in ("sharpe", "cagr", "max_dd"))))
def b01_summary(spark, sf):
    return B.bootstrap_summary(B.block_bootstrap(T.weekly_returns(spark, sf), BLOCKS, REPS), ("strategy", "block"))


part("b02_s", "SELECT strategy, n, sharpe, skew, kurt FROM mx")
part("b02_v", "SELECT a.strategy, var_pop(b.sharpe) AS v FROM b02_s a JOIN b02_s b ON b.strategy <> a.strategy GROUP BY a.strategy")
# expected best of 50 chance results, from the normal quantile
B02Z = (1 - B.EULER) * NormalDist().inv_cdf(1 - 1 / 50) + B.EULER * NormalDist().inv_cdf(1 - 1 / (50 * math.e))
part("b02_t", f"""SELECT s.*, sqrt(v / 52) * {B02Z} * sqrt(52) AS sr0, (sharpe / sqrt(52) - sqrt(v / 52) * {B02Z})
   / sqrt((1 - skew * sharpe / sqrt(52) + (kurt + 2) / 4 * sharpe * sharpe / 52) / (n - 1.0)) AS t_stat FROM b02_s s JOIN b02_v v ON v.strategy = s.strategy""")


# the same series by logarithms of the double factorials
B02CDF = f"""CASE WHEN t_stat = 0 THEN 0.5 WHEN t_stat < -{B.CDF_END} THEN 0 WHEN t_stat > {B.CDF_END} THEN 1 ELSE 0.5 + sign(t_stat) * exp(-t_stat * t_stat / 2) / sqrt(2 * pi())
   * list_sum([exp((2 * k + 1) * ln(abs(t_stat)) - lgamma(2 * k + 3) + (k + 1) * ln(2) + lgamma(k + 2)) FOR k IN range({B.CDF_TERMS} + 1)]) END"""


@query("B02_deflated_sharpe", pick("b02_t", "strategy", f"ann_sharpe=sharpe;skew;kurt;sr0;t_stat;dsr={B02CDF}", "n"))
def b02(spark, sf):
    return B.deflated_sharpe(T.weekly_returns(spark, sf))


@query("B02_deflated_inputs", pick("b02_t", "strategy", "ann_sharpe=sharpe;skew;kurt;sr0;t_stat", "n"))
def b02_inputs(spark, sf):
    return B.deflated_sharpe(T.weekly_returns(spark, sf)).drop("dsr")


part("b03_common", "SELECT strategy, date, portfolio_return AS x, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM j12")
part("b03_blk", "SELECT strategy, least(pos // (n // 8), 7) AS blk, x FROM b03_common")
part("b03_split", "SELECT m, row_number() OVER (ORDER BY k DESC) - 1 AS split FROM (SELECT m, list_sum([((m >> b) & 1) * (1 << (7 - b)) FOR b IN range(8)]) AS k FROM (SELECT unnest(range(256)) AS m) WHERE bit_count(m) = 4)")
part("b03_sr", """SELECT split, strategy, (m >> blk) & 1 AS train, avg(x) / stddev_samp(x) * sqrt(52) AS sr FROM b03_blk, b03_split GROUP BY split, strategy, (m >> blk) & 1""")
part("b03_best", "SELECT split, strategy AS best FROM b03_sr WHERE train = 1 QUALIFY row_number() OVER (PARTITION BY split ORDER BY sr DESC, strategy) = 1")
part("b03_rank", "SELECT split, strategy, (row_number() OVER (PARTITION BY split ORDER BY sr, strategy) - 1) / (count(*) OVER (PARTITION BY split) - 1.0) AS pct FROM b03_sr WHERE train = 0")


def common(spark, sf):
    return J.common_dates(T.weekly_returns(spark, sf).where("NOT (strategy = 'S3' AND portfolio_return > 0.02)"))


@query("B03_pbo_ranks", pick("b03_best b JOIN b03_rank r ON r.split = b.split AND r.strategy = b.best", "best=b.best", "rank_pct=pct", "split=b.split"))
def b03_ranks(spark, sf):
    return B.pbo_ranks(common(spark, sf))


@query("B03_pbo", pick("b03_best b JOIN b03_rank r ON r.split = b.split AND r.strategy = b.best", "", "pbo=avg((pct < 0.5)::INT) * 100;avg_rank=avg(pct)", "splits=count(*)"))
def b03(spark, sf):
    return B.pbo(common(spark, sf))


part("b04_x", "SELECT a.strategy, a.pos, a.n, a.x - b.x AS x FROM b03_common a JOIN b03_common b ON b.strategy = 'S1' AND b.date = a.date WHERE a.strategy <> 'S1'")
draws_sql("b04_draw", "b04_x", (8.0,), CHECKS)
part("b04_act", "SELECT strategy, avg(x) AS mean, CASE WHEN avg(x) < -sqrt(var_pop(x) / count(*)) * 2 THEN 0 ELSE avg(x) END AS centre FROM b04_x GROUP BY strategy")
part("b04_boot", "SELECT d.rep, x.strategy, avg(x.x) AS boot FROM b04_draw d JOIN b04_x x ON x.pos = d.pos GROUP BY d.rep, x.strategy")
part("b04", "SELECT b.rep, max(boot - mean) AS w, max(boot - centre) AS s FROM b04_boot b JOIN b04_act a ON a.strategy = b.strategy GROUP BY b.rep")


@query("B04_reality_check", pick("b04, (SELECT mean AS champ FROM b04_act WHERE strategy = 'S5')", "", "white_p=avg((w >= champ)::INT);spa_p=avg((s >= champ)::INT)", "reps=count(*)"))
def b04(spark, sf):
    return B.reality_check(materialise(common(spark, sf), "returns"), "S1", "S5", CHECKS)


# a draw of 40 places in SQL: the place of step i, or the last one possible where it is taken
SIMS, NAMES = 2000, 40
part("b05_n", f"SELECT date, fwd_ret AS x, row_number() OVER (PARTITION BY date ORDER BY floor({u01('ticker')} * {B.PARTS}), ticker) - 1 AS pos, count(*) OVER (PARTITION BY date) AS n FROM b_names")
part("b05_t", f"""SELECT date, sim, n, list_transform(range({NAMES}), lambda i: [floor(('0x' || substr(md5(concat_ws('|', '42', sim::VARCHAR, date::VARCHAR, (i // 4)::VARCHAR)), (i % 4) * 8 + 1, 8))::BIGINT
   / 4294967296.0 * (n - {NAMES} + i + 1))::BIGINT]) AS t FROM (SELECT DISTINCT date, n FROM b05_n WHERE n >= {NAMES}), (SELECT unnest(range({SIMS})) AS sim)""")
part("b05_s", f"SELECT date, sim, unnest(list_reduce(t, lambda s, x, i: list_append(s, CASE WHEN list_contains(s, x[1]) THEN n - {NAMES} + i - 1 ELSE x[1] END), CAST([] AS BIGINT[]))) AS pos FROM b05_t")
part("b05_d", "SELECT s.sim, s.date, avg(x) AS x FROM b05_s s JOIN b05_n p ON p.date = s.date AND p.pos = s.pos GROUP BY s.sim, s.date")
part("b05_w", f"SELECT w.sim, w.date, coalesce(x, 0) AS r FROM (SELECT sim, date FROM (SELECT DISTINCT date FROM b_names), (SELECT unnest(range({SIMS})) AS sim)) w LEFT JOIN b05_d d ON d.sim = w.sim AND d.date = w.date")
part("b05", "SELECT sim, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 0) AS sharpe FROM b05_w GROUP BY sim")


def sims(spark, sf):
    f = materialise(T.weekly_names(spark, sf), "weekly")
    return B.random_portfolios(f, f, NAMES, SIMS, ret="fwd_ret")


@query("B05_random_portfolios", pick("b05", "", "sharpe", "sim"))
def b05(spark, sf):
    return sims(spark, sf)


@query("B05_random_portfolio_p", pick("b05", "", "p_value=(count_if(sharpe >= 0.5) + 1) / (count(*) + 1);mean_sharpe=avg(sharpe)"))
def b05_p(spark, sf):
    return B.random_portfolio_p(sims(spark, sf), F.lit(0.5))


part("b06_in", "SELECT strategy, date, net_pnl / 1e6 AS r, 'FIXED_CAPITAL' AS convention FROM m_pnl UNION ALL SELECT strategy, date, r, 'COMPOUNDING_CAPITAL' FROM w29_r")
part("b06_e", "SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, convention ORDER BY date)) AS e FROM b06_in")
part("b06", """SELECT strategy, convention, count(*) AS n, arg_max(e, date) - 1 AS cum_ret, stddev_samp(r) * sqrt(52) AS ann_vol, avg(r) * 52 / (stddev_samp(r) * sqrt(52) + 1e-12) AS sharpe,
   pow(arg_max(e, date), 52.0 / count(*)) - 1 AS cagr, min((e - p) / (p + 1e-9)) AS max_dd FROM (SELECT *, max(e) OVER (PARTITION BY strategy, convention ORDER BY date) AS p FROM b06_e) GROUP BY strategy, convention""")


@query("B06_ablation", pick("b06", "strategy convention", "cum_ret ann_vol sharpe cagr max_dd", "n"))
def b06(spark, sf):
    return B.ablation(side_pnl(spark, sf))


clone(["w29", "w29_r", "b06_in", "b06_e", "b06"], {"m_pnl": "ml_pnl"}, "ml_")


@query("P21_accounting_models", pick("ml_b06", "engine=strategy;convention", "log_cum=ln(1 + cum_ret);ann_vol;sharpe;log_cagr=ln(1 + cagr);max_dd", "n"))
def accounting_models(spark, sf):
    """Static and monthly refitted model, each with fixed and compounding capital; growth as logarithms (open prices of the given tables move a lot)."""
    weekly = materialise(engine_weeks(spark, sf).select(F.col("scenario").alias("engine"), "date", "net_pnl"), "weekly")
    out = B.ablation(weekly, by=("engine",))
    return out.select("engine", "convention", "n", "ann_vol", "sharpe", "max_dd", F.log1p("cum_ret").alias("log_cum"), F.log1p("cagr").alias("log_cagr"))
