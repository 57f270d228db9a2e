"""Queries D01-D10 and V01."""

from pyspark.sql import Window, functions as F

from ..functions import scalar as X
from ..operators import aggregates as A, alpha as V, datasets as D, joins as J, performance as M, portfolio as P, timeseries as W
from ..plans import tables as T
from ..session import materialise, new_folder, packed
from .registry import part, pick, query
from .selection import rank_sql
from .timeseries import RO, aligned, gate, market, with_ret

part("d01", """SELECT s.ticker, r.date, s.mom20, s.mom60, e.open AS entry_open, x.close AS exit_close, CASE WHEN e.open > 0 AND x.close IS NOT NULL THEN x.close / e.open - 1 END AS target_fwd_ret
  FROM b_rebal r JOIN w01 s ON s.idx = r.idx - 1 LEFT JOIN b_aligned e ON e.ticker = s.ticker AND e.idx = r.idx
  LEFT JOIN b_aligned x ON x.ticker = s.ticker AND x.idx = r.next_idx - 1 WHERE r.next_idx IS NOT NULL""")


def samples(spark, sf):
    cal = T.trading_days(spark, sf)
    df = W.pcts(J.align(T.panel(spark, sf), cal), {"mom20": ("close", 20), "mom60": ("close", 60)})
    return D.weekly_samples(df, W.rebalance_dates(cal), ("mom20", "mom60"))


@query("D01_weekly_samples", pick("d01", "ticker date", "mom20 mom60 entry_open exit_close target_fwd_ret", "", "date > (SELECT min(date) FROM b_rebal)"))
def d01(spark, sf):
    s = samples(spark, sf)
    # the first week has no day before it
    first = s.agg(F.min("date").alias("d")).scalar()
    return s.where(F.col("date") > first)


part("d_bent", """SELECT r.date, x.close / e.open - 1 AS market_ret FROM b_rebal r JOIN (SELECT c.idx, b.open FROM b_cal c JOIN b_broad b ON b.date = c.date) e ON e.idx = r.idx
  JOIN (SELECT c.idx, b.close FROM b_cal c JOIN b_broad b ON b.date = c.date) x ON x.idx = r.next_idx - 1""")
part("d02_in", "SELECT d.*, s.sector, coalesce(m.market_ret, 0) AS market_ret FROM d01 d JOIN b_sectors s ON s.ticker = d.ticker LEFT JOIN d_bent m ON m.date = d.date WHERE target_fwd_ret IS NOT NULL")
part("d02", f"SELECT *, target_fwd_ret - market_ret AS ex, avg(target_fwd_ret) OVER (PARTITION BY date, sector) AS sm, {rank_sql('target_fwd_ret')} AS rk FROM d02_in")


def market_weekly(spark, sf):
    cal = T.trading_days(spark, sf)
    b = J.align(T.broad(spark, sf).withColumn("role", F.lit("broad")), cal, ("role",))
    return D.weekly_samples(b, W.rebalance_dates(cal), (), ("role",)).select("date", F.col("target_fwd_ret").alias("market_ret"))


def with_targets(spark, sf):
    s = materialise(J.with_sector(samples(spark, sf), T.sectors(spark, sf)), "samples")
    return D.targets(s, market_weekly(spark, sf))


@query("D02_targets", pick("d02", "ticker date sector", "target_fwd_ret;target_excess_nifty=ex;target_excess_sector=target_fwd_ret - sm;target_cs_rank=rk"))
def d02(spark, sf):
    return with_targets(spark, sf).select("ticker", "date", "sector", "target_fwd_ret", "target_excess_nifty", "target_excess_sector", "target_cs_rank")


part("d03_in", """SELECT r.ticker, r.date, r.idx, r.ret, b.bret, s.sector, f.sector_ret FROM b_ret r JOIN w_bret b ON b.date = r.date JOIN b_sectors s ON s.ticker = r.ticker
  LEFT JOIN (SELECT sector, x.date, avg(ret) AS sector_ret FROM b_ret x JOIN b_sectors y ON y.ticker = x.ticker GROUP BY sector, x.date) f ON f.sector = s.sector AND f.date = r.date""")
part("d03_m", "SELECT *, CASE WHEN ret IS NOT NULL AND bret IS NOT NULL AND sector_ret IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND bret IS NOT NULL AND sector_ret IS NOT NULL THEN bret END AS m, "
     "CASE WHEN ret IS NOT NULL AND bret IS NOT NULL AND sector_ret IS NOT NULL THEN sector_ret END AS s FROM d03_in")
WB = "(PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)"
part("d03_c", f"""SELECT ticker, date, idx, count(y) OVER {WB} AS n, covar_samp(y, m) OVER {WB} AS ym, covar_samp(y, s) OVER {WB} AS ys, covar_samp(m, s) OVER {WB} AS ms,
   var_samp(m) OVER {WB} AS vm, var_samp(s) OVER {WB} AS vs FROM d03_m""")
part("d03_b", """SELECT ticker, date, idx, CASE WHEN n >= 100 AND vm * vs - ms * ms > 1e-9 * vm * vs THEN (ym * vs - ys * ms) / (vm * vs - ms * ms) ELSE 1 END AS bm,
   CASE WHEN n >= 100 AND vm * vs - ms * ms > 1e-9 * vm * vs THEN (ys * vm - ym * ms) / (vm * vs - ms * ms) ELSE 1 END AS bs FROM d03_c""")
part("d03", """SELECT t.ticker, t.date, bm, bs, target_fwd_ret - bm * market_ret - bs * sm AS target_residual FROM d02 t JOIN b_rebal r ON r.date = t.date
   JOIN d03_b b ON b.ticker = t.ticker AND b.idx = r.idx - 1""")


@query("D03_residual_target", pick("d03", "ticker date", "beta_market=bm;beta_sector=bs;target_residual"))
def d03(spark, sf):
    cal = T.trading_days(spark, sf)
    daily = J.with_sector(with_ret(spark, sf), T.sectors(spark, sf))
    b = W.pct(J.align(T.broad(spark, sf).withColumn("role", F.lit("broad")), cal, ("role",)), "close", 1, "market_ret", ("role",))
    daily = daily.join(F.broadcast(b.select("date", "market_ret")), "date")
    daily = A.sector_mean(daily.select("ticker", "date", "idx", "sector", "ret", "market_ret"), "ret", "sector_ret")
    betas = D.rolling_betas(daily)
    signal = W.rebalance_dates(cal).select(F.col("date").alias("sample"), (F.col("idx") - 1).alias("idx"))
    at = betas.join(F.broadcast(signal), "idx").select("ticker", F.col("sample").alias("date"), "beta_market", "beta_sector")
    return D.residual_target(with_targets(spark, sf).join(at, ["ticker", "date"])).select("ticker", "date", "beta_market", "beta_sector", "target_residual")


part("d04_b", f"""SELECT date, close, ret, {', '.join(f'(close - {gate("avg", "close", w, w // 2, RO)}) / nullif({gate("avg", "close", w, w // 2, RO)}, 0) AS dist_sma{w}' for w in (50, 100, 200))},
  {', '.join(f'abs(close - lag(close, {n}) OVER ({RO})) / nullif({gate("sum", "ad", n, n // 2, RO)}, 0) AS eff_ratio_{n}' for n in (20, 50, 100))},
  {', '.join(f'close / nullif(lag(close, {k}) OVER ({RO}), 0) - 1 AS mom{k}' for k in (5, 10, 20, 60))},
  {gate('stddev_samp', 'ret', 20, 10, RO)} * sqrt(252.0) AS vol20, {gate('stddev_samp', 'ret', 60, 30, RO)} * sqrt(252.0) AS vol60,
  {gate('avg', 'ret', 20, 10, RO)} * 252 AS m20, {gate('avg', 'ret', 60, 30, RO)} * 252 AS m60, close / max(close) OVER ({RO}) - 1 AS drawdown,
  lead(close, 5) OVER ({RO}) / nullif(close, 0) - 1 AS fwd_ret_5
  FROM (SELECT *, close / nullif(lag(close) OVER ({RO}), 0) - 1 AS ret, abs(close - lag(close) OVER ({RO})) AS ad FROM b_rolegrid) WHERE role = 'broad'""")
part("d04_x", "SELECT date, CASE WHEN count(mom20) > 10 THEN stddev_pop(mom20) END AS cross_dispersion FROM w01 GROUP BY date")
part("d04", """SELECT b.*, vol20 / nullif(vol60, 0) AS vol_ratio, m20 / nullif(vol20, 0) AS sharpe_20, m60 / nullif(vol60, 0) AS sharpe_60, t.breadth, t.breadth_mom20, v.vix, v.vix_sma20, v.vix_z,
  q.risk_rel_strength, q.usd_mom20, q.us10y_mom20, q.gold_mom20, x.cross_dispersion, r.rsi14_market,
  CASE WHEN fwd_ret_5 > 0.0075 THEN 'BULL' WHEN fwd_ret_5 < -0.0075 THEN 'BEAR' ELSE 'CHOP' END AS regime_label
  FROM d04_b b LEFT JOIN w23 t ON t.date = b.date LEFT JOIN w24 v ON v.date = b.date LEFT JOIN w25 q ON q.date = b.date LEFT JOIN d04_x x ON x.date = b.date
  LEFT JOIN w11 r ON r.role = 'broad' AND r.date = b.date
  WHERE isodow(b.date) = 5 AND dist_sma200 IS NOT NULL AND vol20 IS NOT NULL AND t.breadth IS NOT NULL AND fwd_ret_5 IS NOT NULL""")


def regime_rows(spark, sf):
    # one alignment feeds both breadth and dispersion
    p = W.pct(W.above_sma(aligned(spark, sf)), "close", 20, "mom20")
    cross = p.groupBy("date").agg(F.avg("above200").alias("breadth"), F.when(F.count("mom20") > 10, F.stddev_pop("mom20")).alias("cross_dispersion"))
    return D.regime_dataset(materialise(market(spark, sf), "market"), cross)


@query("D04_regime_dataset", pick("d04", "date regime_label", " ".join(D.REGIME_FEATURES) + " fwd_ret_5"))
def d04(spark, sf):
    return regime_rows(spark, sf)


@query("D05_time_split", pick("b_features GROUP BY 1", "split=CASE WHEN year(date) < 1999 THEN 'train' ELSE 'test' END", "mean_ret=avg(fwd_ret)", "n=count(*)"))
def d05(spark, sf):
    a, b = D.time_split(T.weekly_features(spark, sf), 1999)
    both = a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.avg("fwd_ret").alias("mean_ret"), F.count("*").alias("n"))


def ml_rows(spark, sf, weekly=None):
    """The training table: features, clipped target and the date its outcome is known."""
    from ..operators.filters import winsor
    f = P.structure_score(T.weekly_features(spark, sf) if weekly is None else weekly).withColumnRenamed("fwd_ret", "target_fwd_ret")
    f = winsor(f, "target_fwd_ret").dropna(subset=[*D.FEATURES, "target_fwd_ret"])
    return materialise(f.select("date", "ticker", *D.FEATURES, "target_fwd_ret", F.date_add("date", 7).alias("exit_date")), "training")


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*D.FEATURES, "target_fwd_ret") if c not in ("structure_score",))
part("ml_rows", "SELECT f.*, f.fwd_ret AS target_fwd_ret FROM b_features f")


@query("D06_train_regression")
def d06(spark, sf):
    """Boosted trees on the years before 1999, rank correlation and error after."""
    past, later = D.time_split(ml_rows(spark, sf), 1999)
    model = D.train(past, D.regression_pipeline(), "target_fwd_ret")
    pred = materialise(model.transform(later).select("date", "ticker", "target_fwd_ret", "prediction", F.lit("test").alias("split")), "predictions")
    return M.prediction_metrics(pred, "target_fwd_ret", "prediction")


@query("D06_split_sizes", pick(f"ml_rows WHERE {COMPLETE} GROUP BY 1", "split=CASE WHEN year(date) < 1999 THEN 'train' ELSE 'test' END", "", "n=count(*)"))
def d06_sizes(spark, sf):
    """Complete rows on either side of the cut: what the model learns from and is measured on."""
    parts = D.time_split(ml_rows(spark, sf).dropna(subset=[*D.FEATURES, "target_fwd_ret"]), 1999)
    return parts[0].withColumn("split", F.lit("train")).unionByName(parts[1].withColumn("split", F.lit("test"))).groupBy("split").agg(F.count("*").alias("n"))


@query("D07_train_classifier")
def d07(spark, sf):
    """Regime classes after 1999 by a forest trained before; the confusion counts."""
    rows = materialise(regime_rows(spark, sf), "regimes")
    past, later = D.time_split(rows, 1999)
    model = D.train(past, D.classifier_pipeline(), "regime_label")
    scored = D.class_probabilities(model.transform(later), model)
    return A.crosstab(scored, "regime_label", "predicted", ("BULL", "CHOP", "BEAR"))


STORES: dict = {}


def monthly_models(spark, sf):
    """The weekly rows and a stored model for every month that has earlier outcomes; a second query of a session finds them stored."""
    weekly = materialise(T.weekly_features(spark, sf), "weekly")  # raw lines are read once
    rows = packed(ml_rows(spark, sf, weekly), "rows")  # a slice for every month is read
    months = [r["m"] for r in weekly.select(X.month_key("date").alias("m")).distinct().collect()]
    folder = STORES.setdefault((spark.sparkContext.applicationId, sf), new_folder(spark, "models"))
    return rows, D.walk_forward(rows, D.regression_pipeline(), "target_fwd_ret", months, folder=folder, at_once=8)


def scored_rows(spark, sf):
    """Every weekly row, complete or not, by the newest model of an earlier month; a fallback before the first."""
    rows = ml_rows(spark, sf)
    line = D.regression_pipeline(trees=3)
    models = D.walk_forward(rows, line, "target_fwd_ret", ["1997-01", "1999-01"])
    fallback = D.train(rows.where(F.year("date") < 1996), line, "target_fwd_ret")
    return D.score(materialise(P.structure_score(T.weekly_features(spark, sf)), "features"), models, fallback)


@query("D08_score_by_month")
def d08(spark, sf):
    return scored_rows(spark, sf).select("date", "ticker", "ml_pred_return")


@query("D08_score_coverage", pick("b_features", "date;ticker;model=CASE WHEN date < DATE '1997-01-01' THEN 'fallback' WHEN date < DATE '1999-01-01' THEN '1997-01' ELSE '1999-01' END", "", "scored=1"))
def d08_coverage(spark, sf):
    """Which model scored which row: none is left out for a missing feature or target."""
    return scored_rows(spark, sf).select("date", "ticker", "model", F.col("ml_pred_return").isNotNull().cast("int").alias("scored"))


@query("D09_walk_forward")
def d09(spark, sf):
    """Error by year, each row scored by the model of its month."""
    rows, models = monthly_models(spark, sf)
    scored = D.score(rows, models)
    return scored.groupBy(F.year("date").alias("y")).agg(F.avg(F.pow(F.col("target_fwd_ret") - F.col("ml_pred_return"), 2)).alias("mse"), F.count("*").alias("n"))


@query("D09_model_index", pick(f"(SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM b_features) m JOIN ml_rows r ON strftime(r.date + 7, '%Y-%m') < m.month WHERE {COMPLETE} GROUP BY m.month",
                               "month=m.month", "", "train_rows=count(*)"))
def d09_index(spark, sf):
    """The stored models: every month with the number of rows known before it."""
    return monthly_models(spark, sf)[1].table().select("month", "train_rows")


@query("D10_importance")
def d10(spark, sf):
    model = D.train(ml_rows(spark, sf), D.regression_pipeline(), "target_fwd_ret")
    return D.importance(spark, model, D.FEATURES)


@query("D10_importance_sum", pick("(SELECT 1)", "", "total=1.0", f"features={len(D.FEATURES)}"))
def d10_sum(spark, sf):
    """Importances of all features add up to 1."""
    out = D.importance(spark, D.train(ml_rows(spark, sf), D.regression_pipeline(trees=10), "target_fwd_ret"), D.FEATURES)
    return out.agg(F.sum("importance").alias("total"), F.count("*").alias("features"))


part("v01", "SELECT f.date, f.ticker, coalesce(r.portfolio_return, 0) AS score FROM b_features f LEFT JOIN j_s1 r ON r.date = f.date")


@query("V01_stored_returns", pick("v01", "date ticker", "score;confidence=1"))
def v01(spark, sf):
    stored = T.weekly_returns(spark, sf).where("strategy = 'S1' AND portfolio_return > 0")
    return V.StoredReturns(stored).scores(T.weekly_features(spark, sf))
