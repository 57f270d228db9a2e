"""Equity curves, trailing risk, breaks and performance figures.

A return series has one row per date; strategies, windows and scenarios are
keys (``by``), so any number of series is handled in one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import Roll, running, series, with_rolling, with_rolling_quantile
from ..session import materialise
from .xsection import cs_rank

STRATEGY = ("strategy",)
# fixed values: normal quantiles at 5% and 1%, and the density there over the share
Z95, Z99 = -1.6448536269514722, -2.3263478740408408
ES95, ES99 = 2.0627128075074257, 2.665214220345808


# W28
def equity_fixed(df: DataFrame, capital: float = 1e6, by=STRATEGY, ret: str = "portfolio_return") -> DataFrame:
    """Equity by compounding returns, with its peak and drawdown."""
    w = running(by)
    df = df.withColumn("equity", F.lit(capital) * F.product(1.0 + F.col(ret)).over(w))
    df = df.withColumn("peak", F.max("equity").over(w))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


# W29
def equity_compound(df: DataFrame, capital: float = 1e6, by=STRATEGY, pnl: str = "net_pnl") -> DataFrame:
    """Equity by adding P&L; the return is against the equity before."""
    w = running(by)
    df = df.withColumn("equity", F.lit(capital) + F.sum(pnl).over(w))
    prior = F.lag("equity", 1, capital).over(series(by))
    df = df.withColumns({"portfolio_return": F.when(prior > 0, F.col(pnl) / prior).otherwise(0.0), "peak": F.max("equity").over(w)})
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


# W30
def rolling_beta_sharpe(df: DataFrame, bench: str = "bench_return", width: int = 26, least: int = 13, by=STRATEGY) -> DataFrame:
    """Beta against a benchmark column and annualised Sharpe over the trailing weeks."""
    df = with_rolling(df, [Roll("__cov", "cov", "portfolio_return", width, least, other=bench), Roll("__var", "var", bench, width, least),
                           Roll("__m", "mean", "portfolio_return", width, least), Roll("__d", "std", "portfolio_return", width, least)], by)
    return df.withColumns({"rolling_beta": F.try_divide("__cov", "__var"), "rolling_sharpe": F.try_divide("__m", "__d") * math.sqrt(52.0)}).drop("__cov", "__var", "__m", "__d")


# W31
def rolling_var(df: DataFrame, width: int = 252, least: int = 126, share: float = 0.05, by=STRATEGY) -> DataFrame:
    """Trailing empirical and normal value at risk, the former also as known the row before, and its breaches."""
    r = F.col("portfolio_return")
    df = with_rolling(df, [Roll("__m", "mean", "portfolio_return", width, least), Roll("__d", "std", "portfolio_return", width, least)], by)
    df = with_rolling_quantile(df, "var_hist", "portfolio_return", share, width, least, by)
    df = df.withColumn("var_norm", F.col("__m") + Z95 * F.col("__d")).drop("__m", "__d")
    df = df.withColumn("var_known", F.lag("var_hist", 1).over(series(by)))
    return df.withColumn("breach", (r < F.col("var_known")).cast("int"))


# W37
def cusum_breaks(df: DataFrame, max_breaks: int = 3, min_size: int = 30, by=STRATEGY, alpha: str = "alpha") -> DataFrame:
    """Dates where the summed deviation from a segment's mean peaks, splitting breadth first.

    Each round scans all open segments of all series at once. A segment is
    split in two at its break, the break row itself belonging to neither; the
    first ``max_breaks`` in order of round and position are kept. The rows of each
    round are stored, since the round reads them twice and the next builds on them.
    """
    rows = df.select(*by, "date", F.coalesce(alpha, F.lit(0.0)).alias("__a"), F.lit(1).cast("bigint").alias("__seg"))
    seg = [*by, "__seg"]
    found = None
    for level in range(max_breaks):
        rows = materialise(rows, "cusum")
        whole = Window.partitionBy(*seg)
        up = Window.partitionBy(*seg).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        walked = rows.withColumns({"__m": F.avg("__a").over(whole), "__n": F.count("*").over(whole)}).where(F.col("__n") >= min_size)
        walked = walked.withColumn("__cs", F.abs(F.sum(F.col("__a") - F.col("__m")).over(up)))
        # the first date among equal peaks
        top = walked.groupBy(*seg).agg(F.max_by("date", F.struct(F.round("__cs", 12), -F.datediff("date", F.lit("1970-01-01")))).alias("break_date"),
                                       F.max("__cs").alias("score")).where("score > 1e-12")
        hits = top.select(*by, "__seg", "break_date", "score", F.lit(level).alias("level"))
        found = hits if found is None else found.unionByName(hits)
        if level + 1 < max_breaks:
            rows = rows.join(top.drop("score"), seg).where(F.col("date") != F.col("break_date"))
            rows = rows.withColumn("__seg", F.col("__seg") * 2 + (F.col("date") > F.col("break_date")).cast("bigint")).drop("break_date")
    w = Window.partitionBy(*by).orderBy("level", "__seg")
    kept = found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_breaks)
    return kept.select(*by, "break_date", "score", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "break_date")).alias("place"))


def _divide(a: Column, b: Column, least: float = 1e-12) -> Column:
    return F.when(F.abs(b) > least, a / b).otherwise(0.0)


# M09
def annual_factor(df: DataFrame, by=STRATEGY) -> DataFrame:
    """252 if the rows are on average at most 4 days apart, else 52; 52 for fewer than 3 rows."""
    gap = F.floor(F.datediff(F.max("date"), F.min("date"))) / F.count("*")
    return df.groupBy(*by).agg(F.when(F.count("*") < 3, 52).when(gap <= 4, 252).otherwise(52).alias("annual_factor"))


# M01-M08, M11, M12
def metrics(df: DataFrame, by=STRATEGY, ret: str = "portfolio_return", factor=52.0) -> DataFrame:
    """All performance and tail figures of a return series per key, in windows over one layout and one aggregate.

    ``factor`` is a number or "auto" for M09's rule.
    """
    curve = equity_fixed(df.where(F.col(ret).isNotNull()), 1.0, by, ret)
    r = F.col(ret)
    gap = F.datediff(F.max("date"), F.min("date")) / F.count("*")
    k = (F.when(F.count("*") < 3, 52.0).when(gap <= 4, 252.0).otherwise(52.0)) if factor == "auto" else F.lit(float(factor))
    # the quantiles go onto the rows, so that the tail means compare each return with a quantile of the same evaluation
    whole = Window.partitionBy(*by)
    curve = curve.withColumns({"var95": F.percentile(r, 0.05).over(whole), "var99": F.percentile(r, 0.01).over(whole)})
    out = curve.groupBy(*by).agg(
        F.max("var95").alias("var95"), F.max("var99").alias("var99"), F.count("*").alias("n"), k.alias("k"),
        F.avg(F.when(r <= F.col("var95"), r)).alias("cvar95"), F.avg(F.when(r <= F.col("var99"), r)).alias("cvar99"),
        F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"),
        F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)).alias("sd_down"),
        F.max_by("equity", "date").alias("final"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.min("drawdown").alias("max_dd"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("gains"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("losses"),
        F.when(F.count("*") > 2, F.skewness(r)).otherwise(0.0).alias("skew"),
        F.when(F.count("*") > 3, F.kurtosis(r)).otherwise(0.0).alias("kurt"))
    years = F.greatest(F.col("days") / 365.25, F.lit(1e-9))
    out = out.withColumns({
        "total_return": F.col("final") - 1.0,
        "cagr": F.pow("final", 1.0 / years) - 1.0,
        "cagr_periods": F.pow("final", F.lit(52.0) / F.col("n")) - 1.0,
        "ann_vol": F.col("sd") * F.sqrt("k"),
        "sharpe": _divide(F.col("mean") * F.sqrt("k"), F.col("sd")),
        "sortino": _divide(F.col("mean") * F.sqrt("k"), F.col("sd_down")),
        "win_loss": F.abs(_divide(F.col("avg_win"), F.col("avg_loss"))),
        "gain_pain": F.abs(_divide(F.col("gains"), F.col("losses"))),
        "p_var95": F.col("mean") + Z95 * F.col("sd"), "p_var99": F.col("mean") + Z99 * F.col("sd"),
        "p_cvar95": F.col("mean") - ES95 * F.col("sd"), "p_cvar99": F.col("mean") - ES99 * F.col("sd")})
    return out.withColumns({
        "calmar": _divide(F.col("cagr"), F.abs("max_dd")),
        "tail95": F.coalesce(F.try_divide(F.abs("var95"), F.abs("p_var95")), F.lit(1.0)),
        "tail99": F.coalesce(F.try_divide(F.abs("var99"), F.abs("p_var99")), F.lit(1.0))}).drop("gains", "losses", "days")


# M07
def breach_test(df: DataFrame, by=STRATEGY, width: int = 252, least: int = 126, share: float = 0.05) -> DataFrame:
    """Breaches of the trailing value at risk against their expected number."""
    b = rolling_var(df, width, least, share, by).where(F.col("var_known").isNotNull())
    out = b.groupBy(*by).agg(F.count("*").alias("days"), F.sum("breach").alias("breaches"))
    rate = F.col("breaches") / F.col("days")
    return out.withColumns({"expected": F.col("days") * share, "rate": rate,
                            "status": F.when(F.abs(rate - share) < 0.015, "PASS").otherwise("WARN")})


# W38
def split_metrics(df: DataFrame, break_date, by=STRATEGY) -> DataFrame:
    """Figures before a date and from it on."""
    when = break_date if isinstance(break_date, Column) else F.lit(break_date).cast("date")
    part = df.withColumn("part", F.when(F.col("date") < when, "pre").otherwise("post"))
    return metrics(part, (*by, "part"))


# W39
def rebase(df: DataFrame, capital: float = 1e6, by=STRATEGY, col: str = "close") -> DataFrame:
    return df.withColumn("value", F.col(col) * F.try_divide(F.lit(capital), F.first(col, ignorenulls=True).over(running(by))))


# M10
def benchmark_comparison(equity: DataFrame, bench: DataFrame, by=STRATEGY) -> DataFrame:
    """Total return, CAGR and deepest drawdown of a benchmark on each strategy's dates, and the excess.

    ``equity``: keys, date, equity. ``bench``: date, close; the last close at or before a date counts.
    """
    from .joins import asof
    w = running(by)
    df = asof(equity, bench, ["close"]).where(F.col("close").isNotNull())
    df = df.withColumn("__dd", F.col("close") / F.max("close").over(w) - 1.0)
    out = df.groupBy(*by).agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("__g"), F.min("__dd").alias("bench_dd"),
                              F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-9)).alias("__y"))
    own = equity.groupBy(*by).agg((F.max_by("equity", "date") - 1.0).alias("total_return"))
    return out.join(own, list(by)).select(*by, "total_return", (F.col("__g") - 1.0).alias("bench_total"),
                                          (F.pow("__g", 1.0 / F.col("__y")) - 1.0).alias("bench_cagr"), "bench_dd",
                                          (F.col("total_return") - F.col("__g") + 1.0).alias("excess_return"))


# M13
def prediction_metrics(df: DataFrame, y: str, p: str, by=("split",), ids=("date", "ticker")) -> DataFrame:
    """Rank correlation and mean squared error of predictions per key."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = cs_rank(rows.select(*by, *ids, y, p), {"__ry": (y, True), "__rp": (p, True)}, by, ids)
    return ranked.groupBy(*by).agg(F.corr("__ry", "__rp").alias("spearman"), F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"), F.count("*").alias("n"))


def accuracy(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
