"""Features of one series (``by``) over its dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import Roll, gated, running, series, trailing, with_ewm, with_rolling, with_zscore
from ..functions.scalar import clip

TICKER = ("ticker",)
#: Co-moments re-read several columns: they take the block form from this width on.
COV_FROM = 50
YEAR = math.sqrt(252.0)


# W01
def pct(df: DataFrame, col: str, k: int, out: str | None = None, by=TICKER, fill: str = "none") -> DataFrame:
    """Return over ``k`` rows; ``fill='pad'`` carries the last value over gaps first."""
    w = series(by)
    x = F.col(col)
    if fill == "pad":
        df = df.withColumn("__x", F.last(col, ignorenulls=True).over(running(by)))
        x = F.col("__x")
    out_col = F.try_divide(x, F.lag(x, k).over(w)) - 1.0
    return df.withColumn(out or f"{col}_pct{k}", out_col).drop("__x")


def pcts(df: DataFrame, wanted: dict, by=TICKER) -> DataFrame:
    """Several returns in one pass; ``wanted``: output -> (column, rows)."""
    w = series(by)
    return df.withColumns({o: F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1.0 for o, (c, k) in wanted.items()})


# W02
def sma(df: DataFrame, col: str, widths: dict, by=TICKER, prefix_from=None) -> DataFrame:
    """``widths``: width -> least values; adds ``sma<width>``."""
    return with_rolling(df, [Roll(f"sma{w}", "mean", col, w, m) for w, m in widths.items()], by, prefix_from=prefix_from)


# W03
def vol(df: DataFrame, ret: str, widths: dict, by=TICKER, prefix_from=None) -> DataFrame:
    """Annualised deviation of daily returns; adds ``vol<width>``."""
    df = with_rolling(df, [Roll(f"vol{w}", "std", ret, w, m) for w, m in widths.items()], by, prefix_from=prefix_from)
    return df.withColumns({f"vol{w}": F.col(f"vol{w}") * YEAR for w in widths})


# W04
zscore = with_zscore


# W05
def adv_rvol(df: DataFrame, width: int = 20, least: int = 10, by=TICKER) -> DataFrame:
    df = with_rolling(df, [Roll(f"adv{width}", "mean", "volume", width, least)], by)
    return df.withColumn(f"rvol{width}", F.col("volume") / (F.col(f"adv{width}") + 1e-9))


# W06
def above_sma(df: DataFrame, width: int = 200, least: int = 100, by=TICKER, out: str = "above200", prefix_from=None) -> DataFrame:
    """1 above the average, else 0; a missing side counts as 0."""
    df = with_rolling(df, [Roll("__sma", "mean", "close", width, least)], by, prefix_from=prefix_from)
    return df.withColumn(out, F.coalesce(F.col("close") > F.col("__sma"), F.lit(False)).cast("double")).drop("__sma")


# W07
def structure_tag(z: Column) -> Column:
    return F.when(z.isNull(), "UNKNOWN").when(F.abs(z) >= 1.0, "VACUUM").otherwise("TRAPPED")


def structure(df: DataFrame, width: int = 60, by=TICKER, prefix_from=None) -> DataFrame:
    """Close against the mean and deviation of the rows before it."""
    m = max(20, width // 3)
    df = with_rolling(df, [Roll("__m", "mean", "close", width, m, 1), Roll("__d", "std", "close", width, m, 1)], by,
                      prefix_from=prefix_from)
    z = F.try_divide(F.col("close") - F.col("__m"), F.col("__d"))
    return df.withColumn("structure", structure_tag(z)).drop("__m", "__d")


# W08
def beta(df: DataFrame, y: str, x: str, width: int = 60, least: int = 30, by=TICKER, out: str = "beta", prefix_from: int | None = COV_FROM) -> DataFrame:
    """Covariance over rows with both values, variance of ``x`` over all its rows."""
    df = with_rolling(df, [Roll("__cov", "cov", y, width, least, other=x), Roll("__var", "var", x, width, least)], by, prefix_from=prefix_from)
    return df.withColumn(out, F.try_divide("__cov", "__var")).drop("__cov", "__var")


# W09
ewm = with_ewm


def with_diff(df: DataFrame, col: str = "close", by=TICKER) -> DataFrame:
    """Adds ``__up`` and ``__down``, the two sides of the one-row difference."""
    df = df.withColumn("__d", F.col(col) - F.lag(col, 1).over(series(by)))
    return df.withColumns({"__up": clip("__d", low=0.0), "__down": -clip("__d", high=0.0)}).drop("__d")


# W10
def rsi_wilder(df: DataFrame, n: int = 14, by=TICKER, out: str = "rsi14") -> DataFrame:
    df = with_ewm(with_diff(df, "close", by), {"__gain": "__up", "__loss": "__down"}, 1.0 / n, n, by)
    rs = F.col("__gain") / (F.col("__loss") + 1e-9)
    return df.withColumn(out, 100.0 - 100.0 / (1.0 + rs)).drop("__up", "__down", "__gain", "__loss")


# W11
def rsi_simple(df: DataFrame, n: int = 14, by=TICKER, out: str = "rsi14_market") -> DataFrame:
    df = with_rolling(with_diff(df, "close", by), [Roll("__gain", "mean", "__up", n, n), Roll("__loss", "mean", "__down", n, n)], by)
    rs = F.try_divide(F.col("__gain"), F.col("__loss"))
    return df.withColumn(out, 100.0 - 100.0 / (1.0 + rs)).drop("__up", "__down", "__gain", "__loss")


# W12
def fip(df: DataFrame, lam: float = 0.97, width: int = 60, by=TICKER, full_sample_vol: bool = False, prefix_from=None) -> DataFrame:
    """Continuity of moves x return over the window / deviation; 0 where not known.

    ``full_sample_vol`` fills the early deviation with that of the whole series,
    which looks ahead and is off by default.
    """
    m = max(20, width // 3)
    w = series(by)
    df = df.withColumns({"__ret": F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1.0,
                         "__trend": F.coalesce(F.try_divide(F.col("close"), F.lag("close", width).over(w)) - 1.0, F.lit(0.0))})
    df = df.withColumns({"__pos": clip("__ret", low=0.0), "__neg": -clip("__ret", high=0.0)})
    df = with_rolling(df, [Roll("__vol", "std", "__ret", width, m)], by, prefix_from=prefix_from)
    if full_sample_vol:
        df = df.withColumn("__vol", F.coalesce("__vol", F.stddev_samp("__ret").over(Window.partitionBy(*by))))
    df = with_ewm(df, {"__u": "__pos", "__w": "__neg"}, 1.0 - lam, m, by)
    up, down = F.col("__u"), F.col("__w")
    raw = (up - down) / (up + down + 1e-9) * F.col("__trend") / (F.col("__vol") + 1e-6)
    return df.withColumn("fip", F.coalesce(raw, F.lit(0.0))).drop("__ret", "__trend", "__pos", "__neg", "__vol", "__u", "__w")


# W13
def efficiency(df: DataFrame, specs: dict, by=TICKER, prefix_from=None) -> DataFrame:
    """Net move over summed moves. ``specs``: output -> (width, least, variant).

    ``clipped`` adds 1e-9 below and bounds to 0..1, ``open`` adds 1e-9 only,
    ``strict`` has NULL where the moves sum to 0.
    """
    w = series(by)
    df = df.withColumn("__ad", F.abs(F.col("close") - F.lag("close", 1).over(w)))
    df = with_rolling(df, [Roll(f"__s_{o}", "sum", "__ad", n, m) for o, (n, m, _) in specs.items()], by, prefix_from=prefix_from)
    out = {}
    for o, (n, _, variant) in specs.items():
        net = F.abs(F.col("close") - F.lag("close", n).over(w))
        noise = F.col(f"__s_{o}")
        if variant == "strict":
            out[o] = F.try_divide(net, noise)
        else:
            ratio = net / (noise + 1e-9)
            out[o] = clip(ratio, 0.0, 1.0) if variant == "clipped" else ratio
    return df.withColumns(out).drop("__ad", *[f"__s_{o}" for o in specs])


# W14
def slope(df: DataFrame, width: int = 100, by=TICKER, out: str = "slope100") -> DataFrame:
    x = F.log(F.when(F.col("close") != 0, F.col("close")))
    return df.withColumn(out, (x - F.lag(x, width).over(series(by))) / float(width))


# W15
def trailing_max_dd(df: DataFrame, width: int = 252, least: int = 126, by=TICKER, out: str = "max_dd", prefix_from=None) -> DataFrame:
    """Deepest of the trailing drawdowns, each from the trailing peak; both extremes by blocks."""
    df = with_rolling(df, [Roll("__peak", "max", "close", width, 1)], by, prefix_from=prefix_from)
    df = df.withColumn("__dd", (F.col("close") - F.col("__peak")) / (F.col("__peak") + 1e-9))
    return with_rolling(df, [Roll(out, "min", "__dd", width, least)], by, prefix_from=prefix_from).drop("__dd", "__peak")


# W16
def trend_r2(df: DataFrame, width: int = 252, least: int = 126, by=TICKER, idx: str = "idx", out: str = "r2", prefix_from=None) -> DataFrame:
    """Squared population covariance of row position and log price over the product of sample variances.

    The position counts on every row, the price only where known, as three
    separate averages. The first price is taken off, which changes nothing; the mean and the variance of
    ``n`` successive positions have a closed form.
    """
    at = series(by)
    df = df.withColumns({"__y": F.log(F.col("close") + 1e-9), "__x": F.col(idx).cast("double"), "__n": F.least(F.row_number().over(at), F.lit(width)).cast("double")})
    df = df.withColumns({"__y0": F.first("__y", ignorenulls=True).over(running(by)), "__x0": F.first("__x").over(running(by))})
    df = df.withColumns({"__xc": F.col("__x") - F.col("__x0"), "__yc": F.col("__y") - F.col("__y0")})
    df = df.withColumns({"__xy": F.col("__xc") * F.col("__yc"), "__xn": F.when(F.col("__y").isNotNull(), F.col("__xc"))})
    df = with_rolling(df, [
        Roll("__my", "mean", "__yc", width, least), Roll("__vy", "var", "__yc", width, least),
        Roll("__mxy", "mean", "__xy", width, least), Roll("__mxn", "mean", "__xn", width, least)], by, prefix_from=prefix_from)
    df = df.withColumns({"__mx": gated(F.col("__xc") - (F.col("__n") - 1) / 2, F.col("__n"), least), "__vx": F.col("__n") * (F.col("__n") + 1) / 12})
    # mean(x*y) - mean(x)*mean(y) with y = yc + y0
    cov = F.col("__mxy") - F.col("__mx") * F.col("__my") + F.col("__y0") * (F.col("__mxn") - F.col("__mx"))
    df = df.withColumn(out, cov * cov / (F.col("__vx") * F.col("__vy") + 1e-9))
    return df.drop("__y", "__x", "__n", "__y0", "__x0", "__xc", "__yc", "__xy", "__xn", "__mx", "__vx", "__my", "__vy", "__mxy", "__mxn")


# W17
def vol_comp(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_comp", F.col("vol20") / (F.col("vol100") + 1e-9))


# W18
def excess(df: DataFrame, k: int = 20, out: str = "excess20") -> DataFrame:
    """Return over ``k`` rows less the market's (``broad_mom<k>`` by J03)."""
    return df.withColumn(out, F.col(f"mom{k}") - F.col(f"broad_mom{k}"))


# W21
def dist_sma(df: DataFrame, widths=(50, 100, 200), by=TICKER, prefix_from=None) -> DataFrame:
    df = sma(df, "close", {w: w // 2 for w in widths}, by, prefix_from)
    return df.withColumns({f"dist_sma{w}": F.try_divide(F.col("close") - F.col(f"sma{w}"), F.col(f"sma{w}")) for w in widths}
                          ).drop(*[f"sma{w}" for w in widths])


# W22
def vol_ratio_sharpe(df: DataFrame, by=TICKER) -> DataFrame:
    """vol20, vol60, their ratio, and mean return over deviation for both widths."""
    df = vol(df, "ret", {20: 10, 60: 30}, by)
    df = with_rolling(df, [Roll("__m20", "mean", "ret", 20, 10), Roll("__m60", "mean", "ret", 60, 30)], by)
    return df.withColumns({
        "vol_ratio": F.try_divide(F.col("vol20"), F.col("vol60")),
        "sharpe_20": F.try_divide(F.col("__m20") * 252, F.col("vol20")),
        "sharpe_60": F.try_divide(F.col("__m60") * 252, F.col("vol60")),
    }).drop("__m20", "__m60")


# W23
def diff(df: DataFrame, col: str, k: int, out: str, by=TICKER) -> DataFrame:
    return df.withColumn(out, F.col(col) - F.lag(col, k).over(series(by)))


# W24
def vix_features(df: DataFrame, by=("role",)) -> DataFrame:
    df = with_rolling(df, [Roll("vix_sma20", "mean", "close", 20, 10)], by)
    return with_zscore(df, {"vix_z": "close"}, 60, 30, by)


# W25
def macro_mom(market: DataFrame, k: int = 20, roles=("broad", "risk", "usd", "us10y", "gold")) -> DataFrame:
    """One row per date: the risk role's return over the market's, and each macro role's own."""
    m = pct(market, "close", k, "__m", ("role",))
    wide = m.groupBy("date").pivot("role", list(roles)).agg(F.first("__m"))
    return wide.select("date", (F.col("risk") - F.col("broad")).alias("risk_rel_strength"),
                       *[F.col(r).alias(f"{r}_mom{k}") for r in roles if r not in ("broad", "risk")])


# W26
def drawdown(df: DataFrame, col: str, by=TICKER, out: str = "drawdown") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(col), F.max(col).over(running(by))) - 1.0)


# W27
def forward_label(df: DataFrame, k: int = 5, threshold: float = 0.0075, by=TICKER) -> DataFrame:
    """Return over the next ``k`` rows and its class; an unknown return is CHOP."""
    df = df.withColumn("fwd_ret_5", F.try_divide(F.lead("close", k).over(series(by)), F.col("close")) - 1.0)
    r = F.col("fwd_ret_5")
    return df.withColumn("regime_label", F.when(r > threshold, "BULL").when(r < -threshold, "BEAR").otherwise("CHOP"))


# W32
def smooth(df: DataFrame, wanted: dict, by=TICKER) -> DataFrame:
    """Short trailing means from the first row on; ``wanted``: output -> (column, width)."""
    return with_rolling(df, [Roll(o, "mean", c, w, 1) for o, (c, w) in wanted.items()], by)


# W33
def flat_runs(df: DataFrame, by=TICKER) -> DataFrame:
    """Number of rows in a row, up to this one, with an unchanged close and volume above 0."""
    w = series(by)
    same = F.coalesce((F.col("close") == F.lag("close", 1).over(w)) & (F.col("volume") > 0), F.lit(False))
    df = df.withColumn("__same", same.cast("int"))
    df = df.withColumn("__island", F.sum(1 - F.col("__same")).over(running(by)))
    run = F.sum("__same").over(Window.partitionBy(*by, "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("flat_run", run).drop("__same", "__island")


# W34
def flips(df: DataFrame, state: str, by=TICKER, out: str = "changed") -> DataFrame:
    """1 where the state differs from the row before; the first row counts as a change."""
    return df.withColumn(out, (~F.col(state).eqNullSafe(F.lag(state, 1).over(series(by)))).cast("int"))


# W35
def ffill(df: DataFrame, cols, by=TICKER) -> DataFrame:
    return df.withColumns({c: F.last(c, ignorenulls=True).over(running(by)) for c in cols})


def bfill(df: DataFrame, cols, by=TICKER) -> DataFrame:
    """Carries the next value back; it looks ahead, so features never use it by default."""
    w = series(by).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})


# W36
def week_end(date) -> Column:
    """Friday on or after a date: the name of its Saturday-to-Friday week."""
    return F.next_day(F.date_sub(F.col(date) if isinstance(date, str) else date, 1), "FRI")


def rebalance_dates(cal: DataFrame, mode: str = "last_day") -> DataFrame:
    """Last trading day of each week, or the trading Fridays; with the one after it."""
    if mode == "friday":
        days = cal.where(F.dayofweek("date") == 6).select("date", "idx")
    else:
        days = cal.groupBy(week_end("date").alias("week")).agg(F.max("date").alias("date"), F.max("idx").alias("idx")).drop("week")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return days.withColumns({"next_date": F.lead("date").over(w), "next_idx": F.lead("idx").over(w)})
