import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalar as X
from panelwright.functions.rolling import Roll, min_periods, with_ewm, with_rolling, with_rolling_quantile, with_zscore
from panelwright.operators import timeseries as W


def value(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def gappy(seed, n=300, gaps=0.25, names=("A", "B")):
    """Random walks with missing values; the second series is constant for a while."""
    rng = np.random.default_rng(seed)
    out = []
    for k, name in enumerate(names):
        x = 100 + rng.normal(0, 1, n).cumsum()
        if k:
            x[100:180] = x[100]
        x = np.where(rng.random(n) < gaps, np.nan, x)
        out.append(pd.DataFrame({"ticker": name, "date": pd.date_range("2020-01-01", periods=n).date, "x": x}))
    return pd.concat(out)


def to_spark(spark, pdf, schema):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def by_series(df, col):
    pdf = df.select("ticker", "date", col).toPandas().sort_values(["ticker", "date"])
    return pdf[col].astype(float).to_numpy()


def expected(pdf, fn):
    return np.concatenate([fn(g["x"].reset_index(drop=True)).to_numpy(float) for _, g in pdf.groupby("ticker")])


def same(a, b, tol=1e-9):
    assert (np.isnan(a) == np.isnan(b)).all()
    ok = ~np.isnan(a)
    assert np.allclose(a[ok], b[ok], rtol=tol, atol=tol)


def test_limit_prices(spark):
    r = value(spark, a=X.limit_price(F.lit(100.0), F.lit("BUY"), 0.005), b=X.limit_price(F.lit(100.0), F.lit("SELL"), 0.005),
              c=X.limit_price(F.lit(100.0), F.lit("BUY"), 0.0016))
    assert (r.a, r.b, r.c) == (100.5, 99.5, 100.15)


def test_product_types(spark):
    r = value(spark, a=X.product_type(F.lit("MOMENTUM_CASH")), b=X.product_type(F.lit("MEAN_REV_DERIV")), c=X.product_type(F.lit("x")))
    assert (r.a, r.b, r.c) == ("DELIVERY", "CARRYFORWARD", "INTRADAY")


def test_names_hosts_hits(spark):
    r = value(spark, n=X.safe_name(F.lit("Nifty 50-X")), h=X.url_host(F.lit("https://User@News.Example.COM:8080/a?b")), none=X.url_host(F.lit("nothing")),
              hit=X.keyword_hit(F.lit("The U.S. economy"), {"u.s.", "zzz"}), miss=X.keyword_hit(F.lit("UxSx"), {"u.s."}), null=X.keyword_hit(F.lit(None).cast("string"), {"a"}))
    assert (r.n, r.h, r.none) == ("nifty_50_x", "user@news.example.com:8080", "")
    assert (r.hit, r.miss, r.null) == (True, False, False)


def test_clip_keeps_null_and_interpolate(spark):
    knots, values = (10.0, 16.0, 22.0, 30.0, 45.0), (0.6, 0.3, 0.0, -0.5, -1.0)
    xs = [5.0, 10.0, 13.0, 22.0, 26.0, 44.0, 60.0]
    r = value(spark, c=X.clip(F.lit(None).cast("double"), 0.0, 1.0), **{f"v{i}": X.interpolate(F.lit(x), knots, values) for i, x in enumerate(xs)})
    assert r.c is None
    assert np.allclose([r[f"v{i}"] for i in range(len(xs))], np.interp(xs, knots, values))


def test_softmax(spark):
    r = value(spark, **dict(zip("abc", X.softmax([F.lit(2.0), F.lit(1.0), F.lit(-700.0)], 0.5))))
    e = np.exp(np.array([4.0, 2.0, -1400.0]) - 4)
    assert np.allclose([r.a, r.b, r.c], e / e.sum())


@pytest.mark.parametrize("prefix_from", [1, 10_000])
@pytest.mark.parametrize("fn,pandas_fn", [("mean", "mean"), ("std", "std"), ("sum", "sum"), ("max", "max"), ("min", "min")])
def test_rolling_matches_pandas(spark, fn, pandas_fn, prefix_from):
    pdf = gappy(1)
    df = to_spark(spark, pdf, "ticker string, date date, x double")
    for width, least, skip in ((20, 10, 0), (60, 20, 1)):
        out = with_rolling(df, [Roll("y", fn, "x", width, least, skip)], prefix_from=prefix_from)
        want = expected(pdf, lambda s: getattr(s.shift(skip).rolling(width, min_periods=least), pandas_fn)())
        got = by_series(out, "y")
        if fn == "std":  # constant windows: exactly 0 here
            want = np.where(np.abs(want) < 1e-7, 0.0, want)
        same(got, want, 1e-8)


def test_several_widths_share_blocks(spark):
    pdf = gappy(6, n=400, gaps=0.2)
    df = to_spark(spark, pdf, "ticker string, date date, x double")
    widths = {10: 4, 13: 1, 20: 10, 39: 3, 49: 20, 61: 20, 250: 5}
    rolls = [Roll(f"{fn}{w}", fn, "x", w, m, w % 3) for w, m in widths.items() for fn in ("mean", "std", "max", "count")]
    a, b = (with_rolling(df, rolls, prefix_from=limit) for limit in (1, 10_000))
    for r in rolls:
        same(by_series(a, r.out), by_series(b, r.out), 1e-9)


@pytest.mark.parametrize("width,least,skip", [(60, 30, 0), (25, 2, 1), (252, 126, 0)])
def test_co_moments_match_pandas_and_frames(spark, width, least, skip):
    pdf = gappy(7, n=900, gaps=0.2)
    rng = np.random.default_rng(9)
    pdf["y"] = np.where(rng.random(len(pdf)) < 0.1, np.nan, 1e3 + rng.normal(size=len(pdf)) + 0.3 * pdf["x"].fillna(0))
    df = to_spark(spark, pdf, "ticker string, date date, x double, y double")
    roll = [Roll("c", "cov", "y", width, least, skip, "x")]
    a, b = (by_series(with_rolling(df, roll, prefix_from=limit), "c") for limit in (1, 10_000))
    same(a, b, 1e-9)
    want = np.concatenate([g["y"].shift(skip).rolling(width, min_periods=max(least, 2)).cov(g["x"].shift(skip)).to_numpy() for _, g in pdf.sort_values(["ticker", "date"]).groupby("ticker")])
    same(a, want, 1e-6)


def test_co_moments_of_a_long_series(spark):
    n = 250_000
    df = spark.range(n).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), (F.sin("id") + F.when(F.col("id") == 0, 1e9).otherwise(1e4)).alias("x"), (F.cos(F.col("id") * 0.7) - 1e4).alias("y"))
    rolls = [Roll("c", "cov", "y", 60, 30, other="x"), Roll("d", "cov", "y", 252, 126, other="x")]
    a, b = (with_rolling(df, rolls, prefix_from=limit).where(f"date > {300}").alias(name) for limit, name in ((1, "a"), (n, "b")))
    row = a.join(b, F.col("a.date") == F.col("b.date")).agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in "cd"]).first()
    assert max(row) < 1e-9


@pytest.mark.parametrize("width,least,share", [(252, 126, 0.05), (30, 10, 0.5), (7, 1, 0.0), (64, 20, 1.0), (33, 33, 0.37)])
def test_rolling_quantile_matches_pandas(spark, width, least, share):
    pdf = gappy(8, n=600, gaps=0.15)
    pdf.loc[pdf.index % 7 == 0, "x"] = 0.25  # ties
    df = to_spark(spark, pdf, "ticker string, date date, x double")
    out = with_rolling_quantile(df, "q", "x", share, width, least)
    assert out.columns == ["ticker", "date", "x", "q"] and out.count() == len(pdf)
    same(by_series(out, "q"), expected(pdf, lambda s: s.rolling(width, min_periods=least).quantile(share)), 1e-9)


def test_zscore_null_on_constant_window(spark):
    pdf = gappy(2)
    df = to_spark(spark, pdf, "ticker string, date date, x double")
    for prefix_from in (1, 10_000):
        z = by_series(with_zscore(df, {"z": "x"}, 30, 10, prefix_from=prefix_from), "z")
        want = expected(pdf, lambda s: (s - s.rolling(30, min_periods=10).mean()) / s.rolling(30, min_periods=10).std().where(lambda d: d > 1e-7))
        same(z, want, 1e-7)


@pytest.mark.parametrize("alpha,least,block", [(1 / 14, 14, None), (0.03, 20, None), (0.35, 1, 17), (0.5, 5, 40)])
def test_ewm_with_gaps_matches_pandas(spark, alpha, least, block):
    pdf = gappy(3, gaps=0.4)
    df = to_spark(spark, pdf, "ticker string, date date, x double")
    got = by_series(with_ewm(df, {"y": "x"}, alpha, least, block=block), "y")
    want = expected(pdf, lambda s: s.ewm(alpha=alpha, min_periods=least, adjust=False).mean())
    same(got, want, 1e-10)


def test_default_min_periods():
    assert (min_periods(20), min_periods(60), min_periods(252)) == (10, 20, 84)


def test_pct_fill_modes(spark):
    df = to_spark(spark, pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=4).date, "x": [10.0, np.nan, 12.0, 0.0]}), "ticker string, date date, x double")
    assert [r.x_pct1 for r in W.pct(df, "x", 1).orderBy("date").collect()] == [None, None, None, -1.0]
    padded = [r.x_pct1 for r in W.pct(df, "x", 1, fill="pad").orderBy("date").collect()]
    assert padded[1] == 0.0 and math.isclose(padded[2], 0.2)


def test_features_do_not_look_ahead(spark):
    """Features of a shortened history equal those of the full one."""
    pdf = gappy(5, n=200, gaps=0.1).rename(columns={"x": "close"})
    pdf["volume"], pdf["open"] = 100.0, pdf["close"]
    full = to_spark(spark, pdf[["ticker", "date", "close", "open", "volume"]], "ticker string, date date, close double, open double, volume double")

    def features(df):
        df = W.structure(W.above_sma(W.adv_rvol(df), 40, 20))
        df = W.fip(W.rsi_wilder(df), width=30)
        return W.trailing_max_dd(W.efficiency(df, {"e": (20, 10, "clipped")}), 50, 25)

    cut = features(full.where("date < '2020-05-01'"))
    whole = features(full).where("date < '2020-05-01'")
    cols = sorted(c for c in cut.columns)
    a, b = (d.select(*cols).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True) for d in (cut, whole))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_flat_runs_and_weeks(spark):
    rows = [("A", f"2024-01-{d:02d}", 5.0 if d < 8 else 6.0, 0.0 if d == 4 else 1.0) for d in range(1, 12)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double, volume double").withColumn("date", F.to_date("date"))
    assert [r.flat_run for r in W.flat_runs(df).orderBy("date").collect()] == [0, 1, 2, 0, 1, 2, 3, 0, 1, 2, 3]
    r = value(spark, sat=W.week_end(F.to_date(F.lit("2024-01-06"))), fri=W.week_end(F.to_date(F.lit("2024-01-05"))), mon=W.week_end(F.to_date(F.lit("2024-01-08"))))
    assert (str(r.sat), str(r.fri), str(r.mon)) == ("2024-01-12", "2024-01-05", "2024-01-12")


def test_holiday_friday_moves_to_the_last_day(spark):
    from panelwright.operators.joins import calendar
    days = ["2024-01-01", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-11", "2024-01-15"]
    cal = calendar(spark.createDataFrame([(d,) for d in days], "date string").withColumn("date", F.to_date("date")))
    assert [str(r.date) for r in W.rebalance_dates(cal).orderBy("date").collect()] == ["2024-01-05", "2024-01-11", "2024-01-15"]
    assert [str(r.date) for r in W.rebalance_dates(cal, "friday").orderBy("date").collect()] == ["2024-01-05"]


def test_wide_windows_do_not_depend_on_the_length_of_a_series(spark):
    n = 250_000
    x = F.when(F.col("date") == 0, 100.0).when(F.col("date") % 2 == 0, 1100.0).otherwise(1100.01)
    df = spark.range(n).select(F.lit("a").alias("ticker"), F.col("id").alias("date")).withColumn("x", x)
    rolls = [Roll("d", "std", "x", 100, 2), Roll("m", "mean", "x", 100, 2), Roll("v", "var", "x", 252, 126, 3)]
    a = with_rolling(df, rolls).alias("a")
    b = with_rolling(df, rolls, prefix_from=n).alias("b")
    gap = [F.max(F.abs(F.col(f"a.{r.out}") / F.col(f"b.{r.out}") - 1)).alias(r.out) for r in rolls]
    seen = [F.count_if(F.col(f"a.{r.out}").isNull() != F.col(f"b.{r.out}").isNull()).alias(f"n_{r.out}") for r in rolls]
    row = a.join(b, F.col("a.date") == F.col("b.date")).agg(*gap, *seen).first()
    assert max(row[r.out] for r in rolls) < 1e-9 and not any(row[f"n_{r.out}"] for r in rolls)


def test_wide_window_of_one_value_has_no_deviation(spark):
    df = spark.range(700).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), F.lit(0.1).alias("x"))
    out = with_rolling(df, [Roll("d", "std", "x", 100, 2)]).agg(F.max("d").alias("d"), F.count("d").alias("n")).first()
    assert (out["d"], out["n"]) == (0.0, 699)
