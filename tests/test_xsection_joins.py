import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import filters as S, joins as J, xsection as C
from panelwright.operators.ingest import dedupe_last, lookup_token, lot_sizes, normalise_ohlcv, upsert
from panelwright.plans import tables as T
from tests.test_functions import to_spark


def universe(seed=0, dates=3, names=40):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        for k in range(names):
            v = float(rng.integers(0, 12)) if rng.random() > 0.1 else np.nan
            rows.append((dt.date(2024, 1, d + 1), f"T{k:02d}", v, float(rng.normal())))
    # one date where most names share one value
    rows += [(dt.date(2024, 2, 1), f"T{k:02d}", 0.35 if k < 30 else float(k), 1.0) for k in range(names)]
    return pd.DataFrame(rows, columns=["date", "ticker", "v", "w"])


@pytest.mark.parametrize("split_rows", [3, 100_000])
def test_ranks_match_pandas(spark, split_rows):
    pdf = universe()
    df = to_spark(spark, pdf, "date date, ticker string, v double, w double")
    got = C.cs_rank(df, {"up": ("v", True), "down": ("v", False), "rw": ("w", True)}, split_rows=split_rows).toPandas().sort_values(["date", "ticker"])
    g = pdf.sort_values(["date", "ticker"]).groupby("date")
    for out, col, asc in (("up", "v", True), ("down", "v", False), ("rw", "w", True)):
        want = g[col].rank(pct=True, method="average", ascending=asc).to_numpy()
        a = got[out].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(want)).all() and np.allclose(a[~np.isnan(a)], want[~np.isnan(want)])


def test_one_large_date_is_split_exactly(spark):
    """A third of the names share one value; many ranges and tasks give the counts of one."""
    rows = spark.range(60_000).repartition(13).select(
        F.lit("2024-01-05").cast("date").alias("date"), F.concat(F.lit("T"), F.col("id")).alias("ticker"),
        F.when(F.col("id") % 3 == 0, 0.35).otherwise(F.xxhash64("id") / 1e18).alias("v"))
    got = C.cs_rank(rows, {"r": ("v", True)}, split_rows=500).toPandas()
    assert np.allclose(got["r"].astype(float), got["v"].rank(pct=True, method="average"))
    q = C.quantiles(rows, "v", {"a": 0.5, "b": 0.9}, split_rows=500).first()
    assert np.allclose([q.a, q.b], got["v"].quantile([0.5, 0.9]))


@pytest.mark.parametrize("split_rows", [2, 100_000])
def test_quantiles_match_numpy(spark, split_rows):
    pdf = universe(4)
    df = to_spark(spark, pdf, "date date, ticker string, v double, w double")
    got = C.quantiles(df, "v", {"m": 0.5, "q8": 0.8, "top": 1.0}, split_rows=split_rows).toPandas().set_index("date")
    for d, g in pdf.groupby("date"):
        want = g["v"].quantile([0.5, 0.8, 1.0]).to_numpy()
        assert np.allclose(got.loc[d, ["m", "q8", "top"]].astype(float), want)


def test_top_k_ties_and_limit_before_shuffle(spark):
    df = spark.createDataFrame([("2024-01-01", t, s) for t, s in (("c", 1.0), ("a", 1.0), ("b", 2.0), ("d", None))], "date string, ticker string, s double")
    top = C.top_k(df, "s", 2, rank="place")
    assert [(r.ticker, r.place) for r in top.orderBy("place").collect()] == [("b", 1), ("a", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") or plan.count("WindowGroupLimit") == 2


def test_align_fills_the_calendar(spark):
    rows = [("A", "2024-01-02", 1.0), ("A", "2024-01-05", 2.0), ("A", "2024-01-06", 9.0), ("B", "2024-01-01", None), ("B", "2024-01-05", 3.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double").withColumn("date", F.to_date("date"))
    cal = J.calendar(spark.createDataFrame([(f"2024-01-0{d}",) for d in (1, 2, 4, 5)], "date string").withColumn("date", F.to_date("date")))
    got = J.align(df, cal).orderBy("ticker", "date").collect()
    assert [(r.ticker, r.date.day, r.idx, r.close) for r in got] == [
        ("A", 1, 0, None), ("A", 2, 1, 1.0), ("A", 4, 2, None), ("A", 5, 3, 2.0), ("B", 1, 0, None), ("B", 2, 1, None), ("B", 4, 2, None), ("B", 5, 3, 3.0)]


def test_asof_many_rows_per_date(spark):
    left = spark.createDataFrame([("2024-01-0%d" % d, k) for d in (1, 3, 3, 5) for k in (1, 2)], "date string, k int").withColumn("date", F.to_date("date"))
    right = spark.createDataFrame([("2024-01-02", 7.0), ("2024-01-04", None), ("2024-01-05", 8.0)], "date string, v double").withColumn("date", F.to_date("date"))
    got = J.asof(left, right, ["v"]).orderBy("date", "k").collect()
    assert [r.v for r in got] == [None, None, 7.0, 7.0, 7.0, 7.0, 8.0, 8.0]


def test_intervals_last_open(spark):
    trace = spark.createDataFrame([("2024-01-02", "BULL"), ("2024-01-04", "BEAR")], "date string, regime string").withColumn("date", F.to_date("date"))
    days = spark.createDataFrame([(f"2024-01-0{d}",) for d in range(1, 7)], "date string").withColumn("date", F.to_date("date"))
    got = J.in_interval(days, J.intervals(trace)).orderBy("date").collect()
    assert [(r.date.day, r.regime) for r in got] == [(2, "BULL"), (3, "BULL"), (4, "BEAR"), (5, "BEAR"), (6, "BEAR")]


def test_split_windows_open_ends(spark):
    df = spark.createDataFrame([("2023-05-01",), ("2025-10-02",)], "date string").withColumn("date", F.to_date("date"))
    out = S.split_windows(df, [("val", "2023-01-01", "2025-09-30"), ("full", "2023-01-01", None)]).collect()
    assert sorted((str(r.date), r.window) for r in out) == [("2023-05-01", "full"), ("2023-05-01", "val"), ("2025-10-02", "full")]


def test_cutoff_zone(spark):
    df = spark.createDataFrame([("2024-01-15 03:30:00",), ("2024-01-15 03:30:01",)], "t string").select(F.col("t").cast("timestamp").alias("published_at"))
    assert S.as_of_cutoff(df, "2024-01-15 09:00:00").count() == 1


def test_normalise_columns(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, float("nan"))], "Date string, Close double, volume double")
    r = normalise_ohlcv(df).first()
    assert (r.open, r.close, r.volume, r.high) == (1.0, 1.0, None, None)
    with pytest.raises(ValueError):
        normalise_ohlcv(spark.createDataFrame([("2024-01-01", 1.0)], "Date string, `Adj Close` double"))
    assert normalise_ohlcv(spark.createDataFrame([("2024-01-01", 1.0)], "Date string, `Adj Close` double"), downloaded=True).first().close == 1.0
    with pytest.raises(ValueError):
        normalise_ohlcv(spark.createDataFrame([(1.0,)], "Close double"))


def test_upsert_keeps_schema_and_newest(spark):
    base = spark.createDataFrame([("A", "d1", 1.0), ("A", "d2", 2.0)], "ticker string, date string, close double")
    delta = spark.createDataFrame([(9, "d2", "A", "x"), (5, "d3", "A", "x")], "close int, date string, ticker string, extra string")
    out = upsert(base, delta)
    assert out.schema == base.schema
    assert sorted(map(tuple, out.collect())) == [("A", "d1", 1.0), ("A", "d2", 9.0), ("A", "d3", 5.0)]
    assert dedupe_last(base, ["ticker"], ["date"]).first().close == 2.0


def test_token_lookup(spark):
    master = spark.createDataFrame([("2885", "RELIANCE-EQ", "NSE", 0), ("12345", "SILVERMIC26APR24", "MCX", 1), ("9999", "NIFTY26APR24FUT", "NFO", 2), ("1", "RELIANCE-EQ", "NSE", 3)],
                                   "token string, symbol string, exch_seg string, pos int")
    orders = spark.createDataFrame([("RELIANCE-EQ", "NSE"), (" silvermic26apr24 ", "mcx"), ("INVALID", "NSE")], "symbol string, exchange string")
    got = {r.symbol.strip(): r.token for r in lookup_token(orders, master).collect()}
    assert got == {"RELIANCE-EQ": "2885", "silvermic26apr24": "12345", "INVALID": None}


def test_lot_sizes_skip_bad_numbers(spark):
    rows = [("abc ", "NFO", "FUTSTK", "50"), ("ABC", "NFO", "FUTSTK", "75"), ("abc", "NFO", "FUTSTK", "x"), ("q", "NSE", "FUTSTK", "5")]
    out = lot_sizes(spark.createDataFrame(rows, "name string, exch_seg string, instrumenttype string, lotsize string")).collect()
    assert [(r.name, r.lot_size) for r in out] == [("ABC", 75)]


@pytest.mark.parametrize("by", [["user"], []])
def test_asof_over_time_stamps_carries_across_buckets(spark, by):
    rng = np.random.default_rng(4)
    start = pd.Timestamp("2024-01-01")
    at = lambda n: [start + pd.Timedelta(seconds=int(s)) for s in np.unique(rng.integers(0, 40 * 86400, n))]
    left = pd.DataFrame([(u, t) for u in "ab" for t in (at(60) if by else [])] or [("a", t) for t in at(90)], columns=["user", "ts"])
    left = pd.concat([left, pd.DataFrame([("a", start + pd.Timedelta(days=5)), ("a", start - pd.Timedelta(days=1)), ("a", start + pd.Timedelta(days=400))], columns=["user", "ts"])]).drop_duplicates()
    right = pd.DataFrame([(u, t, float(rng.normal())) for u in ("ab" if by else "a") for t in at(12)] + [("a", start + pd.Timedelta(days=5), 77.0)], columns=["user", "ts", "v"])
    right = right.drop_duplicates(["user", "ts"] if by else ["ts"], keep="last")
    right = pd.concat([right, right.assign(ts=right["ts"] + pd.Timedelta(seconds=1), v=np.nan)])  # gaps carry nothing
    to = lambda df, schema: spark.createDataFrame([tuple(None if x != x else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in df.itertuples(index=False)], schema).repartition(3)
    got = J.asof(to(left, "user string, ts timestamp"), to(right[["user", "ts", "v"]], "user string, ts timestamp, v double").drop(*([] if by else ["user"])), ["v"], by, "ts")
    assert got.count() == len(left)
    known = right.dropna()
    for r in got.collect():
        before = known[(known["ts"] <= r.ts) & ((known["user"] == r.user) if by else True)].sort_values("ts")
        assert r.v == (before["v"].iloc[-1] if len(before) else None)


def test_newest_row_is_the_same_in_every_run(spark):
    from panelwright.operators.news import keep_last
    rows = [("k", 1, i % 7, "t%d" % i) for i in range(50)] + [("k", 0, 99, "z"), ("l", None, 1, None)]
    for parts in (1, 5):
        got = keep_last(spark.createDataFrame(rows, "k string, v int, a int, t string").repartition(parts), ["k"], ["v"]).collect()
        assert {tuple(r) for r in got} == {("k", 1, 6, "t6"), ("l", None, 1, None)}


def test_fence_reaches_the_scan(spark, tiny):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=2 * i) for i in range(30)]
    cal = spark.createDataFrame(list(enumerate(days)), "idx int, date date")
    assert S.fence(cal, "2024-01-10", "2024-01-20", 3) == (days[2], days[9])  # days[5] is the first in the range
    assert S.fence(cal, "2024-01-02", "2024-01-04", 3) == (days[0], days[1])
    assert S.fence(cal, "2025-01-01", "2025-02-01") == (None, None) == S.fence(cal.limit(0), "2024-01-01", "2024-02-01")
    assert S.between_days(cal, "date", (None, None)).count() == 0
    kept = S.between_days(cal.withColumn("t", F.col("date").cast("timestamp") + F.expr("INTERVAL 23 HOURS")), "t", (days[2], days[9]))
    assert [r[0] for r in kept.select("idx").orderBy("idx").collect()] == list(range(2, 10))
    lines = T.ticks(spark, tiny, (dt.date(1999, 1, 1), dt.date(1999, 1, 31)))
    assert 0 < lines.count() < T.ticks(spark, tiny).count()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
