import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import datasets as D
from panelwright.operators import ingest as I, news as N, portfolio as P, quality as Q, regime as G
from panelwright.operators.aggregates import TOPICS
from panelwright.session import new_folder
from panelwright.sources import readers as R, sinks as K
from panelwright.streaming import jobs as ST


def prices(n=90):
    rng = np.random.default_rng(0)
    c = 100 * (1 + rng.normal(0, 0.01, n)).cumprod()
    return pd.DataFrame({"ticker": "A", "date": pd.date_range("2024-01-01", periods=n).date, "high": c + 1, "low": c - 1, "close": c, "volume": 10.0})


SCHEMA = "ticker string, date date, high double, low double, close double, volume double"


def test_anomalies_on_a_planted_series(spark):
    p = prices()
    p.loc[75, "close"] *= 1.45           # a 45% jump
    p.loc[75:, "close"] = p.loc[75, "close"] * 1.0
    p.loc[75:, "high"], p.loc[75:, "low"] = p.loc[75, "close"] + 1, p.loc[75, "close"] - 1
    p.loc[80, ["high", "low"]] = [1.0, 2.0]
    short = prices(9).assign(ticker="B", close=-1.0)  # fewer than ten rows are not judged
    got = Q.anomalies(spark.createDataFrame(pd.concat([p, short]), SCHEMA)).toPandas()
    kinds = got.groupby("type")["date"].apply(list).to_dict()
    assert set(got["ticker"]) == {"A"}
    assert kinds["PRICE_DISCONTINUITY"] == [p.loc[75, "date"]] and kinds["RETURN_VOL_OUTLIER"] == [p.loc[75, "date"]]
    assert kinds["INVALID_HIGH_LOW"] == [p.loc[80, "date"]]
    assert sorted(kinds["FLATLINED_CLOSE"]) == list(p.loc[85:, "date"])  # from the tenth unchanged day on
    flat = got[got.type == "FLATLINED_CLOSE"].sort_values("date")["msg"].iloc[0]
    assert "on row 10 of a flat run" in flat


def test_price_folder_and_file_checks(spark):
    root = new_folder(spark, "root")
    for cls in R.CLASSES:
        os.makedirs(f"{root}/{cls}")
    frame = pd.DataFrame({"date": pd.to_datetime(["2024-01-01", "2024-01-02"]).astype("datetime64[us]"), "close": [1.0, float("nan")], "Volume": [5.0, 6.0]})
    frame.to_parquet(f"{root}/stocks/abc.parquet", index=False)
    pd.DataFrame({"Date": pd.to_datetime(["2024-01-01"]).astype("datetime64[us]"), "Open": [1.0], "High": [1.0], "Low": [1.0], "Close": [3.0], "Volume": [1.0], "Ticker": ["zzz"]}
                 ).to_parquet(f"{root}/macro/gold.parquet", index=False)
    with open(f"{root}/indices/bad.parquet", "w") as f:
        f.write("not a parquet file")
    with pytest.raises(Exception, match="bad.parquet"):  # by default a file that cannot be read fails the scan
        R.read_panel(spark, root).collect()
    rows = {(r.ticker, r.asset_class, str(r.date)): r for r in R.read_panel(spark, root, skip_unreadable=True).collect()}
    assert set(rows) == {("abc", "stocks", "2024-01-01"), ("abc", "stocks", "2024-01-02"), ("gold", "macro", "2024-01-01")}
    assert rows[("abc", "stocks", "2024-01-02")].close is None and rows[("gold", "macro", "2024-01-01")].close == 3.0
    bad = {r.ticker: (r.type, r.msg) for r in Q.check_files(spark, [f"{root}/{c}" for c in R.CLASSES], R.PRICES).collect()}
    assert bad["bad"][0] == "LOAD_ERROR" and bad["abc"] == ("MISSING_COLUMNS", "no value in column Open") and "gold" not in bad


def test_trade_log_round_trip_coerces(spark):
    path = new_folder(spark, "csv")
    os.makedirs(path)
    with open(f"{path}/t.csv", "w") as f:
        f.write("date,ticker,weight,net_pnl,side\n2024-01-05,A,0.1,abc,LONG\nnot a date,B,,5,LONG\n")
    got = R.read_trades(spark, path).orderBy("ticker").collect()
    assert (got[0].date, got[0].weight, got[0].net_pnl) == (dt.date(2024, 1, 5), 0.1, None)
    assert (got[1].date, got[1].weight, got[1].net_pnl) == (None, None, 5.0)


def test_json_sources(spark):
    root = new_folder(spark, "json")
    os.makedirs(f"{root}/runs")
    with open(f"{root}/map.json", "w") as f:
        json.dump({"A": "IT", "B": "Metals"}, f, indent=2)
    assert {r.ticker: r.sector for r in R.read_sector_map(spark, f"{root}/map.json").collect()} == {"A": "IT", "B": "Metals"}
    with open(f"{root}/runs/r1.json", "w") as f:
        json.dump({"name": "x", "config": {"lr": 0.1}, "metrics": {"sharpe": 1.5}}, f, indent=1)
    got = {(r.run, r.section, r.name): r.value for r in R.read_experiments(spark, f"{root}/runs").collect()}
    assert got == {("r1", "run", "name"): "x", ("r1", "config", "lr"): "0.1", ("r1", "metrics", "sharpe"): "1.5"}
    good = {f: "v" for f in I.REGISTRY_FIELDS} | {"competing_hypotheses": ["a", "b"], "status": "Replicated", "evidence_tier": "Level 2"}
    entries = [good | {"experiment_id": "1"}, good | {"experiment_id": "2", "evidence_tier": "Level 1 (Definitive)"}, good | {"experiment_id": "3", "competing_hypotheses": ["a"], "title": ""}]
    with open(f"{root}/reg.json", "w") as f:
        json.dump(entries, f, indent=1)
    reg = R.read_registry(spark, f"{root}/reg.json")
    v = {r.experiment_id: r.violations for r in I.validate_registry(reg).collect()}
    assert v == {"1": [], "2": ["invalid tier"], "3": ["missing title", "fewer than 2 hypotheses"]}
    assert {r.experiment_id for r in I.register(reg.where("experiment_id = '2'"), reg).collect()} == {"1", "2"}


def test_write_by_year(spark):
    path = new_folder(spark, "years")
    df = spark.createDataFrame([("2023-06-01", 1), ("2024-06-01", 2)], "date string, v int").withColumn("date", F.to_date("date"))
    K.write_outputs(df, path, by_year="date")
    K.overwrite_years(df.where("v = 2").withColumn("v", F.lit(9)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


def test_articles(spark):
    rows = [("2024-01-01 10:00:00", "https://A.com/x", "RBI raises rates", "India bank"), ("2024-01-02 10:00:00", "https://A.com/x", "Later copy", None),
            (None, "https://b.com/y", "No time", "x"), ("2024-01-01 11:00:00", "https://c.com/z", "Oil up", "")]
    df = spark.createDataFrame(rows, "t string, url string, title string, description string").select(F.col("t").cast("timestamp").alias("published_at"), "url", "title", "description")
    lexicon = {t: ["zzzz"] for t in TOPICS} | {"india": ["india"], "policy": ["rbi"], "oil": ["oil"]}
    out = {r.domain: r for r in N.normalise_articles(df, lexicon, {"india": 2.0, "oil": 0.5}).collect()}
    assert set(out) == {"a.com", "c.com"} and out["a.com"].title == "Later copy" and out["c.com"].relevance_score == 0.5
    assert out["c.com"].article_id == __import__("hashlib").sha256(b"https://c.com/z").hexdigest()[:24]


def test_scorer_runs_on_unseen_only(spark):
    arts = spark.createDataFrame([(str(i), "t", "d" * i) for i in range(50)], "article_id string, title string, description string")
    seen = arts.where("article_id < '3'")

    def load():
        return lambda texts: [("positive" if len(t) % 2 else "negative", 0.9) for t in texts]

    got = N.score_new(arts, seen, load, "m", batch=7).collect()
    assert {r.article_id for r in got} == {str(i) for i in range(50) if str(i) >= "3"}
    assert all(abs(r.sentiment_score) == 0.9 and r.model_version == "m" for r in got)
    assert all((r.sentiment_score > 0) == ((3 + int(r.article_id)) % 2 == 1) for r in got)


def test_regime_first_row_and_sums(spark):
    base = {"above_sma": 1.0, "trend_score": 1.2, "breadth_score": 0.3, "risk_score": 0.2, "macro_score": 0.01, "news_bias": 0.0, "suppression_score": 0.0}
    rows = [{**base, "date": dt.date(2024, 1, 1)}, {**base, "date": dt.date(2024, 1, 2), "above_sma": -1.0, "trend_score": -1.5}]
    got = G.transition_risk(G.regime_probs(spark.createDataFrame(rows), 1.0)).orderBy("date").collect()
    for r in got:
        assert abs(r.p_bull + r.p_chop + r.p_bear - 1) < 1e-12
    assert got[0].selected == "BULL" and got[1].selected == "BEAR"
    assert np.isclose(got[0].transition_risk, 0.35 * got[0].instability + 0.20 * (1 - got[0].regime_confidence))
    shift = sum(abs(got[1][c] - got[0][c]) for c in ("p_bull", "p_chop", "p_bear")) / 2
    assert np.isclose(got[1].transition_risk, 0.45 * shift + 0.20 * got[1].instability + 0.15 * (1 - got[1].regime_confidence))


def test_ledger_forgets_repeats_and_keeps_the_newest(spark):
    src, out, ck = new_folder(spark, "src"), new_folder(spark, "out"), new_folder(spark, "ck")
    msg = lambda o, s, t, f: {"orderid": o, "status": s, "updateTime": t, "filledshares": f, "quantity": "100"}
    one = [msg("1", "open", "26-Apr-2024 09:35:12", "0"), msg("1", "open", "26-Apr-2024 09:35:12", "0"), msg("2", "open", "bad time", "0")]
    two = [msg("1", "open", "26-Apr-2024 09:35:12", "0"), msg("1", "complete", "26-Apr-2024 09:36:00", "100")]
    for batch in (one, two):
        spark.createDataFrame([(json.dumps(m),) for m in batch], "value string").coalesce(1).write.mode("append").text(src)
        ST.run_to_end(ST.order_ledger(spark.readStream.schema(ST.POSTBACK).json(src)), out, ck)
    ledger = spark.read.parquet(out)
    assert ledger.count() == 2
    r = ST.latest_status(ledger).collect()
    assert [(x.orderid, x.status, x.fill_ratio, x.updates) for x in r] == [("1", "complete", 1.0, 2)]


def test_status_stream_takes_late_rows_and_goes_on_after_a_restart(spark):
    src, table, ck = new_folder(spark, "ledger"), new_folder(spark, "status"), new_folder(spark, "ck")
    schema = "orderid string, status string, event_time timestamp, filledshares double, quantity double, averageprice double"
    row = lambda o, s, minute, f: (o, s, dt.datetime(2024, 4, 26, 9, minute), float(f), 100.0, 1.0)
    for batch in ([row("1", "open", 30, 0), row("2", "open", 31, 0)], [row("1", "complete", 45, 100)], [row("1", "partial", 40, 60), row("3", "open", 50, 0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ST.run_to_end(ST.status_stream(spark.readStream.schema(schema).parquet(src)), ST.status_upsert(table, 2), ck, "update")
    got = {r.orderid: (r.status, r.fill_ratio, r.updates) for r in spark.read.parquet(table).collect()}
    assert got == {"1": ("complete", 1.0, 3), "2": ("open", 0.0, 1), "3": ("open", 0.0, 1)}
    again = spark.read.parquet(table).drop("bucket").where("orderid = '2'")
    ST.status_upsert(table, 2)(again, 99)  # a batch that runs twice changes nothing
    assert spark.read.parquet(table).count() == 3


def test_rank_buffer_stream_equals_batch(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("x", "y"):
        for k in range(12):
            for i, t in enumerate(rng.permutation([f"T{j}" for j in range(12)])):
                rows.append((s, dt.date(2024, 1, 5) + dt.timedelta(days=7 * k), str(t), float(-i), i + 1))
    df = spark.createDataFrame(rows, "scenario string, date date, ticker string, score double, place int")
    batch = P.rank_buffer(df.drop("place"), keep=5, n=4).toPandas()
    src, out, ck = new_folder(spark, "src"), new_folder(spark, "out"), new_folder(spark, "ck")
    for cond in ("date < '2024-02-10'", "date >= '2024-02-10'"):
        df.where(cond).write.mode("append").parquet(src)
        ST.run_to_end(ST.rank_buffer_stream(spark.readStream.schema(df.schema).parquet(src), 5, 4), out, ck)
    stream = spark.read.parquet(out).toPandas()
    pick = lambda f: set(zip(f["scenario"], f["date"], f["ticker"]))
    assert pick(stream) == pick(batch)


def test_news_window_drops_late_rows(spark):
    src, out, ck = new_folder(spark, "src"), new_folder(spark, "out"), new_folder(spark, "ck")
    schema = "article_id string, published_at timestamp, domain string, finbert_label string, sentiment_score double"
    feed = [[("1", "2024-01-01 10:00:00"), ("2", "2024-01-03 10:00:00")], [("3", "2024-01-01 11:00:00"), ("4", "2024-01-06 00:00:00")], [("5", "2024-01-09 00:00:00")]]
    for rows in feed:
        df = spark.createDataFrame([(a, dt.datetime.fromisoformat(t), "d", "negative", -1.0) for a, t in rows], schema)
        df.write.mode("append").parquet(src)
        ST.run_to_end(ST.news_window(spark.readStream.schema(schema).parquet(src)), out, ck)
    got = {str(r.date): r.article_count for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-03"] == 1  # article 3 came after its day was closed


def test_shared_folder_is_refused_off_local_mode(spark, monkeypatch):
    from panelwright import session

    class Ctx:
        master = "yarn"

    class Fake:
        sparkContext = Ctx()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_price_upsert_takes_the_newest_version_of_a_key(spark):
    path = new_folder(spark, "prices")
    schema = "ticker string, date date, close double, version int"
    day = pd.Timestamp("2024-01-02").date()
    merge = ST.price_upsert(path)
    merge(spark.createDataFrame([("a", day, 1.0, 2), ("a", day, 2.0, 1), ("b", day, 5.0, 1)], schema), 0)
    merge(spark.createDataFrame([("b", day, 6.0, 2)], schema), 1)
    assert {r.ticker: r.close for r in spark.read.parquet(path).collect()} == {"a": 1.0, "b": 6.0}
    with pytest.raises(ValueError, match="version"):
        merge(spark.createDataFrame([("a", day, 1.0)], "ticker string, date date, close double"), 2)


def test_scoring_keeps_rows_with_missing_features(spark):
    rows = [(i, float(i % 7), float(i % 3) if i % 5 else None, float(i % 7) / 10) for i in range(80)]
    df = spark.createDataFrame(rows, "n int, a double, b double, y double").selectExpr("date_add(DATE '2024-01-01', n) AS date", "a", "b", "y")
    model = D.train(df, D.regression_pipeline(("a", "b"), "y", trees=2), "y")
    got = D.score(df, {"2024-02": model}, model).collect()
    assert len(got) == 80 and all(r.ml_pred_return is not None for r in got)
    assert {r.model for r in got} == {"fallback", "2024-02"} and not [c for c in got[0].asDict() if c.startswith("__")]


def test_fits_read_a_table_laid_out_by_its_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    seen = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    df = spark.range(400).selectExpr("date_add(DATE '2024-01-01', int(id % 80)) AS exit_date", "double(id % 7) AS a", "double(id % 7) / 10 AS y").repartition(24, "a", "exit_date")
    line = Pipeline(stages=[Imputer(inputCols=["a"], outputCols=["__in_a"]), VectorAssembler(inputCols=["__in_a"], outputCol="features"), LinearRegression(labelCol="y")])
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = D.walk_forward(df, line, "y", ["2024-02", "2024-03"], at_once=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(seen) == [(1, 155), (1, 300)]  # one task a job, all rows known by then
    assert {r.month: r.train_rows for r in store.table().collect()} == {"2024-02": 155, "2024-03": 300}


def test_models_are_stored_and_taken_up_again(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rows = [(f"2024-{m:02d}-{d:02d}", float(d), float(d * m)) for m in range(1, 7) for d in range(1, 9)] + [("2024-03-09", None, 1.0)]
    df = spark.createDataFrame(rows, "date string, a double, y double").withColumn("date", F.to_date("date")).withColumn("exit_date", F.date_add("date", 7))
    line = Pipeline(stages=[Imputer(inputCols=["a"], outputCols=["__in_a"]), VectorAssembler(inputCols=["__in_a"], outputCol="features"), LinearRegression(labelCol="y")])
    folder = str(tmp_path / "models")
    first = D.walk_forward(df, line, "y", ["2024-01", "2024-02", "2024-03"], folder=folder)
    assert list(first) == ["2024-02", "2024-03"]  # nothing is known before January
    assert {r.month: r.train_rows for r in first.table().collect()} == {"2024-02": 8, "2024-03": 16}
    line.write().overwrite().save(folder + "/2024-04")  # broken off before its index row: written again
    again = D.walk_forward(df, line.copy(), "y", ["2024-02", "2024-03", "2024-04", "2024-06"], folder=folder)
    assert list(again) == ["2024-02", "2024-03", "2024-04", "2024-06"] and again.newest("2024-05") == "2024-04" and again.newest("2024-01") is None
    stored = D.ModelStore(spark, folder)
    slope = lambda m: stored[m].stages[-1].coefficients[0]
    assert abs(slope("2024-02") - 1.0) < 1e-6 and abs(slope("2024-03") - 1.5) < 1e-6 and abs(slope("2024-04") - 2.0) < 1e-6
    got = D.score(df, stored, stored["2024-02"]).collect()
    assert len(got) == len(rows)
    assert {str(r.date)[:7]: r.model for r in got} == {"2024-01": "fallback", "2024-02": "2024-02", "2024-03": "2024-03", "2024-04": "2024-04", "2024-05": "2024-04", "2024-06": "2024-06"}


def test_monthly_models_are_fitted_with_all_trees(spark, tiny, monkeypatch):
    from panelwright.catalog import datasets as catalog
    asked = []
    monkeypatch.setattr(D, "walk_forward", lambda rows, line, label, months, **how: asked.append((line.getStages()[-1].getMaxIter(), months)))
    monkeypatch.setattr(catalog, "STORES", {})
    rows, _ = catalog.monthly_models(spark, tiny)
    (trees, months), = asked
    assert trees == D.regression_pipeline().getStages()[-1].getMaxIter() == 100
    assert {r["m"] for r in rows.select(F.date_format("date", "yyyy-MM").alias("m")).distinct().collect()} <= set(months)
