"""Supervised samples and targets, regime training set, Spark ML training and scoring."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rolling import Roll, with_rolling
from ..functions.scalar import month_key
from ..session import materialise, new_folder, packed
from .aggregates import sector_mean
from .timeseries import diff, dist_sma, drawdown, efficiency, forward_label, pcts, rsi_simple, vix_features, vol_ratio_sharpe
from .xsection import DATE, cs_rank

# fixed values: names of the feature columns
FEATURES = ("fip_z", "mom20_z", "mom60_z", "vol20_z", "beta", "rsi14", "structure_score", "rvol20", "vol_comp")


# D01
def weekly_samples(aligned: DataFrame, rebal: DataFrame, features=(), by=("ticker",)) -> DataFrame:
    """One row per series and rebalance date: features of the day before, entry at the open, exit at the
    close before the next rebalance.

    The three positions of a week are marked in a small table joined once, so
    the panel is read in a single pass and grouped by series and week.
    """
    marks = rebal.where(F.col("next_idx").isNotNull()).select(
        F.col("date").alias("sample"), F.explode(F.array(
            F.struct(F.lit("signal").alias("kind"), (F.col("idx") - 1).alias("idx")),
            F.struct(F.lit("entry").alias("kind"), F.col("idx").alias("idx")),
            F.struct(F.lit("exit").alias("kind"), (F.col("next_idx") - 1).alias("idx")))).alias("m")).select("sample", "m.kind", "m.idx")
    rows = aligned.select(*by, "idx", "open", "close", *[f for f in features if f not in ("open", "close")]).join(F.broadcast(marks), "idx")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = rows.groupBy(*by, F.col("sample").alias("date")).agg(
        at("entry", "open").alias("entry_open"), at("exit", "close").alias("exit_close"),
        *[at("signal", f).alias(f) for f in features])
    good = (F.col("entry_open") > 0) & F.col("exit_close").isNotNull()
    return out.withColumn("target_fwd_ret", F.when(good, F.col("exit_close") / F.col("entry_open") - 1.0))


# D02
def targets(df: DataFrame, market: DataFrame, x=DATE) -> DataFrame:
    """Excess over market and sector, and the percentile rank on the date. ``market``: date, market_ret."""
    known = df.where(F.col("target_fwd_ret").isNotNull())
    known = known.join(F.broadcast(market.select("date", "market_ret")), "date", "left")
    known = known.withColumn("market_ret", F.coalesce("market_ret", F.lit(0.0)))
    known = sector_mean(known, "target_fwd_ret", "sector_fwd_ret")
    known = known.withColumns({"target_excess_nifty": F.col("target_fwd_ret") - F.col("market_ret"),
                               "target_excess_sector": F.col("target_fwd_ret") - F.col("sector_fwd_ret")})
    return cs_rank(known, {"target_cs_rank": ("target_fwd_ret", True)}, x)


# D03
def rolling_betas(daily: DataFrame, width: int = 252, least: int = 100, by=("ticker",)) -> DataFrame:
    """Two-factor slopes over the trailing rows with all three returns, up to and including each row.

    ``daily``: series, date, ret, market_ret, sector_ret. Fewer than ``least``
    complete rows give 1, 1; so does a pair of factors that cannot be told
    apart, which is flagged.
    """
    full = F.col("ret").isNotNull() & F.col("market_ret").isNotNull() & F.col("sector_ret").isNotNull()
    df = daily.withColumns({"__y": F.when(full, F.col("ret")), "__m": F.when(full, F.col("market_ret")), "__s": F.when(full, F.col("sector_ret"))})
    pairs = {"__ym": ("__y", "__m"), "__ys": ("__y", "__s"), "__ms": ("__m", "__s")}
    df = with_rolling(df, [*[Roll(o, "cov", a, width, 2, other=b) for o, (a, b) in pairs.items()], Roll("__vm", "var", "__m", width, 2), Roll("__vs", "var", "__s", width, 2),
                           Roll("__n", "count", "__y", width, 0)], by)
    det = F.col("__vm") * F.col("__vs") - F.col("__ms") * F.col("__ms")
    flat = det <= 1e-9 * F.col("__vm") * F.col("__vs")
    enough = F.col("__n") >= least
    bm = (F.col("__ym") * F.col("__vs") - F.col("__ys") * F.col("__ms")) / F.nullif(det, F.lit(0.0))
    bs = (F.col("__ys") * F.col("__vm") - F.col("__ym") * F.col("__ms")) / F.nullif(det, F.lit(0.0))
    usable = enough & F.coalesce(~flat, F.lit(False))
    return df.withColumns({"beta_market": F.when(usable, bm).otherwise(1.0), "beta_sector": F.when(usable, bs).otherwise(1.0),
                           "degenerate": enough & F.coalesce(flat, F.lit(True))}).drop("__y", "__m", "__s", "__n", "__ym", "__ys", "__ms", "__vm", "__vs")


def residual_target(df: DataFrame) -> DataFrame:
    """Return left after the market and the sector, by the sample's slopes."""
    return df.withColumn("target_residual", F.col("target_fwd_ret") - F.col("beta_market") * F.col("market_ret")
                         - F.col("beta_sector") * F.col("sector_fwd_ret"))


# D04
# fixed values: names of the feature columns
REGIME_FEATURES = ("dist_sma50", "dist_sma100", "dist_sma200", "eff_ratio_20", "eff_ratio_50", "eff_ratio_100", "mom5", "mom10", "mom20", "mom60",
                   "vol20", "vol60", "vol_ratio", "sharpe_20", "sharpe_60", "breadth", "breadth_mom20", "vix", "vix_sma20", "vix_z", "risk_rel_strength",
                   "usd_mom20", "us10y_mom20", "gold_mom20", "cross_dispersion", "drawdown", "rsi14_market")


def regime_dataset(market: DataFrame, cross: DataFrame) -> DataFrame:
    """Friday rows of the 27 market features with the label of the next five days.

    ``market``: aligned roles. ``cross``: date, breadth, cross_dispersion. All
    inputs have one row per date and role.
    """
    role = ("role",)
    b = market.where("role = 'broad'").select("role", "date", "close")
    b = dist_sma(b, by=role)
    b = efficiency(b, {f"eff_ratio_{n}": (n, n // 2, "strict") for n in (20, 50, 100)}, role)
    b = pcts(b, {"ret": ("close", 1), **{f"mom{k}": ("close", k) for k in (5, 10, 20, 60)}}, role)
    b = forward_label(rsi_simple(drawdown(vol_ratio_sharpe(b, role), "close", role), by=role), by=role)
    c = diff(cross.withColumn("role", F.lit("broad")), "breadth", 20, "breadth_mom20", role).drop("role")
    fear = vix_features(market.where("role = 'fear'").select("role", "date", "close"))
    fear = fear.select("date", F.col("close").alias("vix"), "vix_sma20", "vix_z")
    moves = pcts(market.select("role", "date", "close"), {"__m": ("close", 20)}, role)
    of = lambda r, o: F.max(F.when(F.col("role") == r, F.col("__m"))).alias(o)
    moves = moves.groupBy("date").agg(of("risk", "__risk"), of("usd", "usd_mom20"), of("us10y", "us10y_mom20"), of("gold", "gold_mom20"))
    df = b.join(c, "date", "left").join(fear, "date", "left").join(moves, "date", "left")
    df = df.withColumn("risk_rel_strength", F.col("__risk") - F.col("mom20"))
    fridays = df.where(F.dayofweek("date") == 6).dropna(subset=["dist_sma200", "vol20", "breadth", "regime_label", "fwd_ret_5"])
    return fridays.select("date", *REGIME_FEATURES, "regime_label", "fwd_ret_5")


# D05
def time_split(df: DataFrame, year: int = 2025, date: str = "date") -> tuple[DataFrame, DataFrame]:
    return df.where(F.year(date) < year), df.where(F.year(date) >= year)


FILLED = "__in_"


def _filled(features) -> list:
    """Fills missing features, so that scoring returns as many rows as it gets, and packs them."""
    names = [f"{FILLED}{f}" for f in features]
    return [Imputer(inputCols=list(features), outputCols=names, strategy="mean"), VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")]


def _without_inputs(df: DataFrame) -> DataFrame:
    return df.drop("features", "rawPrediction", "probability", *[c for c in df.columns if c.startswith(FILLED)])


# D06, D07
def regression_pipeline(features=FEATURES, label: str = "target_fwd_ret", trees: int = 100, depth: int = 4, rate: float = 0.05, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees, trained on complete rows; a row scored with a missing feature gets its mean in training."""
    return Pipeline(stages=[
        *_filled(features),
        GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                     featureSubsetStrategy="0.8", seed=seed)])


def classifier_pipeline(features=REGIME_FEATURES, label: str = "regime_label", kind: str = "forest", trees: int = 200, depth: int = 3, seed: int = 42) -> Pipeline:
    """Three-class regime model: a forest, or multinomial regression."""
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    if kind == "forest":
        model = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth, subsamplingRate=0.8,
                                       featureSubsetStrategy="0.7", minInstancesPerNode=5, seed=seed)
    else:
        model = LogisticRegression(featuresCol="features", labelCol="label_index", family="multinomial", regParam=0.1)
    return Pipeline(stages=[index, *_filled(features), model])


def train(df: DataFrame, pipeline: Pipeline, label: str) -> PipelineModel:
    """Fits on the rows with a label and all features."""
    features = [c for stage in pipeline.getStages() if isinstance(stage, Imputer) for c in stage.getInputCols()]
    return pipeline.fit(df.dropna(subset=[label, *features]))


def class_probabilities(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """Probability columns named after the classes."""
    labels = model.stages[0].labels
    p = vector_to_array("probability")
    out = scored.withColumns({f"p_{v.lower()}": p[i] for i, v in enumerate(labels)})
    names = F.array(*[F.lit(v) for v in labels])
    return out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).transform(_without_inputs)


# D08
class ModelStore(Mapping):
    """Trained pipelines by month in a shared folder, with an index table: ``month``, ``train_rows``, ``path``.

    A month counts as stored once its index row is written, after its model; so a run that was broken off goes on
    where it stopped, and half-written models are written again. Models are loaded when first asked for.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._loaded: dict[str, PipelineModel] = {}
        self._rows = {r["month"]: r for r in self.table().collect()}  # a row per month

    def table(self) -> DataFrame:
        """The index; empty where nothing is stored yet."""
        try:
            return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index").groupBy("month").agg(F.max("train_rows").alias("train_rows"), F.max("path").alias("path"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], INDEX)

    def save(self, month: str, model: PipelineModel) -> None:
        """Writes a model without its index row; several months may be written at once."""
        model.write().overwrite().save(f"{self.folder}/{month}")

    def enter(self, month: str, model: PipelineModel, train_rows: int) -> None:
        """Writes the index row of a saved model; one at a time."""
        row = self.spark.createDataFrame([(month, train_rows, f"{self.folder}/{month}")], INDEX)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/index")
        self._rows[month], self._loaded[month] = row.first(), model

    def add(self, month: str, model: PipelineModel, train_rows: int) -> None:
        self.save(month, model)
        self.enter(month, model, train_rows)

    def newest(self, month: str) -> str | None:
        """The newest month stored at or before ``month``."""
        return max((m for m in self._rows if m <= month), default=None)

    def __getitem__(self, month: str) -> PipelineModel:
        if month not in self._loaded:
            self._loaded[month] = PipelineModel.load(self._rows[month]["path"])
        return self._loaded[month]

    def __iter__(self):
        return iter(sorted(self._rows))

    def __len__(self) -> int:
        return len(self._rows)


INDEX = "month string, train_rows long, path string"


def score(df: DataFrame, models: Mapping, fallback: PipelineModel | None = None, date: str = "date", out: str = "ml_pred_return") -> DataFrame:
    """Each month's rows by the newest model keyed at or before it; earlier rows by the fallback.

    ``models``: month key -> model trained on what was known before that month (a dict or a store).
    Every model sees only its own date slice, so each row is scored once; rows with missing features too. Months without rows load no model.
    ``model`` is the month key of the model used, ``fallback`` before the first.
    """
    months = sorted(models)
    used = {max((m for m in months if m <= r["month"]), default=None) for r in df.select(month_key(date).alias("month")).distinct().collect()}
    key = month_key(date)
    slices = [(m, models[m], (key >= m) & ((key < months[i + 1]) if i + 1 < len(months) else F.lit(True))) for i, m in enumerate(months) if m in used]
    if fallback is not None and (None in used or not slices):
        slices.insert(0, ("fallback", fallback, key < months[0] if months else F.lit(True)))
    result = None
    for name, model, rows in slices:
        part = _without_inputs(model.transform(df.where(rows)).withColumnRenamed("prediction", out)).withColumn("model", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return df.limit(0).withColumns({out: F.lit(None).cast("double"), "model": F.lit(None).cast("string")}) if result is None else result


# D09
def walk_forward(df: DataFrame, pipeline: Pipeline, label: str, months: list[str], known: str = "exit_date", folder: str | None = None, at_once: int = 4) -> ModelStore:
    """One model per month, trained on the rows whose outcome was known before the month began; months with no such rows have none.

    Models that ``folder`` already holds are taken as they are. The others are fitted and saved ``at_once`` at a time over one stored training
    table, each fit a Spark job of its own, so that a small fit does not leave the cluster waiting. The table has as many parts as its rows need:
    a fit is some dozens of short jobs, whose tasks would else be as many as those that made the rows.
    """
    spark = df.sparkSession
    store = ModelStore(spark, folder or new_folder(spark, "models"))
    features = [c for stage in pipeline.getStages() if isinstance(stage, Imputer) for c in stage.getInputCols()]
    rows = materialise(df.dropna(subset=[label, *features]).select(*dict.fromkeys([label, *features, known])), "complete")
    # how many rows each month can learn from: sums by month of the outcome, one row each
    counts = {r["m"]: r["count"] for r in rows.groupBy(month_key(known).alias("m")).count().collect() if r["m"]}
    wanted = [m for m in sorted(set(months) - set(store)) if any(k < m for k in counts)]
    if not wanted:
        return store
    rows = packed(rows, "training")

    def fit(month: str):
        model = pipeline.copy().fit(rows.where(F.col(known) < F.to_date(F.lit(f"{month}-01"))))
        store.save(month, model)
        return month, model, sum(n for m, n in counts.items() if m < month)

    with ThreadPoolExecutor(at_once) as pool:
        for month, model, n in pool.map(inheritable_thread_target(spark)(fit), wanted):
            store.enter(month, model, n)
    return store


def expanding_fits(df: DataFrame, features, label: str, known: str = "exit_date", date: str = "date") -> DataFrame:
    """A linear model for every month of ``date``, fitted to the rows whose outcome was known in an earlier month: all models in one plan.

    The least-squares slope of the label on each feature (over rows with both) comes from sums by month, added up over the months before; so
    rows are read once however many months there are. Columns: month, n, mean_y, mean_<f>, slope_<f>.
    """
    rows = df.where(F.col(label).isNotNull())
    month = month_key(known).alias("month")
    sums = [F.count("*").alias("n"), F.sum(label).alias("s")]
    for f in features:
        x, y = F.col(f), F.when(F.col(f).isNotNull(), F.col(label))
        sums += [F.count(x).alias(f"n_{f}"), F.sum(x).alias(f"x_{f}"), F.sum(y).alias(f"y_{f}"), F.sum(x * x).alias(f"xx_{f}"), F.sum(x * y).alias(f"xy_{f}")]
    monthly = rows.groupBy(month).agg(*sums)
    every = df.select(month_key(date).alias("month")).distinct().join(monthly, "month", "full")
    past = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # a row per month
    every = every.select("month", *[F.sum(c).over(past).alias(c) for c in monthly.columns if c != "month"]).where("n > 0")
    out = {"mean_y": F.col("s") / F.col("n")}
    for f in features:
        n, x, y, xx, xy = (F.col(f"{k}_{f}") for k in ("n", "x", "y", "xx", "xy"))
        out[f"mean_{f}"] = F.try_divide(x, n)
        out[f"slope_{f}"] = F.try_divide(xy - x * y / n, xx - x * x / n)
    return every.withColumns(out).select("month", "n", *out)


def predict_by_month(df: DataFrame, fits: DataFrame, features, out: str, fixed: str | None = None, date: str = "date") -> DataFrame:
    """Adds the prediction of the row's month, or of one month for all rows; a missing feature adds nothing. ``fits``: one row per month."""
    key = F.lit(fixed) if fixed else month_key(date)
    joined = df.withColumn("__month", key).join(F.broadcast(fits.drop("n").withColumnRenamed("month", "__month")), "__month", "left")  # a row per month
    parts = [F.coalesce(F.col(f"slope_{f}") * (F.col(f) - F.col(f"mean_{f}")), F.lit(0.0)) for f in features]
    value = F.round(F.col("mean_y") + sum(parts[1:], parts[0]), 12)
    return joined.withColumn(out, value).select(*df.columns, out)


# D10
def importance(spark, model: PipelineModel, features) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")
