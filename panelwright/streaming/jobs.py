"""ST1-ST5: order ledger, price upserts, carried selections and labels, daily news windows.

Streams read and write files below the shared folder and keep their state in
the checkpoint there, so a lost executor or a restart continues where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import upsert
from ..operators.portfolio import KEEP_RANK, LONG_NAMES, choose
from ..operators.regime import step_label
from ..session import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POSTBACK = ", ".join(f"{c} string" for c in (
    "clientcode", "orderid", "tradingsymbol", "symboltoken", "transactiontype", "exchange", "ordertype", "producttype", "duration", "price", "quantity", "status",
    "averageprice", "filledshares", "unfilledshares", "orderstatus", "cancelstatus", "updateTime", "received_at")) + ", timestamp_epoch double"
TIME_FORMAT = "dd-MMM-yyyy HH:mm:ss"


def use_rocksdb(spark: SparkSession) -> None:
    """State with variables of its own needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_end(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there now and stops. ``sink``: a path for parquet, or a function of (batch, id)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").start(sink)
    q.awaitTermination()


# ST1
def order_ledger(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Postbacks typed and cleared of repeats; works on a stream and on a table.

    A repeat is the same order, status and update time; of a table the one received first stays. In a stream, keys are
    forgotten once the watermark passes them, so state stays bounded.
    """
    typed = raw.withColumns({
        "event_time": F.try_to_timestamp("updateTime", F.lit(TIME_FORMAT)), "received_at": F.coalesce(F.col("received_at").try_cast("timestamp"), F.current_timestamp()),
        **{c: F.col(c).try_cast("double") for c in ("price", "averageprice", "quantity", "filledshares", "unfilledshares")}})
    typed = typed.where(F.col("event_time").isNotNull())
    keys = ["orderid", "status", "updateTime"]
    if raw.isStreaming:
        return typed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)
    first = Window.partitionBy(*keys).orderBy("received_at", *[c for c in typed.columns if c not in (*keys, "received_at")])
    return typed.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def latest_status(ledger: DataFrame) -> DataFrame:
    """Newest state of each order with the filled share; a grouped view over the append-only ledger."""
    last = F.max_by(F.struct("status", "filledshares", "quantity", "averageprice"), F.struct("event_time", "status")).alias("l")
    out = ledger.groupBy("orderid").agg(last, F.max("event_time").alias("event_time"), F.count("*").alias("updates"))
    return out.select("orderid", "event_time", "updates", "l.status", "l.filledshares", "l.quantity",
                      F.coalesce(F.try_divide("l.filledshares", "l.quantity"), F.lit(0.0)).alias("fill_ratio"))


def status_stream(ledger: DataFrame) -> DataFrame:
    """The newest state of each order over a stream of ledger rows, for update mode: a row for every order a batch touches.

    State is one row per order. A late row counts as an update, and changes the status only if its event is the newest.
    """
    return latest_status(ledger)


def status_upsert(path: str, buckets: int = 16):
    """A foreachBatch function that keeps a table of orders at their newest state, stored by hash buckets of the order."""
    return _merged_into(path, ("orderid",), ("updates", "event_time"), "bucket", F.pmod(F.xxhash64("orderid"), F.lit(buckets)).cast("int"))


def _merged_into(path: str, keys, order, part: str, part_of):
    """A foreachBatch function that merges rows into a table stored by ``part``.

    Only the parts a batch touches are read and rewritten. The merged rows go
    to a folder of their own first, since a table cannot be overwritten while
    it is read; running a batch twice gives the same table. Of rows with one key the
    newest by ``order`` holds; a batch without these columns is refused.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if missing := [c for c in order if c not in batch.columns]:
            raise ValueError(f"rows of one key cannot be put in order without {missing}")
        fresh = batch.withColumn(part, part_of)
        touched = [r[0] for r in fresh.select(part).distinct().collect()]
        if not touched:
            return
        columns = batch.columns
        try:
            old = spark.read.parquet(path).where(F.col(part).isin(touched)).select(*columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = batch.limit(0)
        from ..operators.news import keep_last
        newest = keep_last(fresh.drop(part), keys, order)
        staged = new_folder(spark, f"upsert-{batch_id}")
        upsert(old, newest, keys).write.parquet(staged)
        (spark.read.parquet(staged).withColumn(part, part_of).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(part).parquet(path))
    return merge


# ST2
def price_upsert(path: str, keys=("ticker", "date"), order=("version",)):
    """A foreachBatch function that merges price rows into a table stored by year."""
    return _merged_into(path, keys, order, "year", F.year("date"))


# ST3
class HeldNames(StatefulProcessor):
    """Rank buffer of one scenario: what it holds is kept between batches."""

    def __init__(self, keep: int, n: int):
        self.keep, self.n = keep, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", T.StructType([T.StructField("ticker", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day_rows = pd.concat(list(rows)).sort_values(["date", "place"])
        held = {r[0] for r in self.held.get()} if self.held.exists() else set()
        picks = []
        for _, day in day_rows.groupby("date", sort=True):
            held = set(choose(day["ticker"].tolist(), held, self.keep, self.n))
            picks.append(day[day["ticker"].isin(held)])
        self.held.clear()
        if held:
            self.held.put([(t,) for t in sorted(held)])
        yield pd.concat(picks)

    def close(self) -> None:
        pass


def rank_buffer_stream(ranked: DataFrame, keep: int = KEEP_RANK, n: int = LONG_NAMES, by: str = "scenario") -> DataFrame:
    """Carried selection over a stream of ranked candidates (at most max(keep, 2n) rows per date).

    Dates must arrive in order; within a batch they are sorted.
    """
    use_rocksdb(ranked.sparkSession)
    return ranked.groupBy(by).transformWithStateInPandas(
        statefulProcessor=HeldNames(keep, n), outputStructType=ranked.schema, outputMode="Append", timeMode="None")


# ST4
class StickyLabel(StatefulProcessor):
    """Smoothed class probabilities and the label in force for one series."""

    def __init__(self, alpha: float, gap: float):
        self.alpha, self.gap = alpha, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(c, T.DoubleType()) for c in ("bull", "chop", "bear")] + [T.StructField("label", T.StringType())]
        self.state = handle.getValueState("sticky", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values("date")
        state = self.state.get() if self.state.exists() else None
        smooth, label = (tuple(state[:3]), state[3]) if state is not None else (None, "CHOP")
        out = []
        for raw in zip(df["p_bull"], df["p_chop"], df["p_bear"]):
            smooth = raw if smooth is None else tuple(self.alpha * r + (1 - self.alpha) * s for r, s in zip(raw, smooth))
            label = step_label(label, dict(zip(("BULL", "CHOP", "BEAR"), smooth)), self.gap)
            out.append((*smooth, label))
        self.state.update((float(smooth[0]), float(smooth[1]), float(smooth[2]), label))
        done = pd.DataFrame(out, columns=["p_bull", "p_chop", "p_bear", "regime"], index=df.index)
        yield df[["series", "date"]].join(done)

    def close(self) -> None:
        pass


def sticky_stream(stream: DataFrame, alpha: float = 0.35, gap: float = 0.10) -> DataFrame:
    """The label of G07 over a stream (series, date, p_bull, p_chop, p_bear)."""
    use_rocksdb(stream.sparkSession)
    schema = T.StructType([T.StructField("series", T.StringType()), T.StructField("date", T.DateType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("p_bull", "p_chop", "p_bear")], T.StructField("regime", T.StringType())])
    return stream.select("series", "date", "p_bull", "p_chop", "p_bear").groupBy("series").transformWithStateInPandas(
        statefulProcessor=StickyLabel(alpha, gap), outputStructType=schema, outputMode="Append", timeMode="None")


# ST5
def news_window(stream: DataFrame, delay: str = "2 hours", width: str = "1 day", topics=()) -> DataFrame:
    """News figures per event-time window; late rows within ``delay`` still count.

    Two stages of state: sums per window and domain, then over a window's domains. So distinct domains are counted exactly, and the state holds a row per
    open window and domain rather than every article. Rows without a domain count in all figures but that one.
    """
    lab = F.col("finbert_label")
    part = stream.withWatermark("published_at", delay).groupBy(F.window("published_at", width).alias("w"), "domain").agg(
        F.count("article_id").alias("articles"), F.sum("sentiment_score").alias("sentiment"), F.count("sentiment_score").alias("rated"),
        F.sum((lab == "negative").cast("long")).alias("negative"), F.sum((lab == "positive").cast("long")).alias("positive"), F.count(lab).alias("labelled"),
        *[F.sum(f"topic_{t}").alias(f"__{t}") for t in topics])
    return part.groupBy(F.window(F.window_time("w"), width).alias("day")).agg(
        F.sum("articles").alias("article_count"), F.try_divide(F.sum("sentiment"), F.sum("rated")).alias("avg_sentiment"),
        F.try_divide(F.sum("negative"), F.sum("labelled")).alias("negative_share"), F.try_divide(F.sum("positive"), F.sum("labelled")).alias("positive_share"),
        *[F.sum(f"__{t}").alias(f"{t}_count") for t in topics], F.count("domain").alias("source_dispersion")
    ).withColumn("date", F.to_date("day.start")).drop("day")
