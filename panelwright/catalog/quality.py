"""Queries Q01-Q06."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..plans import tables as T
from ..session import new_folder
from ..sources.readers import PRICES
from .registry import part, pick, query

TK = "PARTITION BY ticker ORDER BY date"
# closes on a coarse grid give unchanged prices; some days get a zero price, thin days a high below the low
part("q_in", "SELECT ticker, date, CASE WHEN volume < 30 THEN low ELSE high END AS high, CASE WHEN volume < 30 THEN high ELSE low END AS low, CASE WHEN volume % 89 = 0 THEN 0 ELSE greatest(round(close / 4000), 1) END AS close, volume FROM b_panel")
part("q_r", f"SELECT *, row_number() OVER ({TK}) - 1 AS i, lag(close) OVER ({TK}) AS prev, close / nullif(lag(close) OVER ({TK}), 0) - 1 AS ret FROM q_in")
part("q_v", f"""SELECT *, CASE WHEN count(ret) OVER ({TK} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 60 THEN stddev_samp(ret) OVER ({TK} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS vol,
  CASE WHEN close = prev AND volume > 0 THEN 1 ELSE 0 END AS same FROM q_r""")
part("q_f", f"SELECT *, sum(same) OVER (PARTITION BY ticker, island ORDER BY date) AS flat FROM (SELECT *, sum(1 - same) OVER ({TK}) AS island FROM q_v)")
LATE = "i >= 60 AND ret IS NOT NULL AND vol > 0"
RULES = {"FLATLINED_CLOSE": "flat >= 4", "RETURN_VOL_OUTLIER": f"{LATE} AND abs(ret) / vol > 3 AND abs(ret) > 0.05", "PRICE_DISCONTINUITY": f"{LATE} AND abs(ret) > 0.40",
         "INVALID_HIGH_LOW": f"{LATE} AND high < low", "NON_POSITIVE_PRICE": f"{LATE} AND close <= 0"}
def two(x):
    return f"CAST(floor(({x}) * 100) / 100 AS VARCHAR)"


MESSAGES = {
    "FLATLINED_CLOSE": f"concat('close stays at ', {two('close')}, ' on row ', CAST(flat AS BIGINT), ' of a flat run')",
    "RETURN_VOL_OUTLIER": f"concat('moved ', {two('ret * 100')}, '%, ', {two('abs(ret) / vol')}, ' times the deviation before')",
    "PRICE_DISCONTINUITY": f"concat('close went from ', {two('prev')}, ' to ', {two('close')}, ' in one row')",
    "INVALID_HIGH_LOW": f"concat('high ', {two('high')}, ' below low ', {two('low')})", "NON_POSITIVE_PRICE": f"concat('close of ', {two('close')}, ' is not above zero')"}
part("q06", " UNION ALL ".join(f"SELECT ticker, date, '{t}' AS type, {MESSAGES[t]} AS msg FROM q_f WHERE {c}" for t, c in RULES.items()))


def dirty(spark, sf):
    p = T.panel(spark, sf)
    thin = F.col("volume") < 30
    return p.select("ticker", "date", F.when(thin, F.col("low")).otherwise(F.col("high")).alias("high"),
                    F.when(thin, F.col("high")).otherwise(F.col("low")).alias("low"), F.when(F.col("volume") % 89 == 0, 0.0).otherwise(F.greatest(F.round(F.col("close") / 4000), F.lit(1.0))).alias("close"), "volume")


def write_bytes(spark, path: str, data: bytes) -> None:
    """A file of given bytes in any store Spark can write to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(data)
    stream.close()


def report(spark, sf, only=None):
    return Q.anomalies(dirty(spark, sf), only, flat=4, sigmas=3.0)


# the years of the panel as files: all columns in a, no volume in b, no file of prices in c
part("q01", """SELECT DISTINCT year(date) AS y FROM b_panel""")


@query("Q01_check_files", """SELECT 'b' AS folder, 'MISSING_COLUMNS' AS type, 'no value in column Volume' AS msg, count(*)::BIGINT AS files FROM q01
   UNION ALL SELECT 'c', 'LOAD_ERROR', 'no row could be read', 1""")
def q01(spark, sf):
    """The panel as price files in two folders, a file per year, one folder without its volume column, and a file that is not Parquet."""
    root = new_folder(spark, "files")
    p = T.panel(spark, sf).select(F.col("date").cast("timestamp_ntz").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    year = F.year("Date").alias("y")
    p.select("*", year).repartition("y").write.partitionBy("y").parquet(f"{root}/a")
    p.drop("Volume").select("*", year).repartition("y").write.partitionBy("y").parquet(f"{root}/b")
    write_bytes(spark, f"{root}/c/broken.parquet", b"not a table")
    found = Q.check_files(spark, [f"{root}/a", f"{root}/b", f"{root}/c"], PRICES)
    return found.groupBy(F.regexp_extract("path", r"/(a|b|c)/(?:y=[0-9]+/)?[^/]+$", 1).alias("folder"), "type", "msg").agg(F.count("*").alias("files"))


for _id, _kinds in {"Q02_flatlined": ["FLATLINED_CLOSE"], "Q03_return_outlier": ["RETURN_VOL_OUTLIER"], "Q04_discontinuity": ["PRICE_DISCONTINUITY"],
                    "Q05_invalid_prices": ["INVALID_HIGH_LOW", "NON_POSITIVE_PRICE"], "Q06_anomaly_report": list(RULES)}.items():
    def _run(spark, sf, kinds=_kinds):
        return report(spark, sf, kinds).select("ticker", "date", "type", "msg")
    query(_id, pick("q06", "ticker date type msg", "", "", "type IN (" + ", ".join(f"'{k}'" for k in _kinds) + ")"))(_run)
