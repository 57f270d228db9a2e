"""Q01-Q06: checks on price panels, as one long report (ticker, date, type, msg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rolling import Roll, series, with_rolling
from .timeseries import flat_runs

REQUIRED = ("Open", "High", "Low", "Close", "Volume")


# Q01
def check_files(spark: SparkSession, folders: list[str], schema, required=REQUIRED) -> DataFrame:
    """Report rows for files without a readable row, or without any value in a required column (the first such).

    The file list comes from the file system alone; the columns are counted in
    one pass over the data. No file is opened on the driver.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folders).select("path")
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*folders)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("__p")).agg(*[F.count(c).alias(f"__n_{c}") for c in required])
    name = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    df = listed.select(name("path").alias("path")).join(counts.withColumn("path", name("__p")), "path", "left")
    lack = F.coalesce(*[F.when(F.col(f"__n_{c}") == 0, F.lit(c)) for c in required])
    unread = F.col("__p").isNull()
    ticker = F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    kind = F.when(unread, "LOAD_ERROR").when(lack.isNotNull(), "MISSING_COLUMNS")
    msg = F.when(unread, "no row could be read").otherwise(F.concat(F.lit("no value in column "), lack))
    return df.select(ticker.alias("ticker"), F.lit("N/A").alias("date"), kind.alias("type"), msg.alias("msg"), "path").where("type IS NOT NULL")


def prepare(panel: DataFrame, by=("ticker",), vol_rows: int = 60) -> DataFrame:
    """Row number, series length, return, the deviation before the row, and the flat run, in windows over one layout."""
    w = series(by)
    df = panel.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*by)),
                            "__prev": F.lag("close", 1).over(w)})
    df = df.withColumn("__ret", F.try_divide(F.col("close"), F.col("__prev")) - 1.0)
    df = with_rolling(df, [Roll("__vol", "std", "__ret", vol_rows, vol_rows, 1)], by)
    return flat_runs(df, by).where(F.col("__n") >= 10)


def checked(vol_rows: int = 60):
    """Rows on which the return rules apply: late enough, with a return and a deviation above 0."""
    return (F.col("__i") >= vol_rows) & F.col("__ret").isNotNull() & (F.col("__vol") > 0)


def rules(flat: int = 10, sigmas: float = 8.0, least_move: float = 0.05, jump: float = 0.40, vol_rows: int = 60) -> dict:
    """Q02-Q05: type -> (condition, message)."""
    late, r = checked(vol_rows), F.col("__ret")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: (F.floor(c * 100) / 100).cast("string")
    return {
        "FLATLINED_CLOSE": (F.col("flat_run") >= flat, say("close stays at ", number(F.col("close")), " on row ", F.col("flat_run").cast("string"), " of a flat run")),
        "RETURN_VOL_OUTLIER": (late & (F.abs(r) / F.col("__vol") > sigmas) & (F.abs(r) > least_move),
                               say("moved ", number(r * 100), "%, ", number(F.abs(r) / F.col("__vol")), " times the deviation before")),
        "PRICE_DISCONTINUITY": (late & (F.abs(r) > jump), say("close went from ", number(F.col("__prev")), " to ", number(F.col("close")), " in one row")),
        "INVALID_HIGH_LOW": (late & (F.col("high") < F.col("low")), say("high ", number(F.col("high")), " below low ", number(F.col("low")))),
        "NON_POSITIVE_PRICE": (late & (F.col("close") <= 0), say("close of ", number(F.col("close")), " is not above zero")),
    }


# Q02-Q06
def anomalies(panel: DataFrame, only=None, by=("ticker",), **limits) -> DataFrame:
    """All rules over one prepared panel; a row gives one report line per rule it breaks."""
    df = prepare(panel, by, limits.get("vol_rows", 60))
    lines = [F.when(cond, F.struct(F.lit(t).alias("type"), msg.alias("msg"))) for t, (cond, msg) in rules(**limits).items() if only is None or t in only]
    return df.withColumn("__l", F.explode(F.array_compact(F.array(*lines)))).select(*by, "date", "__l.type", "__l.msg")
