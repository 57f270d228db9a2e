"""Reading price folders, trade logs, maps and JSON collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ingest import REGISTRY_FIELDS, normalise_ohlcv

CLASSES = ("stocks", "indices", "macro")
# fixed values: columns of the trade log
TRADE_DATES = ("date", "signal_date", "exit_date")
TRADE_TEXT = ("ticker", "market_state", "decision_reason", "structure_tag", "side", "sleeve")
TRADE_NUMBERS = ("close", "entry_price", "weight", "gross_weight", "fwd_return", "net_pnl", "leverage_mult", "kinetic_energy", "regime_confidence",
                 "regime_score", "breadth", "macro_score", "news_bias", "suppression_score", "p_bull", "p_chop", "p_bear", "transition_risk", "mom_z",
                 "break_score", "score", "long_score", "short_score", "nifty_vol", "efficiency", "universe_size")
PRICES = T.StructType([T.StructField("Date", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close")]
                      + [T.StructField("Volume", T.DoubleType()), T.StructField("Ticker", T.StringType())])


# S01
def read_panel(spark: SparkSession, root: str, schema: T.StructType | None = None, classes=CLASSES, skip_unreadable: bool = False) -> DataFrame:
    """All price files below ``root`` as one long panel.

    A file that cannot be read fails the scan. With ``skip_unreadable`` such files are left
    out; ``quality.check_files`` lists them, and a caller should look at that list.

    The ticker is the file name, the asset class the folder. With a schema
    (default ``PRICES``) no footer is read on the driver; column names are
    matched without regard to case.
    """
    parts = []
    for c in classes:
        df = (spark.read.schema(schema or PRICES).option("ignoreCorruptFiles", str(skip_unreadable).lower())
              .option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{root}/{c}"))
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
        df = df.select(*[x for x in df.columns if x.lower() != "ticker"], name.alias("Ticker"))
        parts.append(normalise_ohlcv(df).withColumn("asset_class", F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# S08
def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """A trade log in CSV: dates parsed, numbers coerced, what does not parse is NULL. Columns may be absent or reordered."""
    raw = spark.read.option("header", "true").csv(path)
    return type_trades(raw)


def type_trades(raw: DataFrame) -> DataFrame:
    cols = []
    for c in raw.columns:
        if c in TRADE_DATES:
            cols.append(F.col(c).try_cast("timestamp").cast("date").alias(c))
        elif c in TRADE_NUMBERS:
            x = F.col(c).try_cast("double")
            cols.append(F.when(~F.isnan(x), x).alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols)


# S09
def read_sector_map(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """JSON objects of ticker -> sector as rows: one object per file, or one per line."""
    text = spark.read.text(path, wholetext=whole_file)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("ticker", "sector"))


# S10
def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


REGISTRY = ", ".join(f"{c} {'array<string>' if c == 'competing_hypotheses' else 'string'}" for c in REGISTRY_FIELDS)
# fixed values: columns of the article feed
ARTICLE = "publishedAt string, source struct<id: string, name: string>, url string, title string, description string, language string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, REGISTRY)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Raw articles with their nested source name taken out."""
    raw = read_json_array(spark, path, ARTICLE)
    return raw.select(F.col("publishedAt").try_cast("timestamp").alias("published_at"), F.coalesce("source.name", F.lit("")).alias("source"),
                      F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
                      F.coalesce("description", F.lit("")).alias("description"), F.coalesce("language", F.lit("en")).alias("language"))


# S16
def flatten_runs(records: DataFrame) -> DataFrame:
    """Run records (run, body: JSON text) in long form: run, section, name, value; top-level values under section ``run``."""
    sections = records.select("run", F.explode(F.from_json("body", "map<string,string>")).alias("section", "text"))
    nested = F.col("text").startswith("{")
    pairs = F.when(nested, F.from_json("text", "map<string,string>")).otherwise(F.create_map("section", "text"))
    return sections.select("run", F.when(nested, F.col("section")).otherwise("run").alias("section"), F.explode(pairs).alias("name", "value"))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON file each, named by run."""
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return flatten_runs(text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("run"), F.col("value").alias("body")))
