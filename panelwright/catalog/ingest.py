"""Queries S01-S16 and X01-X14."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import ingest as I, joins as J
from ..plans import tables as T
from ..session import materialise, new_folder
from ..sources import readers as R, sinks as K
from .registry import part, pick, query
from .selection import aliases


@query("S01_read_panel", pick("b_roles WHERE role <> 'broad'", "asset_class=CASE WHEN role = 'gold' THEN 'macro' ELSE 'indices' END;role;date", "open;high;low;close;volume"))
def s01(spark, sf):
    """Writes the role series as price files in two class folders and reads them back as a panel."""
    root = new_folder(spark, "prices")
    rows = materialise(T.roles(spark, sf), "roles").select(
        "role", F.col("date").cast("timestamp_ntz").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    for role in T.ROLE_BY_TYPE.values():
        cls = "macro" if role == "gold" else "indices"
        rows.where(F.col("role") == role).withColumnRenamed("role", "Ticker").write.parquet(f"{root}/{cls}/{role}")
    spark.createDataFrame([], R.PRICES).write.parquet(f"{root}/stocks")
    # the writer names files itself; the folder tells which series a file holds
    files = spark.read.schema(R.PRICES).option("recursiveFileLookup", "true").parquet(f"{root}/indices", f"{root}/macro").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1).alias("ticker"),
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("role")).distinct()
    return R.read_panel(spark, root).join(files, "ticker").drop("ticker")


part("s02", "SELECT ticker, date, coalesce(open, NULL) AS open, CASE WHEN volume >= 40 THEN close END AS close, volume FROM b_panel")


@query("S02_normalise_ohlcv", pick("s02", "ticker date", "open close volume"))
def s02(spark, sf):
    p = T.panel(spark, sf)
    odd = p.select(F.col("ticker").alias("Ticker"), F.col("date").alias("DATE"), F.col("open").alias("Open"), F.col("volume").alias("volume"),
                   F.when(F.col("volume") >= 40, F.col("close")).otherwise(float("nan")).alias("close"))
    return I.normalise_ohlcv(odd).select("ticker", "date", "open", "close", "volume")


part("s03", "SELECT ticker, date, arg_max(price, seq) AS price, max(seq) AS seq FROM b_ticks GROUP BY ticker, date")


@query("S03_dedupe_last", pick("s03", "ticker date", "price", "seq"))
def s03(spark, sf):
    t = T.ticks(spark, sf)
    supplier = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("ticker"))
    # price decides between two lines with one sequence number
    return I.dedupe_last(t.join(supplier, "l_suppkey"), ["ticker", "date"], ["seq"]).select("ticker", "date", "price", "seq")


part("s04", """SELECT ticker, date, CASE WHEN date >= DATE '2000-01-01' AND ticker <> 'N3' THEN close * 1.01 ELSE close END AS close, volume FROM b_panel WHERE date < DATE '2001-01-01'
   UNION ALL SELECT ticker, date, close * 1.01, volume FROM b_panel WHERE date >= DATE '2001-01-01' AND ticker <> 'N3'""")


@query("S04_upsert", pick("s04", "ticker date", "close volume"))
def s04(spark, sf):
    p = T.panel(spark, sf).select("ticker", "date", "close", "volume")
    delta = p.where("date >= '2000-01-01' AND ticker <> 'N3'").select("volume", (F.col("close") * 1.01).alias("close"), "date", "ticker")
    return I.upsert(p.where("date < '2001-01-01'"), delta)


@query("S05_high_water", pick("b_panel GROUP BY ticker", "ticker;last_date=max(date)"))
def s05(spark, sf):
    return I.high_water(T.panel(spark, sf))


part("s05_m", "SELECT ticker, max(date) AS m FROM b_panel WHERE date < DATE '2000-06-01' AND ticker <> 'N5' GROUP BY ticker")


@query("S05_newer_rows", pick("b_panel p LEFT JOIN s05_m m ON m.ticker = p.ticker WHERE m.m IS NULL OR p.date > m.m", "ticker=p.ticker;date=p.date", "close=p.close"))
def s05_newer(spark, sf):
    p = T.panel(spark, sf).select("ticker", "date", "close")
    return I.newer_rows(p, I.high_water(p.where("date < '2000-06-01' AND ticker <> 'N5'")))


@query("S06_write_trades_csv", pick("b_trades", "date ticker side market_state", "weight net_pnl p_bull"))
def s06(spark, sf):
    path = new_folder(spark, "trades")
    K.write_outputs(T.trade_log(spark, sf).select("date", "ticker", "side", "market_state", "weight", "net_pnl", "p_bull"), path, "csv")
    return R.read_trades(spark, path)


@query("S07_write_by_year", pick("b_features", "date ticker", "mom60", "year=year(date)"))
def s07(spark, sf):
    path = new_folder(spark, "dataset")
    K.write_outputs(T.weekly_features(spark, sf).select("date", "ticker", "mom60"), path, by_year="date")
    return spark.read.parquet(path)


part("s08", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, try_cast(o_orderpriority AS DOUBLE) AS score, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS weight FROM orders")


@query("S08_type_trades", pick("s08", "date", "score weight", "o_orderkey"))
def s08(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("score"),
                                            F.substring("o_orderpriority", 1, 1).alias("weight"))
    return R.type_trades(o)


@query("S09_sector_map", pick("customer", "ticker=c_name;sector=c_mktsegment"))
def s09(spark, sf):
    """Customers and their segments as one JSON object per line, read back as rows."""
    path = new_folder(spark, "sectors")
    T.table(spark, sf, "customer").select(F.to_json(F.create_map("c_name", "c_mktsegment")).alias("value")).write.text(path)
    return R.read_sector_map(spark, path, whole_file=False)


def write_arrays(rows, path, size=500):
    """Files of one JSON array each, of up to ``size`` successive ids."""
    fields = [c for c in rows.columns if c != "doc_id"]
    arrays = rows.groupBy(F.floor(F.col("doc_id") / size).alias("k")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("S10_json_array", pick("b_articles", "url;source;language", "", "n=length(title)"))
def s10(spark, sf):
    path = new_folder(spark, "articles")
    a = T.articles(spark, sf).select("doc_id", F.col("published_at").cast("string").alias("publishedAt"), "source", "url", "title", "language")
    write_arrays(a, path)
    return R.read_json_array(spark, path, R.ARTICLE).select("url", X.nested("source.name").alias("source"), "language", F.length("title").alias("n"))


part("s11", "SELECT upper(trim(p_name)) AS name, max(p_size) AS lot_size FROM part WHERE p_type = 'PROMO' AND p_size % 7 <> 0 GROUP BY 1")


@query("S11_lot_sizes", pick("s11", "name", "", "lot_size"))
def s11(spark, sf):
    p = T.table(spark, sf, "part")
    master = p.select(F.concat(F.lit(" "), F.col("p_name")).alias("name"), F.when(F.col("p_type") == "PROMO", "NFO").otherwise("NSE").alias("exch_seg"),
                      F.lit("FUTSTK").alias("instrumenttype"), F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("lotsize"))
    return I.lot_sizes(master)


part("s12_m", "SELECT upper(p_name) AS symbol, p_type AS ex, min(p_partkey) AS token FROM part WHERE p_size > 10 GROUP BY ALL")
part("s12", "SELECT p.p_partkey AS id, m.token FROM part p LEFT JOIN s12_m m ON m.symbol = upper(p.p_name) AND m.ex = p.p_type")


@query("S12_lookup_token", pick("s12", "", "", "id token"))
def s12(spark, sf):
    p = T.table(spark, sf, "part")
    master = p.where("p_size > 10").select(F.upper("p_name").alias("symbol"), F.col("p_type").alias("exch_seg"), F.col("p_partkey").alias("token"), F.col("p_partkey").alias("pos"))
    orders = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.col("p_name")).alias("symbol"), F.lower("p_type").alias("exchange"))
    return I.lookup_token(orders, master).select("id", "token")


part("s13", """SELECT role, arg_min(ticker, priority) AS ticker FROM (VALUES ('broad', 'n0', 1), ('risk', 'n_7', 1), ('fear', 'n_9', 2), ('gold', 'n12', 1)) AS a(role, c, priority)
  JOIN (SELECT DISTINCT ticker FROM b_panel) p ON lower(p.ticker) = a.c GROUP BY role""")


@query("S13_resolve_alias", pick("s13", "role ticker"))
def s13(spark, sf):
    return I.resolve_alias(T.panel(spark, sf), aliases(spark))


part("s14_in", """SELECT d.doc_id, split_part(text, chr(10), 1) AS title, CASE quality WHEN 1 THEN 'Established' WHEN 0 THEN 'Exploratory' ELSE 'Draft' END AS status, n_chars % 6 AS tier
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
part("s14", """SELECT doc_id::VARCHAR AS experiment_id, concat_ws('; ', CASE WHEN title = '' THEN 'missing title' END, CASE WHEN len(string_split(title, ' ')) < 2 THEN 'fewer than 2 hypotheses' END,
  CASE WHEN status = 'Draft' THEN 'invalid status' END, CASE WHEN tier NOT IN (1, 2, 3, 4) THEN 'invalid tier' END) AS violations FROM s14_in""")


@query("S14_validate_registry", pick("s14", "experiment_id violations"))
def s14(spark, sf):
    """Documents as registry entries, written and read as JSON, with the rules they break."""
    path = new_folder(spark, "registry")
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id", "left")
    words = F.split(F.substring_index("text", "\n", 1), " ")
    fields = {f: F.lit("given") for f in I.REGISTRY_FIELDS}
    fields.update({"experiment_id": F.col("doc_id").cast("string"), "title": F.substring_index("text", "\n", 1), "competing_hypotheses": words,
                   "status": F.when(F.col("quality") == 1, "Established").when(F.col("quality") == 0, "Exploratory").otherwise("Draft"),
                   "evidence_tier": F.concat(F.lit("Level "), (F.col("n_chars") % 6).cast("string"))})
    write_arrays(d.select("doc_id", *[v.alias(k) for k, v in fields.items()]), path)
    return I.validate_registry(R.read_registry(spark, path)).select("experiment_id", F.array_join("violations", "; ").alias("violations"))


part("s15", "SELECT *, CASE WHEN regime_reason LIKE '%bull%' THEN 1 ELSE 0 END AS flagged FROM b_regime WHERE date = (SELECT max(date) FROM b_regime)")


@query("S15_heartbeat", pick("s15", "date;regime;reason=regime_reason", "confidence=regime_confidence", "flagged"))
def s15(spark, sf):
    return I.heartbeat(T.weekly_regime(spark, sf), "bull")


part("s16", """SELECT event_id::VARCHAR AS run, 'run' AS section, 'name' AS name, event_type AS value FROM events UNION ALL
  SELECT event_id::VARCHAR, 'config', 'k', json_extract_string(props, '$.k') FROM events UNION ALL
  SELECT event_id::VARCHAR, 'metrics', 'user', user_id::VARCHAR FROM events""")


@query("S16_flatten_runs", pick("s16", "run section name value"))
def s16(spark, sf):
    """Events as run records: a name, nested settings and nested metrics."""
    e = T.table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("name"), F.from_json("props", "k int").alias("config"), F.struct(F.col("user_id").alias("user")).alias("metrics")))
    return R.flatten_runs(e.select(F.col("event_id").cast("string").alias("run"), body.alias("body")))


@query("X01_safe_name", pick("part", "name=lower(translate(p_name || ' - ' || p_brand, ' -', '__'))", "", "p_partkey"))
def x01(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select(X.safe_name(F.concat_ws(" - ", "p_name", "p_brand")).alias("name"), "p_partkey")


@query("X02_url_host", pick("pages", "host=lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))", "", "page_id"))
def x02(spark, sf):
    return T.table(spark, sf, "pages").select(X.url_host("url").alias("host"), "page_id")


@query("X03_text_id", pick("pages", "id=substr(sha256(url), 1, 24)", "", "page_id"))
def x03(spark, sf):
    return T.table(spark, sf, "pages").select(X.text_id("url").alias("id"), "page_id")


# words that occur in the given prose stand for the topic lists
LEXICON = {"india": ["ation", "der "], "policy": ["thou", "eaux"], "inflation": ["ering", "ción"], "growth": ["inon", "ung "],
           "banking": ["nder", "ouen"], "oil": ["tith", "lee"], "global_risk": ["worth", "ierre"]}
WEIGHTS = {"india": 1.5, "policy": 1.0, "inflation": 1.0, "growth": 0.5, "banking": 0.75, "oil": 0.5, "global_risk": 1.25}
BLOCKED = ["lyesha", "ñaña"]


def hit_sql(text, words):
    return f"coalesce(regexp_matches(lower({text}), '{'|'.join(sorted(words))}'), FALSE)"


@query("X04_keyword_hit", pick("documents", "", "", ";".join(f"{t}={hit_sql('text', w)}" for t, w in LEXICON.items()) + ";doc_id"))
def x04(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", *[X.keyword_hit("text", w).alias(t) for t, w in LEXICON.items()])


@query("X05_weighted_sum", pick("part", "", "points=1.5 * p_size + 0.25 * p_retailprice", "p_partkey"))
def x05(spark, sf):
    return T.table(spark, sf, "part").select(X.weighted_sum({"p_size": 1.5, "p_retailprice": 0.25}).alias("points"), "p_partkey")


@query("X06_article_text", pick("b_articles", "text=trim(title || '. ' || description)", "", "doc_id"))
def x06(spark, sf):
    return T.articles(spark, sf).select(X.article_text("title", "description").alias("text"), "doc_id")


@query("X07_squash", pick("b_features", "ticker date", "c=least(greatest(fip, -0.3), 0.3);g=greatest(mom5, 0);l=-least(mom5, 0);t=tanh(mom60);e=ln(1 + abs(mom20));z=CASE WHEN vol20_z IS NOT NULL THEN least(greatest(vol20_z, 0), 1) END"))
def x07(spark, sf):
    f = T.weekly_features(spark, sf)
    return f.select("ticker", "date", X.clip("fip", -0.3, 0.3).alias("c"), X.gain("mom5").alias("g"), X.loss("mom5").alias("l"),
                    F.tanh("mom60").alias("t"), F.log1p(F.abs("mom20")).alias("e"), X.clip("vol20_z", 0.0, 1.0).alias("z"))


@query("X08_interpolate", pick("b_regime", "date", "y=CASE WHEN vix <= 22 THEN 1.0 WHEN vix <= 25 THEN 1.0 - (vix - 22) / 3 * 0.5 WHEN vix <= 28 THEN 0.5 - (vix - 25) / 3 ELSE -0.5 END;"))
def x08(spark, sf):
    return T.weekly_regime(spark, sf).select("date", X.interpolate("vix", (22.0, 25.0, 28.0), (1.0, 0.5, -0.5)).alias("y"))


@query("X09_softmax", pick("b_regime", "date", ";".join(f"s{i}=exp({c} / 2) / (exp(p_bull / 2) + exp(p_chop / 2) + exp(p_bear / 2))" for i, c in enumerate(("p_bull", "p_chop", "p_bear")))))
def x09(spark, sf):
    s = X.softmax(["p_bull", "p_chop", "p_bear"], 2.0)
    return T.weekly_regime(spark, sf).select("date", *[c.alias(f"s{i}") for i, c in enumerate(s)])


@query("X10_sigmoid", pick("b_features", "ticker date", "s=1 / (1 + exp(-mom60_z));"))
def x10(spark, sf):
    return T.weekly_features(spark, sf).select("ticker", "date", X.sigmoid("mom60_z").alias("s"))


@query("X11_argmax_label", pick("b_regime", "date;label=CASE WHEN p_bull >= p_chop AND p_bull >= p_bear THEN 'BULL' WHEN p_chop >= p_bear THEN 'CHOP' ELSE 'BEAR' END"))
def x11(spark, sf):
    return T.weekly_regime(spark, sf).select("date", X.argmax_label([("BULL", "p_bull"), ("CHOP", "p_chop"), ("BEAR", "p_bear")]).alias("label"))


@query("X12_date_parts", pick("b_cal", "date;ym=strftime(date, '%Y-%m')", "", "y=year(date);friday=isodow(date) = 5"))
def x12(spark, sf):
    return T.trading_days(spark, sf).select("date", X.month_key("date").alias("ym"), F.year("date").alias("y"), X.is_friday("date").alias("friday"))


@query("X13_nested", pick("b_articles", "name=CASE WHEN source = 'src1' THEN '' ELSE source END", "", "doc_id"))
def x13(spark, sf):
    a = T.articles(spark, sf).withColumn("source", F.when(F.col("source.name") != "src1", F.col("source")))
    return a.select(X.nested("source.name").alias("name"), "doc_id")


part("x14", """SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DELIVERY' WHEN '2' THEN 'CARRYFORWARD' ELSE 'INTRADAY' END AS product,
  round_even(o_totalprice / 100 * CASE WHEN o_orderstatus = 'F' THEN 1 + 0.005 ELSE 1 - 0.005 END * 20.0, 0) / 20.0 AS price FROM orders""")


@query("X14_limit_price", pick("x14", "product", "price", "o_orderkey"))
def x14(spark, sf):
    o = T.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "MOMENTUM_CASH").when(F.col("o_orderpriority").startswith("2"), "MEAN_REV_DERIV").otherwise("OTHER")
    side = F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell")
    return o.select("o_orderkey", X.product_type(kind).alias("product"), X.limit_price(F.col("o_totalprice") / 100, side, 0.005).alias("price"))
