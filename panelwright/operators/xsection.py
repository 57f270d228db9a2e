"""Statistics and ranks across the names of a date.

The names of one date are not bounded, so no date is put into one task as a
whole. Means and deviations are grouped aggregates joined back by date. Ranks
and quantiles first count equal values, and the distinct values of a large
date are cut into ranges that are ordered apart and added up. Only where every
group is counted and found small is it ordered directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

DATE = ("date",)
SPLIT_ROWS = 100_000  # distinct values of one group ordered by a single task
PIECES = 32
SAMPLE = 2048  # values drawn from a large group to place its cuts


def group_stats(df: DataFrame, x, stats: dict) -> DataFrame:
    """Aggregates over ``x`` attached to each row."""
    side = df.groupBy(*x).agg(*[v.alias(k) for k, v in stats.items()])
    if tuple(x) == DATE:
        side = F.broadcast(side)  # one row per day
    return df.join(side, list(x))


# W19
def cs_z(df: DataFrame, cols, x=DATE) -> DataFrame:
    """Distance from the date's mean in deviations (+1e-9); adds ``cs_z_<col>``."""
    stats = {}
    for c in cols:
        stats[f"__m_{c}"], stats[f"__d_{c}"] = F.avg(c), F.stddev_samp(c)
    out = group_stats(df, x, stats)
    out = out.withColumns({f"cs_z_{c}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__d_{c}") + 1e-9) for c in cols})
    return out.drop(*stats)


def largest(rows: DataFrame, keys) -> int:
    """Rows of the largest group of a stored table: one number, from counts made where the rows are read."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ordered_values(rows: DataFrame, keys, value: str = "value", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """For each group and distinct value: rows with it, rows below it, rows in all.

    Groups of more than ``split_rows`` distinct values are cut into ranges that
    different tasks order. The cuts are taken from a sample chosen by the hash
    of the value and the group's exact size, so every evaluation of the plan
    makes the same cuts; any cuts give the same counts. ``rows`` must be a
    stored table, since it is read several times.
    """
    keys = list(keys)
    vals = materialise(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_at")), "counted-values")
    sizes = vals.groupBy(*keys).agg(F.sum("n_at").alias("n"), F.count("*").alias("__m"))
    large = sizes.where(F.col("__m") > split_rows).select(*keys, "__m")
    chance = F.pmod(F.xxhash64(value), F.lit(1 << 30)) / float(1 << 30)
    drawn = vals.join(large, keys).where(chance < F.lit(float(SAMPLE)) / F.col("__m"))
    sample = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__s"))
    step = F.greatest(F.floor(F.size("__s") / PIECES), F.lit(1)).cast("int")
    cuts = sample.select(*keys, F.filter("__s", lambda v, i: (i + 1) % step == 0).alias("__cuts"))
    sizes = sizes.drop("__m").join(cuts, keys, "left")
    cut = vals.join(sizes, keys).withColumn(
        "__piece", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))).drop("__cuts")
    cut = cut.withColumn("__piece", F.greatest("__piece", F.lit(0)))
    pieces = cut.groupBy(*keys, "__piece").agg(F.sum("n_at").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("__in", F.coalesce(F.sum("n_at").over(inside), F.lit(0)))
    out = out.join(pieces, [*keys, "__piece"])
    return out.withColumn("n_below", F.col("__in") + F.col("__below")).select(*keys, value, "n_at", "n_below", "n")


# W20
def cs_rank(df: DataFrame, cols, x=DATE, ids=("ticker",), split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Percentile rank of each column among the date's known values, ties averaged.

    ``cols``: output -> (column, ascending). All columns are ranked together as
    rows of (date, feature, value). Those rows are stored first: ranks find
    their rows again by value, and a value computed twice may differ in its
    last bit when sums arrive in another order. Where no group has more than ``split_rows`` rows (counted first)
    each is ordered as it is; larger ones go by counted values and ranges. Both give the same ranks.
    """
    keys, feature = [*x], "__feature"
    sources = sorted({c for c, _ in cols.values()})
    long = df.select(*keys, *ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias(feature), (F.col(c).cast("double") + 0.0).alias("value")) for c in sources])).alias("__s"))
    long = materialise(long.select(*keys, *ids, f"__s.{feature}", "__s.value").where(F.col("value").isNotNull()), "ranked-values")
    group = [*keys, feature]
    if largest(long, group) <= split_rows:
        w = Window.partitionBy(*group)
        ranked = long.withColumns({"n_below": F.rank().over(w.orderBy("value")) - 1, "n_at": F.count("*").over(Window.partitionBy(*group, "value")), "n": F.count("*").over(w)})
    else:
        ranked = long.join(ordered_values(long, group, "value", split_rows), [*group, "value"])
    mid = (F.col("n_at") + 1) / 2.0
    rising = (F.col("n_below") + mid) / F.col("n")
    falling = (F.col("n") - F.col("n_below") - F.col("n_at") + mid) / F.col("n")
    picks = [F.max(F.when(F.col(feature) == c, rising if asc else falling)).alias(o) for o, (c, asc) in cols.items()]
    wide = ranked.groupBy(*keys, *ids).agg(*picks)
    return df.join(wide, [*keys, *ids], "left")


def quantiles(df: DataFrame, col: str | None, wanted: dict, x=DATE, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Exact quantiles per group with linear interpolation. ``wanted``: output -> share of ``col``, or -> (column, share).

    Picks the two order statistics around position q*(n-1) out of the counted
    values instead of holding a whole group in one buffer. Several columns go through one pass, as rows of
    (group, feature, value). To compare rows with a quantile, take both from one stored table.
    """
    asked = {out: q if isinstance(q, tuple) else (col, q) for out, q in wanted.items()}
    feature = "__feature"
    values = F.array(*[F.struct(F.lit(c).alias(feature), (F.col(c).cast("double") + 0.0).alias("value")) for c in sorted({c for c, _ in asked.values()})])
    rows = materialise(df.select(*x, F.explode(values).alias("__s")).select(*x, f"__s.{feature}", "__s.value"), "quantile-values")
    group = [*x, feature]
    if largest(rows, group) <= split_rows:
        w, seen = Window.partitionBy(*group), rows.where("value IS NOT NULL")
        order = seen.withColumns({"n_below": F.row_number().over(w.orderBy("value")) - 1, "n_at": F.lit(1), "n": F.count("*").over(w)})
    else:
        order = ordered_values(rows, group, "value", split_rows)
    aggs = []
    for out, (c, q) in asked.items():
        mine = F.col(feature) == c
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        held = lambda p, mine=mine: mine & (F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n_at"))
        aggs += [F.max(F.when(held(lo), F.col("value"))).alias(f"__lo_{out}"),
                 F.max(F.when(held(hi), F.col("value"))).alias(f"__hi_{out}"),
                 F.max(F.when(mine, pos - lo)).alias(f"__w_{out}")]
    got = order.groupBy(*x).agg(*aggs)
    return got.select(*x, *[(F.col(f"__lo_{o}") + (F.col(f"__hi_{o}") - F.col(f"__lo_{o}")) * F.col(f"__w_{o}")).alias(o)
                            for o in asked])


# K01
def top_k(df: DataFrame, score: str, k: int, x=DATE, tie: str = "ticker", rank: str | None = None) -> DataFrame:
    """Best ``k`` names of each date. The rank filter is applied before the shuffle as well,
    so each task sends at most ``k`` rows per date."""
    w = Window.partitionBy(*x).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


# K02
def extreme_trades(df: DataFrame, k: int = 10, col: str = "net_pnl") -> DataFrame:
    """The ``k`` best and the ``k`` worst active trades."""
    best = df.orderBy(F.col(col).desc(), "date", "ticker").limit(k).withColumn("kind", F.lit("best"))
    worst = df.orderBy(F.col(col).asc(), "date", "ticker").limit(k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


# K03
def latest(df: DataFrame, date: str = "date") -> DataFrame:
    newest = df.agg(F.max(date).alias("d"))
    return df.where(F.col(date) == newest.scalar())


# K04
def last_rows(df: DataFrame, k: int, order=("date",)) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(k)


# K05
def topk_mean(df: DataFrame, score: str, ret: str, k: int = 20, x=DATE) -> DataFrame:
    known = df.where(F.col(score).isNotNull())
    return top_k(known, score, k, x).groupBy(*x).agg(F.avg(ret).alias("mean_ret"), F.count("*").alias("names"))


# K06
def margin(cols) -> Column:
    """Gap between the largest and the second largest value."""
    ordered = F.sort_array(F.array(*[F.col(c) for c in cols]), asc=False)
    return ordered[0] - ordered[1]
