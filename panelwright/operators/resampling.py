"""Resampling and multiple-testing checks, as joins and grouped sums.

Random numbers are md5 hashes of (seed, replication, position), so every task
and every engine draws the same. A return series, no longer than the calendar, travels as one
array, and a replication is a fold over it; the number of replications, block lengths and
of strategies only adds rows.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import running
from ..functions.scalar import hash_uniform, let
from ..session import materialise

STRATEGY = ("strategy",)


def numbered(r: DataFrame, by=STRATEGY) -> DataFrame:
    """Position from 0 and length of each series."""
    w = Window.partitionBy(*by)
    return r.withColumns({"pos": F.row_number().over(w.orderBy("date")) - 1, "n": F.count("*").over(w)})


#: Replications that one task draws and folds together.
CHUNK = 50


def _uniform(text: Column, at: Column | int) -> Column:
    """The number in [0, 1) of eight hexadecimal digits from a place on (from 1)."""
    return F.conv(F.substr(text, at if isinstance(at, Column) else F.lit(at), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def _hashes(last: Column, *key: Column) -> Column:
    """The md5 of the key and each number from 0 to ``last``."""
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda q: F.md5(F.concat_ws("|", *[c.cast("string") for c in key], q.cast("string"))))


def resampled(series: DataFrame, reps: int, blocks=(8.0,), seed: str = "42") -> DataFrame:
    """Stationary bootstrap of whole series: ``series`` (with ``n``, its length) times block length and replication, with ``draw``.

    ``draw`` is one array of source positions. At each place a new block starts with probability 1/block, at a random position, and runs on,
    wrapping at the end. Whether a block starts comes from a quarter of an md5 (each hash serves four places), where it starts from an md5 of its own that
    is taken at block starts only. Draws do not depend on the series, so all series of a length meet the same ones. Rows are dealt out by
    chunks of replications before anything is drawn; nothing else is shuffled.
    """
    spark = series.sparkSession
    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // CHUNK)))
    rows = series.withColumn("block", F.explode(F.array(*[F.lit(float(b)) for b in blocks]))).withColumn("__chunk", chunks)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.hash(*[F.col(c) for c in rows.columns]))
    first = F.col("__chunk") * CHUNK
    rows = rows.withColumn("rep", F.explode(F.sequence(first, F.least(first + CHUNK, F.lit(reps)) - 1))).drop("__chunk")
    start = lambda i: F.floor(hash_uniform(F.lit(seed), F.lit("s"), "rep", i) * F.col("n")).cast("int")
    # the places at which blocks start, then each block once
    places = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    opens = lambda hashes, i: (i == 0) | (_uniform(F.get(hashes, F.floor(i / 4).cast("int")), (i % 4) * 8 + 1) < 1.0 / F.col("block"))
    opening = let(_hashes(F.floor((F.col("n") - 1) / 4), F.lit(seed), F.lit("p"), F.col("rep")), lambda h: F.filter(places, lambda i: opens(h, i)))
    length = lambda at, k, i: F.coalesce(F.get(at, k + 1), F.col("n").cast("int")) - i
    run = lambda at, size: F.transform(F.sequence(at, at + size - 1), lambda p: p % F.col("n").cast("int"))
    draw = let(opening, lambda at: F.flatten(F.transform(at, lambda i, k: let(start(i), lambda s: run(s, length(at, k, i))))))
    return rows.withColumn("draw", draw)


def _as_arrays(r: DataFrame, value: str, by=STRATEGY) -> DataFrame:
    """One row per series: its values in order of date (as long as the calendar at most) and their number."""
    ordered = F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("x"))))
    return r.groupBy(*by).agg(F.transform(ordered, lambda s: s["x"]).alias("__x"), F.count("*").alias("n"))


# B01
def block_bootstrap(r: DataFrame, block: float | tuple = 8.0, reps: int = 3000, seed: str = "42", by=STRATEGY, ret: str = "portfolio_return") -> DataFrame:
    """Sharpe, CAGR (%) and deepest drawdown (%) of each replication, for one block length or several (then with a column ``block``)."""
    lengths = block if isinstance(block, (tuple, list)) else (block,)
    drawn = resampled(_as_arrays(r, ret, by), reps, lengths, seed).withColumn("__d", F.transform("draw", lambda p: F.get("__x", p)))
    zero = F.lit(0.0)
    first = F.struct(F.lit(1.0).alias("nav"), zero.alias("peak"), zero.alias("dd"), zero.alias("s"))

    def walk(a: Column, x: Column) -> Column:
        nav = a["nav"] * (1.0 + x)
        peak = F.greatest(a["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(a["dd"], (nav - peak) / peak).alias("dd"), (a["s"] + x).alias("s"))

    deviation = lambda d, p: F.aggregate(d, zero, lambda a, x: a + (x - p["s"] / F.col("n")) * (x - p["s"] / F.col("n")))
    figures = let(F.col("__d"), lambda d: let(F.aggregate(d, first, walk), lambda p: F.struct(p["nav"].alias("nav"), p["dd"].alias("dd"), p["s"].alias("s"), deviation(d, p).alias("q"))))
    drawn = drawn.withColumn("__p", figures)
    mean, nav = F.col("__p.s") / F.col("n"), F.col("__p.nav")
    sd = F.sqrt(F.try_divide(F.col("__p.q"), F.col("n") - 1))
    out = {"sharpe": F.when(sd > 0, mean / sd * math.sqrt(52.0)).otherwise(0.0),
           "cagr": F.when(nav > 0, (F.pow(F.greatest(nav, F.lit(1e-300)), 52.0 / F.col("n")) - 1.0) * 100).otherwise(-100.0), "max_dd": F.col("__p.dd") * 100}
    return drawn.select(*by, *(["block"] if lengths is block else []), "rep", *[c.alias(o) for o, c in out.items()])


def bootstrap_summary(paths: DataFrame, by=STRATEGY) -> DataFrame:
    """Means and 95% bounds over replications; one row per replication went in, so groups are as large as ``reps``."""
    out = []
    for c in ("sharpe", "cagr", "max_dd"):
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.025).alias(f"{c}_low"), F.percentile(c, 0.975).alias(f"{c}_high")]
    return paths.groupBy(*by).agg(*out)


# B02
EULER = 0.5772156649
#: Terms of the series of the normal distribution function, and where it is 0 or 1 to the last place.
CDF_TERMS, CDF_END = 160, 8.5


def normal_cdf(t: Column) -> Column:
    """1/2 + density * (t + t^3 / 3 + t^5 / (3 * 5) + ...)."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(CDF_TERMS)), F.struct(t.alias("term"), t.alias("sum")),
        lambda a, k: F.struct((a["term"] * t * t / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * t * t / (2 * k + 1)).alias("sum")), lambda a: a["sum"])
    return F.when(t < -CDF_END, 0.0).when(t > CDF_END, 1.0).otherwise(0.5 + series * F.exp(-t * t / 2) / math.sqrt(2 * math.pi))


def deflated_sharpe(r: DataFrame, trials: int = 50, by=STRATEGY, ret: str = "portfolio_return", published: bool = True) -> DataFrame:
    """Probability that a strategy's Sharpe beats the best of ``trials`` chance results.

    The spread of chance results is that of the other strategies' Sharpes.
    The published variance term is (kurtosis-1)/4; the other form uses excess
    kurtosis/4.
    """
    x = F.col(ret)
    one = r.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    one = one.withColumn("sr", F.coalesce(F.try_divide("m", "sd"), F.lit(0.0))).withColumn("ann_sharpe", F.col("sr") * math.sqrt(52.0))
    # sums over all strategies give each one the variance of the others
    total = one.agg(F.struct(F.count("*").alias("k"), F.sum("ann_sharpe").alias("s"), F.sum(F.col("ann_sharpe") ** 2).alias("q")).alias("t")).scalar()
    k, s, q = total.k - 1, total.s - F.col("ann_sharpe"), total.q - F.col("ann_sharpe") ** 2
    one = one.withColumn("others_var", F.greatest(F.coalesce(F.try_divide(q, k) - F.try_divide(s, k) ** 2, F.lit(0.0)), F.lit(0.0)))
    nd = NormalDist()
    z = (1 - EULER) * nd.inv_cdf(1 - 1 / trials) + EULER * nd.inv_cdf(1 - 1 / (trials * math.e))
    sr0 = F.sqrt(F.col("others_var") / 52.0) * z
    excess = (F.col("kurt") + 2.0) / 4.0 if published else F.col("kurt") / 4.0
    var = (1.0 - F.col("skew") * F.col("sr") + excess * F.col("sr") ** 2) / (F.col("n") - 1.0)
    one = one.withColumns({"sr0": sr0 * math.sqrt(52.0), "t_stat": (F.col("sr") - sr0) / F.sqrt(var)})

    return one.withColumn("dsr", normal_cdf(F.col("t_stat"))).select(*by, "n", "ann_sharpe", "skew", "kurt", "sr0", "t_stat", "dsr")


# B03
def pbo_splits(spark, blocks: int = 8) -> DataFrame:
    """Every way to take half the blocks for training: (split, block, train). 560 rows for 8 blocks."""
    rows = []
    for split, chosen in enumerate(itertools.combinations(range(blocks), blocks // 2)):
        rows += [(split, b, b in chosen) for b in range(blocks)]
    return spark.createDataFrame(rows, "split int, block int, train boolean")


def pbo_ranks(r: DataFrame, blocks: int = 8, ret: str = "portfolio_return") -> DataFrame:
    """Out-of-sample rank share of each split's in-sample winner. Expects the same dates for all strategies.

    Blocks are reduced to count, sum and sum of squares, so the splits only
    add up a few numbers per strategy.
    """
    base = numbered(r)
    block = F.least(F.floor(F.col("pos") / F.floor(F.col("n") / blocks)), F.lit(blocks - 1)).cast("int")
    x = F.col(ret)
    parts = base.groupBy("strategy", block.alias("block")).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    sums = parts.join(F.broadcast(pbo_splits(r.sparkSession, blocks)), "block").groupBy("split", "strategy", "train").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sums = sums.withColumn("sr", F.try_divide(F.col("s") / F.col("n"), F.sqrt(F.greatest(var, F.lit(0.0)))) * math.sqrt(52.0))
    both = sums.groupBy("split", "strategy").agg(F.max(F.when(F.col("train"), F.col("sr"))).alias("train_sr"), F.max(F.when(~F.col("train"), F.col("sr"))).alias("test_sr"))
    # the first strategy by name wins a tie in the sample; picked in one aggregate, since a figure
    # summed twice may differ in its last bit and would not be found again
    top = F.min(F.struct((-F.col("train_sr")).alias("loss"), "strategy", "test_sr")).alias("t")
    best = both.groupBy("split").agg(top).select("split", F.col("t.strategy").alias("best"), F.col("t.test_sr").alias("best_sr"))
    other = F.col("strategy") != F.col("best")
    below = other & ((F.col("test_sr") < F.col("best_sr")) | ((F.col("test_sr") == F.col("best_sr")) & (F.col("strategy") < F.col("best"))))
    ranked = both.join(F.broadcast(best), "split").groupBy("split").agg(
        F.first("best").alias("best"), F.count_if(below).alias("__r"), F.count("*").alias("__m"))
    return ranked.select("split", "best", (F.col("__r") / (F.col("__m") - 1.0)).alias("rank_pct"))


def pbo(r: DataFrame, blocks: int = 8, ret: str = "portfolio_return") -> DataFrame:
    """Share of splits whose winner falls into the lower half out of sample."""
    return pbo_ranks(r, blocks, ret).agg((F.avg((F.col("rank_pct") < 0.5).cast("double")) * 100).alias("pbo"), F.avg("rank_pct").alias("avg_rank"), F.count("*").alias("splits"))


# B04
def reality_check(r: DataFrame, bench: str, champion: str, reps: int = 2000, block: float = 8.0, seed: str = "42", ret: str = "portfolio_return") -> DataFrame:
    """p-values of White's check and Hansen's test for a champion against a benchmark.

    All strategies are resampled with the same positions. Expects common dates.
    """
    side = r.where(F.col("strategy") == bench).select("date", F.col(ret).alias("__b"))
    ex = r.where(F.col("strategy") != bench).join(F.broadcast(side), "date").select("strategy", "date", (F.col(ret) - F.col("__b")).alias("x"))
    actual = ex.groupBy("strategy").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count("x").alias("n"))
    # a strategy far below the benchmark is not recentred
    actual = actual.withColumn("centre", F.when(F.col("mean") < -F.sqrt(F.col("var") / F.col("n")) * 2.0, 0.0).otherwise(F.col("mean")))
    drawn = resampled(_as_arrays(ex, "x"), reps, (block,), seed)
    means = drawn.select("rep", "strategy", (F.aggregate("draw", F.lit(0.0), lambda s, p: s + F.get("__x", p)) / F.col("n")).alias("boot"))
    tops = means.join(actual, "strategy").groupBy("rep").agg(F.max(F.col("boot") - F.col("mean")).alias("white"), F.max(F.col("boot") - F.col("centre")).alias("spa"))
    champ = actual.where(F.col("strategy") == champion).select("mean").scalar()
    return tops.agg(F.avg((F.col("white") >= champ).cast("double")).alias("white_p"), F.avg((F.col("spa") >= champ).cast("double")).alias("spa_p"), F.count("*").alias("reps"))


# B05
#: Parts of a date's names that are numbered apart.
PARTS = 16


def numbered_names(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every name of a date with a place from 0 (``pos``) and the number of names (``n``).

    Names are ordered by a hash part and the name; a part's first place comes from the parts' counts, so no date is one task.
    """
    rows = df.withColumn("__part", F.floor(hash_uniform("ticker") * parts).cast("int"))
    one = Window.partitionBy("date").orderBy("__part")
    sizes = rows.groupBy("date", "__part").agg(F.count("*").alias("__c"))
    sizes = sizes.withColumns({"__before": F.sum("__c").over(one.rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("__c").over(Window.partitionBy("date"))})
    place = F.row_number().over(Window.partitionBy("date", "__part").orderBy("ticker")) - 1
    return rows.withColumn("__in", place).join(sizes.drop("__c"), ["date", "__part"]).withColumn("pos", (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__part", "__in", "__before")


def with_drawn_places(df: DataFrame, n: str, k: int, *key: Column, out: str = "places") -> DataFrame:
    """Adds ``k`` different places below the column ``n``, every set with the same chance, fixed by the key.

    At step i a place up to n-k+i is drawn; if it is taken already, n-k+i itself is. So a draw takes k steps however many places
    there are. An md5 serves four steps.
    """
    top = lambda i: (F.col(n) - k + i).cast("int")
    place = lambda h, i: F.floor(_uniform(F.get(h, F.floor(i / 4).cast("int")), (i % 4) * 8 + 1) * (top(i) + 1)).cast("int")
    add = lambda s, t, i: F.array_append(s, F.when(F.array_contains(s, t), top(i)).otherwise(t))
    drawn = let(_hashes(F.lit((k - 1) // 4), *key), lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(place(h, i).alias("t"), i.alias("i"))))
    return df.withColumn(out, F.aggregate(drawn, F.expr("CAST(array() AS array<int>)"), lambda s, x: add(s, x["t"], x["i"])))


def random_portfolios(df: DataFrame, dates: DataFrame, k: int = 40, sims: int = 2000, seed: str = "42", ret: str = "target_fwd_ret", divisor: float = 1.0) -> DataFrame:
    """Sharpe of portfolios of ``k`` names drawn at random on every date: (sim, sharpe).

    Each portfolio and date draws ``k`` places without looking at the names, then meets only the names at those places: ``k`` rows per draw, whatever the
    universe. Dates of ``dates`` with fewer than ``k`` names return 0, names without a return leave the mean.
    """
    spark = df.sparkSession
    names = materialise(numbered_names(df.select("date", "ticker", F.col(ret).alias("__x"))).where(F.col("n") >= k), "names")
    sizes = names.groupBy("date").agg(F.max("n").alias("n"))
    drawn = sizes.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // CHUNK))))
    drawn = drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "date", "__chunk")
    first = F.col("__chunk") * CHUNK
    drawn = drawn.withColumn("sim", F.explode(F.sequence(first, F.least(first + CHUNK, F.lit(sims)) - 1)))
    # no draw is empty; a plain explode would draw twice, once to test for that
    drawn = with_drawn_places(drawn, "n", k, F.lit(seed), F.col("sim"), F.col("date")).select("date", "sim", F.explode_outer("places").alias("pos"))
    # sizes are measured before the draws are made (a row per date and chunk), so only a merge keeps them from being broadcast
    weekly = drawn.join(names.select("date", "pos", "__x").hint("merge"), ["date", "pos"]).groupBy("sim", "date").agg((F.avg("__x") / divisor).alias("r"))
    # zero returns on the other dates enter through the counts
    total = dates.select("date").distinct().agg(F.count("*").alias("n")).scalar()
    sums = weekly.groupBy("sim").agg(F.sum(F.coalesce("r", F.lit(0.0))).alias("s"), F.sum(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))).alias("q"))
    every = spark.range(sims).select(F.col("id").cast("int").alias("sim")).join(sums, "sim", "left")
    s, q = F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    mean = s / total
    sd = F.sqrt(F.greatest((q - s * mean) / (total - 1), F.lit(0.0)))
    return every.select("sim", F.coalesce(F.try_divide(mean, sd) * math.sqrt(52.0), F.lit(0.0)).alias("sharpe"))


def random_portfolio_p(sims: DataFrame, champion_sharpe) -> DataFrame:
    """(k+1)/(N+1) with k the random portfolios at least as good as the champion."""
    return sims.agg(((F.count_if(F.col("sharpe") >= champion_sharpe) + 1) / (F.count("*") + 1)).alias("p_value"), F.avg("sharpe").alias("mean_sharpe"))


# B06
def ablation(weekly_pnl: DataFrame, capital: float = 1e6, by=STRATEGY) -> DataFrame:
    """Performance per strategy under fixed and compounding capital. ``weekly_pnl``: keys, date, net_pnl."""
    from .performance import equity_compound
    fixed = weekly_pnl.select(*by, "date", (F.col("net_pnl") / capital).alias("r"), F.lit("FIXED_CAPITAL").alias("convention"))
    comp = equity_compound(weekly_pnl, capital, by).select(*by, "date", F.col("portfolio_return").alias("r"), F.lit("COMPOUNDING_CAPITAL").alias("convention"))
    keys = (*by, "convention")
    w = running(keys)
    both = fixed.unionByName(comp).withColumn("__e", F.product(1.0 + F.col("r")).over(w))
    both = both.withColumn("__p", F.max("__e").over(w))
    n, vol, end = F.count("*"), F.stddev_samp("r") * math.sqrt(52.0), F.max_by("__e", "date")
    return both.groupBy(*keys).agg(n.alias("n"), (end - 1.0).alias("cum_ret"), vol.alias("ann_vol"), (F.avg("r") * 52.0 / (vol + 1e-12)).alias("sharpe"),
                                   (F.pow(F.greatest(end, F.lit(0.0)), 52.0 / n) - 1.0).alias("cagr"), F.min((F.col("__e") - F.col("__p")) / (F.col("__p") + 1e-9)).alias("max_dd"))
