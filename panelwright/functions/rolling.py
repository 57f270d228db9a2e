"""Trailing statistics over the rows of a series.

A series holds one row per date, so a window partition is never longer than
the calendar. Missing values are NULL and are skipped; a statistic is NULL
until ``min_periods`` values are present.

Two forms give the same numbers:

* ``frame``: an SQL sliding frame. Spark re-reads the frame for each row, so
  the cost is rows x width.
* ``block``: a frame is put together from the head of one block of rows, the
  tail of an earlier one and whole blocks between. Cost and rounding depend neither on
  the width nor on the length of the series.

Widths of ``PREFIX_FROM`` rows and more use the block form.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

PREFIX_FROM = 100
#: Widths of up to this many times the narrowest share its blocks.
MOST_BLOCKS = 2
#: Deviations below this share of the mean are rounding.
EQUAL = 1e-13


def min_periods(width: int) -> int:
    return max(10, width // 3)


def series(by=("ticker",), order="date"):
    return Window.partitionBy(*by).orderBy(order)


def trailing(width: int, by=("ticker",), order="date", skip: int = 0):
    return series(by, order).rowsBetween(-(width - 1) - skip, -skip)


def running(by=("ticker",), order="date"):
    return series(by, order).rowsBetween(Window.unboundedPreceding, 0)


def gated(value: Column, counted: Column, least: int) -> Column:
    return F.when(counted >= least, value)


class Roll(NamedTuple):
    """One trailing statistic: ``fn`` in count, mean, sum, std, var, max, min, cov (with ``other``, over rows that hold both); ``skip`` drops the newest rows."""

    out: str
    fn: str
    col: str
    width: int
    least: int
    skip: int = 0
    other: str | None = None


#: What is kept of a part of a frame: count, mean, squared deviation, mean of the other column, co-deviation, extremes.
_STATES = {"n": F.count, "m": F.avg, "v": F.var_pop, "l": F.min, "h": F.max}
_NEEDS = {"count": "n", "mean": "nm", "sum": "nm", "std": "nmv", "var": "nmv", "max": "nh", "min": "nl", "cov": "nmkc"}
#: Two columns need two values, one for the extremes and means.
_LEAST = {"std": 2, "var": 2, "cov": 2}


def _frame_column(r: Roll, by, order) -> Column:
    w = trailing(r.width, by, order, r.skip)
    least = max(r.least, _LEAST.get(r.fn, 1))
    if r.fn == "cov":
        return gated(F.covar_samp(r.col, r.other).over(w), F.count(F.when(F.col(r.col).isNotNull() & F.col(r.other).isNotNull(), 1)).over(w), least)
    if r.fn == "count":
        return F.count(r.col).over(w)
    fn = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "max": F.max, "min": F.min}[r.fn]
    return gated(fn(r.col).over(w), F.count(r.col).over(w), least)


def with_rolling(df: DataFrame, rolls, by=("ticker",), order="date", prefix_from: int | None = None) -> DataFrame:
    """Adds all the given statistics with one pass for sliding frames and one for the blocks of all wide ones."""
    limit = PREFIX_FROM if prefix_from is None else prefix_from
    short = [r for r in rolls if r.width < limit]
    long = sorted((r for r in rolls if r.width >= limit), key=lambda r: r.width)
    if short:
        df = df.withColumns({r.out: _frame_column(r, by, order) for r in short})
    while long:
        # a width of a few whole blocks shares those of the narrowest; for others the merging would cost more than sorting again
        size = long[0].width
        together = [r for r in long if r.width % size == 0 and r.width <= MOST_BLOCKS * size]
        df, long = _with_blocks(df, together, size, by, order), [r for r in long if r not in together]
    return df


def _parts_of(r: Roll, size: int) -> list[tuple[str, int]]:
    """A frame as (side, rows back): the head of its last block, whole blocks, the tail of its first.

    A whole block is the head and the tail seen from any of its rows.
    """
    return [("a", r.skip)] + [(side, r.skip + j * size) for j in range(1, r.width // size) for side in "ab"] + [("b", r.skip + r.width)]


def _with_blocks(df: DataFrame, rolls, size: int, by, order) -> DataFrame:
    """Statistics of one layout in blocks of ``size`` rows.

    Heads and tails of blocks are running aggregates. A frame is merged from the parts it consists of: counts are added, means
    weighted, squared and co-deviations added with those of the parts' means. Nothing is ever taken off a larger sum. Two sorts inside the
    layout by series serve all widths: backwards for the tails, forwards for heads and for what is fetched from earlier rows.
    """
    df = df.withColumn("__row", F.row_number().over(series(by, order)) - 1)
    df = df.withColumn("__blk", F.floor(F.col("__row") / size))
    names: dict[tuple, str] = {}  # (kind, column, other) -> part of a column name
    state: dict[str, Column] = {}
    for r in rolls:
        both = F.col(r.col).isNotNull() & F.col(r.other).isNotNull() if r.other else None
        for kind in _NEEDS[r.fn]:
            key = (kind, r.col, r.other)
            if key not in names:
                names[key] = f"{kind}{len(names)}"
                x = F.when(both, F.col(r.col)) if r.other else F.col(r.col)
                state[names[key]] = (lambda w, x=x, r=r, both=both, kind=kind: F.avg(F.when(both, F.col(r.other))).over(w) if kind == "k"
                                     else F.covar_pop(x, F.when(both, F.col(r.other))).over(w) if kind == "c" else _STATES[kind](x).over(w))
    block = Window.partitionBy(*by, "__blk")
    tail = block.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    head = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for side, w in (("b", tail), ("a", head)):
        df = df.withColumns({f"__{side}_{n}": of(w) for n, of in state.items()})
    earlier = Window.partitionBy(*by).orderBy("__blk", order)  # blocks ascend with the rows: no further sort
    fetched: dict[str, Column] = {}

    def get(kind: str, r: Roll, side: str, back: int) -> Column:
        name = f"__{side}_{names[kind, r.col, r.other]}"
        if back:
            fetched[f"{name}_{back}"] = F.lag(name, back).over(earlier)
            name = f"{name}_{back}"
        return F.col(name) if kind in "lh" else F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    first, second, out = {}, {}, {}
    for i, r in enumerate(rolls):
        of = {kind: [get(kind, r, *p) for p in _parts_of(r, size)] for kind in _NEEDS[r.fn]}
        n, m, k = F.col(f"__n_{i}"), F.col(f"__m_{i}"), F.col(f"__k_{i}")
        first[f"__n_{i}"] = sum(of["n"][1:], of["n"][0])
        weighted = lambda kind: sum((a * b for a, b in zip(of["n"][1:], of[kind][1:])), of["n"][0] * of[kind][0])
        if r.fn == "count":
            out[r.out] = n.cast("long")
            continue
        if r.fn in ("max", "min"):
            value = (F.greatest if r.fn == "max" else F.least)(*of["h" if r.fn == "max" else "l"])
        elif r.fn == "sum":
            value = weighted("m")
        else:
            second[f"__m_{i}"] = F.try_divide(weighted("m"), n)
            if r.fn == "mean":
                value = m
            elif r.fn == "cov":
                second[f"__k_{i}"] = F.try_divide(weighted("k"), n)
                apart = [a * (x - m) * (y - k) for a, x, y in zip(of["n"], of["m"], of["k"])]
                value = F.try_divide(weighted("c") + sum(apart[1:], apart[0]), n - 1)
            else:
                apart = [a * (x - m) * (x - m) for a, x in zip(of["n"], of["m"])]
                ss = weighted("v") + sum(apart[1:], apart[0])
                # equal values have no deviation, whatever the rounding of the parts' means
                ss = F.when(ss <= n * F.pow(m * EQUAL, F.lit(2.0)), F.lit(0.0)).otherwise(ss)
                value = F.try_divide(ss, n - 1)
                if r.fn == "std":
                    value = F.sqrt(value)
        out[r.out] = gated(value, n, max(r.least, _LEAST.get(r.fn, 1)))
    df = df.withColumns(fetched).withColumns(first)
    if second:
        df = df.withColumns(second)
    df = df.withColumns(out)
    return df.drop("__row", "__blk", *fetched, *first, *second, *[f"__{side}_{n}" for side in "ab" for n in state])


def with_rolling_quantile(df: DataFrame, out: str, col: str, share: float, width: int, least: int, by=("ticker",), order="date") -> DataFrame:
    """Adds the trailing quantile (between neighbours in proportion) from bitmaps of ranks.

    A frame is the head of a block of ``width`` rows and the tail of the one before. Each two neighbouring blocks are sorted once
    by value; the frames of the later one are bitmaps over those ranks, each made from the frame before it by two exclusive-ors, running
    aggregates over 64-bit words. The rank asked for is found by counting bits, first over words, then by halving one word. So
    a row costs a few words, not the sorting of a frame. Rows of a series and two blocks are gathered at most.
    """
    words = -(-2 * width // 64)
    columns = df.columns
    place = F.row_number().over(series(by, order)) - 1
    df = df.withColumn("__row", place)
    blk = F.floor(F.col("__row") / width)
    # a row is in the head of its own block's frames, and in the tails of the frames of the block after
    role = F.explode(F.array(F.struct(blk.alias("pair"), F.lit(True).alias("own")), F.struct((blk + 1).alias("pair"), F.lit(False).alias("own"))))
    pair = [*by, "__pair"]
    rows = df.withColumn("__as", role).withColumns({"__pair": F.col("__as.pair"), "__own": F.col("__as.own")}).drop("__as")
    sorted_ = Window.partitionBy(*pair).orderBy(F.col(col).isNull(), col, "__own", "__row")
    rows = rows.withColumn("__rank", F.when(F.col(col).isNotNull(), F.row_number().over(sorted_) - 1))
    bit = lambda j: F.when(F.floor(F.col("__rank") / 64) == j, F.expr("shiftleft(1L, cast(__rank % 64 as int))")).otherwise(F.lit(0).cast("long"))
    # the tail starts full and loses its row at each place; the head gains one: both toggle a bit
    walk = Window.partitionBy(*pair).orderBy(F.pmod("__row", F.lit(width))).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*pair)
    rows = rows.withColumns({f"__w{j}": F.bit_xor(bit(j)).over(walk).bitwiseXOR(F.bit_xor(F.when(F.col("__own"), F.lit(0).cast("long")).otherwise(bit(j))).over(whole)) for j in range(words)})
    counts = [F.bit_count(f"__w{j}") for j in range(words)]
    upto = [F.col(f"__u{j}") for j in range(words)]
    rows = rows.withColumns({f"__u{j}": sum(counts[1: j + 1], counts[0]) for j in range(words)})
    n = upto[-1]
    at = F.lit(float(share)) * (n - 1)
    rows = rows.withColumns({"__low": F.floor(at), "__high": F.ceil(at), "__part": at - F.floor(at)})

    def select(k: Column) -> Column:
        """Rank of the (k+1)-th bit set."""
        word, before, start = F.lit(0).cast("long"), F.lit(0), 0
        for j in reversed(range(words)):
            hit = k < upto[j]
            word, before, start = F.when(hit, F.col(f"__w{j}")).otherwise(word), F.when(hit, upto[j - 1] if j else F.lit(0)).otherwise(before), F.when(hit, F.lit(64 * j)).otherwise(start)
        return F.struct(word.alias("w"), (k - before).alias("k"), start.alias("at"))

    def halve(name: str, step: int) -> Column:
        s = F.col(name)
        lower = s["w"].bitwiseAND(F.lit((1 << step) - 1))
        low = F.bit_count(lower)
        return F.when(s["k"] < low, F.struct(lower.alias("w"), s["k"].alias("k"), s["at"].alias("at"))).otherwise(
            F.struct(F.shiftrightunsigned(s["w"], step).alias("w"), (s["k"] - low).alias("k"), (s["at"] + step).alias("at")))

    rows = rows.withColumns({"__lo": select(F.col("__low")), "__hi": select(F.col("__high"))})
    for step in (32, 16, 8, 4, 2, 1):
        rows = rows.withColumns({name: halve(name, step) for name in ("__lo", "__hi")})
    kept = F.when(F.col("__own"), F.struct(*columns, n.alias("__n"), F.col("__lo.at").alias("__lo"), F.col("__hi.at").alias("__hi"), "__part"))
    grouped = rows.groupBy(*pair).agg(F.array_sort(F.collect_list(F.when(F.col("__rank").isNotNull(), F.struct("__rank", F.col(col).alias("x"))))).alias("__sorted"), F.collect_list(kept).alias("__rows"))
    value = lambda r, c: F.get(F.col("__sorted"), r[c])["x"]
    result = F.transform("__rows", lambda r: F.struct(
        *[r[c].alias(c) for c in columns],
        F.when(r["__n"] >= max(least, 1), value(r, "__lo") * (1 - r["__part"]) + value(r, "__hi") * r["__part"]).alias(out)))
    return grouped.select(F.explode(result).alias("__r")).select("__r.*")


def with_zscore(df: DataFrame, pairs: dict, width: int, least: int | None = None, by=("ticker",), order="date",
                fill: float | None = None, prefix_from: int | None = None) -> DataFrame:
    """``pairs``: output name -> source column; NULL where the trailing deviation is 0."""
    m = min_periods(width) if least is None else least
    rolls = []
    for out, col in pairs.items():
        rolls += [Roll(f"__m_{out}", "mean", col, width, m), Roll(f"__d_{out}", "std", col, width, m)]
    df = with_rolling(df, rolls, by, order, prefix_from)
    z = {}
    for out, col in pairs.items():
        v = F.try_divide(F.col(col) - F.col(f"__m_{out}"), F.col(f"__d_{out}"))
        z[out] = v if fill is None else F.coalesce(v, F.lit(fill))
    return df.withColumns(z).drop(*[r.out for r in rolls])


def with_ewm(df: DataFrame, pairs: dict, alpha: float, least: int = 1, by=("ticker",), order="date",
             block: int | None = None) -> DataFrame:
    """Exponentially weighted means (unadjusted), gaps decaying the old weight.

    With ``g`` rows since the last value, the step is
    ``y = (d*y_prev + a*x) / (d + a)`` with ``d = (1-a)^g``, a linear recurrence.
    It is solved by running products and sums inside blocks of rows, short
    enough to keep both in range and exact; the state at the end of a block is carried
    into the next ones. ``pairs``: output name -> source column.
    """
    size = block or max(1, int(30.0 / abs(math.log(1.0 - alpha))))
    w = series(by, order)
    up = running(by, order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    names = list(pairs)
    df = df.withColumn("__row", F.row_number().over(w))
    df = df.withColumns({f"__p_{o}": F.last(F.when(F.col(c).isNotNull(), F.col("__row")), ignorenulls=True)
                        .over(earlier) for o, c in pairs.items()})
    step = {"__blk": F.floor((F.col("__row") - 1) / size)}
    for o, c in pairs.items():
        d = F.pow(F.lit(1.0 - alpha), (F.col("__row") - F.col(f"__p_{o}")).cast("double"))
        seen = F.col(c).isNotNull()
        later = seen & F.col(f"__p_{o}").isNotNull()
        step[f"__a_{o}"] = F.when(later, F.log(d / (d + alpha))).when(seen, F.lit(0.0))
        step[f"__b_{o}"] = F.when(later, F.col(c) * alpha / (d + alpha)).when(seen, F.col(c))
    df = df.withColumns(step)
    in_block = Window.partitionBy(*by, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__g_{o}": F.coalesce(F.sum(f"__a_{o}").over(in_block), F.lit(0.0)) for o in names})
    df = df.withColumns({
        f"__l_{o}": F.exp(F.col(f"__g_{o}"))
        * F.coalesce(F.sum(F.col(f"__b_{o}") * F.exp(-F.col(f"__g_{o}"))).over(in_block), F.lit(0.0))
        for o in names})
    # The state is folded on the closing rows alone, one per block, and handed on to the rows of the next block;
    # the other rows collect nothing. A series shorter than one block has no closing row.
    closing = F.col("__row") % size == 0
    df = df.withColumn("__end", closing)
    blocks = Window.partitionBy(*by, "__end").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__e_{o}": F.collect_list(F.when(closing, F.struct(F.col(f"__g_{o}").alias("g"), F.col(f"__l_{o}").alias("l")))).over(blocks)
                         for o in names})
    df = df.withColumns({f"__s_{o}": F.when(closing, F.aggregate(F.col(f"__e_{o}"), F.lit(0.0), lambda acc, e: F.exp(e.g) * acc + e.l))
                         for o in names}).drop(*[f"__e_{o}" for o in names])
    carry = {}
    for o, c in pairs.items():
        carry[f"__c_{o}"] = F.coalesce(F.last(f"__s_{o}", ignorenulls=True).over(earlier), F.lit(0.0))
        carry[f"__k_{o}"] = F.count(c).over(up)
    df = df.withColumns(carry)
    df = df.withColumns({o: gated(F.exp(F.col(f"__g_{o}")) * F.col(f"__c_{o}") + F.col(f"__l_{o}"), F.col(f"__k_{o}"), max(least, 1)) for o in names})
    return df.drop("__row", "__blk", "__end", *[f"__{k}_{o}" for k in "pabglsck" for o in names])
