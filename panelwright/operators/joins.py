"""Alignment to a calendar, as-of values, dimension joins, intervals, trailing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates in order with their position from 0. One row per day, so always small."""
    days = df.agg(F.array_sort(F.collect_set(date)).alias("days"))
    return days.select(F.posexplode("days").alias("idx", "date"))


# J01
def align(df: DataFrame, cal: DataFrame, by=("ticker",), missing: Column | None = None) -> DataFrame:
    """Every series on every calendar date, absent values NULL; dates off the calendar are dropped.

    Each priced row opens the gap up to the next priced one, so the grid comes
    from one window per series: no join of series with dates and no second
    shuffle. The calendar is one row per day and is therefore broadcast.
    """
    days = cal.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "date"))), lambda s: s.date).alias("d"))
    w = Window.partitionBy(*by).orderBy("__at")
    values = [c for c in df.columns if c not in (*by, "date")]
    on_cal = df.join(F.broadcast(cal.withColumnRenamed("idx", "__at")), "date")
    opened = on_cal.withColumns({
        "__to": F.coalesce(F.lead("__at").over(w) - 1, F.size(days.scalar()) - 1),
        "__from": F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("__at")),
    })
    rows = opened.withColumn("idx", F.explode(F.sequence("__from", "__to")))
    here = F.col("idx") == F.col("__at")
    return rows.select(
        *by, F.element_at(days.scalar(), F.col("idx") + 1).alias("date"), "idx",
        *[F.when(here, F.col(c)).alias(c) for c in values])


# J02
def asof(left: DataFrame, right: DataFrame, cols, by=(), on: str = "date", bucket: str = "day") -> DataFrame:
    """Latest known ``cols`` of ``right`` at or before each row of ``left``, by series.

    Dates: the distinct keys of both sides are stacked and the last non-NULL value is carried down one window per series, which is no
    longer than the calendar however many rows share a date; the values then join back by key.
    Timestamps: time is cut into buckets (a unit of ``date_trunc``). Values are carried inside a bucket, and the last ones of the buckets before
    come from a table with one row per series and bucket. So a long series is spread over as many tasks as it has buckets.
    Rows of ``right`` with one key are ordered by ``cols``.
    """
    if left.schema[on].dataType != T.DateType():
        return _asof_buckets(left, right, list(cols), by, on, bucket)
    keys = [*by, on]
    carried = _carried(left, right, cols, keys, by or [F.lit(0)], on)
    if not by:
        carried = F.broadcast(carried)  # one row per day
    return left.join(carried, keys, "left")


def _carried(left: DataFrame, right: DataFrame, cols, keys, part, on: str) -> DataFrame:
    """The distinct keys of ``left`` with the last values of ``right`` up to them, within ``part``."""
    wanted = left.select(*keys).distinct()
    stacked = wanted.select(*keys, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in cols],
                            F.lit(1).alias("__side")).unionByName(right.select(*keys, *cols, F.lit(0).alias("__side")))
    w = Window.partitionBy(*part).orderBy(on, "__side", *cols).rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumns({f"__c_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
    return carried.where("__side = 1").select(*keys, *[F.col(f"__c_{c}").alias(c) for c in cols])


def _asof_buckets(left: DataFrame, right: DataFrame, cols: list, by, on: str, bucket: str) -> DataFrame:
    cut = lambda df: df.withColumn("__b", F.date_trunc(bucket, on))
    part = [*by, "__b"]
    inside = _carried(cut(left), cut(right), cols, [*part, on], part, on)
    newest = cut(right).groupBy(*part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(on, *cols))).alias(f"__n_{c}") for c in cols])
    buckets = cut(left).select(*part).distinct().join(newest, part, "full")
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    buckets = buckets.select(*part, *[F.last(f"__n_{c}", ignorenulls=True).over(earlier).alias(f"__n_{c}") for c in cols])
    known = inside.join(buckets, part, "left").select(*by, on, *[F.coalesce(c, f"__n_{c}").alias(c) for c in cols])
    return left.join(known, [*by, on], "left")


# J03
def with_broad(df: DataFrame, broad: DataFrame, cols=("close",), prefix: str = "broad_") -> DataFrame:
    """Market columns by date; the market side has one row per day."""
    side = broad.select("date", *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(F.broadcast(side), "date", "left")


# J04
def with_sector(df: DataFrame, sectors: DataFrame, default: str = "Unknown") -> DataFrame:
    return df.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


# J05
REGIME_DEFAULTS = {"p_bull": 0.33, "p_chop": 0.33, "p_bear": 0.33, "vix": 15.0, "macro_score": 0.0,
                   "transition_risk": 0.0, "regime_confidence": 0.5}


def with_regime(df: DataFrame, regime: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Regime attributes by date. Defaults apply on dates the regime table does not have;
    a missing value inside a known date stays missing."""
    values = defaults or REGIME_DEFAULTS
    side = regime.select("date", *values, F.lit(True).alias("__known"))
    out = df.join(F.broadcast(side), "date", "left")
    return out.withColumns({c: F.when(F.col("__known"), F.col(c)).otherwise(F.lit(v)) for c, v in values.items()}).drop("__known")


# J06
def join_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    return articles.join(scores, "article_id")


# J07
def unseen(df: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


# J08
def held_split(df: DataFrame, held: DataFrame, keys=("date", "ticker")) -> DataFrame:
    """Adds ``held`` (0/1): whether the row's keys are among the holdings."""
    mark = held.select(*keys).distinct().withColumn("held", F.lit(1))
    return df.join(mark, list(keys), "left").withColumn("held", F.coalesce("held", F.lit(0)))


# J09
def weight_delta(weights: DataFrame, dates: DataFrame | None = None, by=()) -> DataFrame:
    """Old and new weight of every name held on a date or on the one before.

    A position opens a row on its own date and a closing row on the next
    one; rows that meet are added up. The next date is that of the following book of the same
    ``by``, so a date without a book leaves the holdings as they are; with ``dates``
    (date, next_date) it is the next rebalance date, and an empty date closes them.
    """
    keys = [*by, "date", "ticker"]
    now = weights.select(*keys, F.lit(0.0).alias("old_weight"), F.col("weight").alias("new_weight"))
    if dates is None:
        own = weights.select(*by, "date").distinct()
        days, on = own.withColumn("next_date", F.lead("date").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("date"))), [*by, "date"]
    else:
        days, on = F.broadcast(dates.select("date", "next_date")), ["date"]
    later = weights.join(days, on).where(
        F.col("next_date").isNotNull()).select(
        *by, F.col("next_date").alias("date"), "ticker", F.col("weight").alias("old_weight"),
        F.lit(0.0).alias("new_weight"))
    both = now.unionByName(later).groupBy(*keys).agg(F.sum("old_weight").alias("old_weight"),
                                                      F.sum("new_weight").alias("new_weight"))
    return both.withColumn("delta", F.col("new_weight") - F.col("old_weight"))


# J10
def prefer(df: DataFrame, other: DataFrame, col: str = "portfolio_return", keys=("date",)) -> DataFrame:
    """The other table's value where it has one, else the own."""
    side = other.select(*keys, F.col(col).alias("__o"))
    return df.join(side, list(keys), "left").withColumn(col, F.coalesce("__o", col)).drop("__o")


# J11
def with_trace(df: DataFrame, trace: DataFrame,
               cols=("regime_confidence", "p_bull", "p_chop", "p_bear", "transition_risk")) -> DataFrame:
    side = trace.select("date", "regime", *[F.col(c).alias(f"{c}_trace") for c in cols])
    return df.join(side, "date", "left")


# J12
def common_dates(returns: DataFrame, value: str = "portfolio_return") -> DataFrame:
    """Keeps the dates on which every strategy has a value."""
    rows = returns.where(F.col(value).isNotNull())
    total = rows.agg(F.count_distinct("strategy").alias("n"))
    full = rows.groupBy("date").agg(F.count_distinct("strategy").alias("n")).where(F.col("n") == total.scalar())
    return rows.join(F.broadcast(full.select("date")), "date")


# J13
def intervals(trace: DataFrame, state: str = "regime", by=(), last_end: Column | None = None) -> DataFrame:
    """Each state from its date up to the next one's; the last stays open unless ``last_end`` is given."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")
    end = F.lead("date").over(w)
    return trace.select(*by, F.col("date").alias("start"), F.coalesce(end, last_end).alias("end") if last_end is not None
                        else end.alias("end"), F.col(state).alias(state))


def in_interval(df: DataFrame, iv: DataFrame, state: str = "regime", by=()) -> DataFrame:
    """State in force on each row's date.

    Intervals that follow one another are an as-of lookup of their starts, with
    the end as a check, so no range join is needed. Rows in no interval are dropped.
    """
    starts = iv.select(*by, F.col("start").alias("date"), F.struct(F.col(state), F.col("end")).alias("__iv"))
    hit = asof(df, starts, ["__iv"], by)
    inside = F.col("__iv").isNotNull() & (F.col("__iv.end").isNull() | (F.col("date") < F.col("__iv.end")))
    return hit.where(inside).withColumn(state, F.col(f"__iv.{state}")).drop("__iv")


# J14
def trailing_values(selected: DataFrame, panel: DataFrame, value: str, window: int = 252, by=("ticker",), out: str = "past") -> DataFrame:
    """The ``window`` panel rows before each selected row as one array, NULL as 0.

    Only the rows a selection needs are looked up, by series and calendar
    position, so the cost follows the selection and the panel is not joined
    with itself. Pairs of names are formed later, within one date's selection.
    """
    keys = [*by, "date"]
    need = selected.select(*keys, F.explode(F.sequence(F.greatest(F.col("idx") - window, F.lit(0)), F.col("idx") - 1)).alias("idx"))
    rows = need.join(panel.select(*by, "idx", F.coalesce(F.col(value), F.lit(0.0)).alias("__v")), [*by, "idx"])
    past = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "__v"))), lambda s: s["__v"]).alias(out))
    return selected.join(past, keys)
