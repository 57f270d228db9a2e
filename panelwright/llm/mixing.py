"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's rate is its target weight's share of the budget over its own size, so every document is taken
``rate`` times in the mean. A document's count inverts the Poisson distribution at a uniform number made from
a hash of (seed, id): the smallest k whose cumulative probability exceeds it. The documents are exploded by
their counts and ordered by a hash of (seed, id, copy), which is a global shuffle that a lost task repeats alike.

Rows of null source are a source of their own. Null ids draw by a hash of the text, so do null texts (alike).
Rows that repeat an id draw the same count each. Columns named ``copy`` or ``shuffle_key`` are replaced.
Sources of size 0 have rate 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach_groups

#: 13 hexadecimal digits of a hash as a fraction of this.
_UNIT = float(16 ** 13)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_UNIT)


def source_rates(docs: DataFrame, key: str = "source", size: str = "1", power: float = 0.5, budget: float = 1.0,
                 weights: DataFrame | None = None) -> DataFrame:
    """Per source: ``size``, target ``weight`` (shares that add up to 1) and ``rate``.

    ``weights`` (``key``, ``weight``) states the targets; a source that it leaves out gets 0. Without it targets
    follow ``size ** power`` (1: as they are, 0: all alike). ``budget``: size of the mix as a multiple of the input.
    """
    sizes = docs.groupBy(F.col(key)).agg(F.sum(F.expr(size)).cast("double").alias("size"))
    if weights is None:
        raw = sizes.withColumn("raw", F.when(F.col("size") > 0, F.pow("size", F.lit(power))).otherwise(0.0))
    else:
        raw = attach_groups(sizes, weights.select(key, F.col("weight").alias("raw")), [key]).fillna(0.0, ["raw"])
    total = raw.agg(F.sum("raw").alias("raw"), F.sum("size").alias("size")).first()
    share = F.col("raw") / F.lit(float(total["raw"] or 1.0))
    return raw.select(
        key, "size", share.alias("weight"),
        F.when(F.col("size") > 0, share * F.lit(budget * float(total["size"] or 0.0)) / F.col("size")).otherwise(0.0).alias("rate"))


def cumulative(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, ..., as far as a double can tell them from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums")),
        lambda a, k: F.struct(
            (a["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"),
            F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + F.exp(a["log"] + F.log(rate) - F.log(k.cast("double"))))).alias("sums")))
    return F.when(rate > 0, steps["sums"]).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, rates: DataFrame, key: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as drawn, with ``copy`` (from 1) and ``shuffle_key``, in the order of the latter."""
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    groups = rates.select(key, cumulative(F.col("rate")).alias("__sums"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.md5(F.coalesce("text", F.lit("")))))
    drawn = (
        attach_groups(docs.select(*columns).withColumn("__name", name), groups, [key])
        .withColumn("__u", uniform(F.lit(seed), "__name"))
        .withColumn("__n", F.size(F.filter("__sums", lambda c: c <= F.col("__u")))).where("__n > 0"))
    copies = drawn.select(*columns, "__name", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    return (
        copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "__name", "copy")))
        .drop("__name").orderBy("shuffle_key"))


def mix_sources(docs: DataFrame, key: str = "source", seed: int = 0, **rates) -> DataFrame:
    return replicate(docs, source_rates(docs, key, **rates), key, seed)


def oracle(seed: int, power: float) -> str:
    """The same in SQL, sizes in documents, budget 1."""
    return f"""
WITH sizes AS (SELECT source, CAST(count(*) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, pow(size, {power}) / sum(pow(size, {power})) OVER () * sum(size) OVER () / size AS rate FROM sizes),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
logs AS (SELECT source, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k) AS lp FROM steps),
cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
lists AS (SELECT source, list(c ORDER BY k) AS sums FROM cdf GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(sums, lambda c: c <= CAST(('0x' || substr(md5('{seed}:' || doc_id), 1, 13)) AS BIGINT) / {_UNIT!r})) AS n
          FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy, md5('{seed}:order:' || doc_id || ':' || copy) AS shuffle_key FROM copies"""
