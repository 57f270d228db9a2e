"""Chat formatting from every participant's point of view, in DataFrame operations only.

A conversation is rendered once per participant: their turns as the assistant's, those of all others as users
named by role, system turns as they are. ``mask`` lists where the loss applies: the participant's own words
with the closing mark, as start:end in code points (end exclusive).

Long conversations come in parts of ``BLOCK`` turn numbers each, so that no conversation has to fit into one
task; the parts of a dialogue, joined in order, are the dialogue, and masks count from their part's start.

Rows that repeat all of (conversation, turn, role, text) count once. Turns of the same number are ordered by role,
then text, nulls first. Null turn numbers come first, in parts of negative number dealt by a hash of their words. A null role
is the participant ``unknown``; null texts are empty. A conversation of system turns alone has no participant and
gives no row. Marks within texts are broken up by a blank, so that no text can pose as a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 64
NULL_PARTS = 64
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(speaker: Column, perspective: Column) -> Column:
    return (F.when(speaker == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n"))
            .when(speaker == perspective, F.lit(f"{OPEN}assistant\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n"))))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and part: ``conv_id``, ``perspective``, ``part``, ``n_turns``, ``n_own``, ``rendered``, ``mask``."""
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), safe(F.coalesce("role", F.lit("unknown"))).alias("role"),
        safe(F.coalesce("text", F.lit(""))).alias("text"))
    part = F.when(F.col("turn").isNull(), -1 - F.pmod(F.xxhash64("role", "text"), F.lit(NULL_PARTS))).otherwise(F.floor(F.col("turn") / BLOCK))
    parts = (
        rows.withColumn("part", part.cast("long"))
        .groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")))
    people = (
        rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
        .withColumnRenamed("conv_id", "__conv"))
    both = parts.join(people, parts["conv_id"].eqNullSafe(people["__conv"])).drop("__conv")
    pieces = both.withColumn("pieces", F.transform("turns", lambda t: F.struct(
        _head(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"),
        (t["role"] == F.col("perspective")).alias("own"))))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.concat_ws(":", a["at"] + F.length(p["head"]), a["at"] + F.length(p["head"]) + F.length(p["body"])))))
            .otherwise(a["spans"]).alias("spans")))
    return pieces.select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n")))).alias("rendered"),
        F.concat_ws(",", spans["spans"]).alias("mask"))


ORACLE = f"""
WITH rows AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
                     replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> '{SYSTEM}'),
pieces AS (SELECT r.conv_id, p.perspective, CAST(floor(turn / {BLOCK}) AS BIGINT) AS part, turn, role, text, role = perspective AS own,
                  CASE WHEN role = '{SYSTEM}' THEN '{OPEN}{SYSTEM}' WHEN role = perspective THEN '{OPEN}assistant'
                       ELSE '{OPEN}user name=' || role END || chr(10) AS head
           FROM rows r JOIN people p USING (conv_id)),
placed AS (SELECT *, sum(length(head) + length(text) + {len(CLOSE)} + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text)
                     - length(text) - {len(CLOSE)} - 1 AS begins FROM pieces)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(CAST(begins AS BIGINT) || ':' || CAST(begins + length(text) + {len(CLOSE)} AS BIGINT), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part"""
