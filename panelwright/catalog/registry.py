"""Registered queries and, where plain SQL can say the same, the SQL they are checked against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

QUERIES: dict = {}
ORACLES: dict = {}
PARTS: dict = {}
# averages of prices often end in an exact half at the seventh place, which the two engines
# round differently; both add this before rounding
OFF_TIE = 1.3e-8


def tidy(df: DataFrame) -> DataFrame:
    """Result form shared by both engines: doubles to 6 places, dates as text, whole numbers as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + OFF_TIE, 6)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


ONCE: set = set()


def part(name: str, body: str, once: bool = False) -> None:
    """A named piece of SQL that other pieces and queries may refer to; ``once``: stored when it is first read."""
    PARTS[name] = body.strip()
    if once:
        ONCE.add(name)


def clone(names, renamed: dict, prefix: str) -> None:
    """Copies of SQL pieces that read other inputs: every name in ``renamed`` or ``names`` gets its new one."""
    table = {**renamed, **{n: prefix + n for n in names}}
    for n in names:
        body = PARTS[n]
        for old, new in table.items():
            body = re.sub(rf"\b{old}\b", new, body)
        part(prefix + n, body, n in ONCE)


def build(sql: str) -> str:
    """Puts the pieces a statement refers to, and theirs, in front of it."""
    order: list[str] = []

    def visit(text: str, trail: tuple) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)):
            if word in PARTS and word not in trail and word not in order:
                visit(PARTS[word], (*trail, word))
                order.append(word)

    visit(sql, ())
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({PARTS[n]})" for n in order) + "\n" + sql


def pick(source: str, text: str = "", num: str = "", whole: str = "", where: str = "") -> str:
    """SELECT in the shared result form: ``text`` as is (dates cast), ``num`` rounded, ``whole`` as BIGINT.

    Entries are names or ``name=expression``, separated by ``;``; plain names also by blanks.
    """
    def items(s: str):
        for p in (s.split(";") if "=" in s or ";" in s else s.split()):
            p = p.strip()
            if p:
                n, _, e = p.partition("=")
                yield n.strip(), (e or n).strip()
    cols = [f"CAST({e} AS VARCHAR) AS {n}" for n, e in items(text)]
    cols += [f"round(CAST({e} AS DOUBLE) + {OFF_TIE}, 6) + 0.0 AS {n}" for n, e in items(num)]
    cols += [f"CAST({e} AS BIGINT) AS {n}" for n, e in items(whole)]
    return f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else "")
