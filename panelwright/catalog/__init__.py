"""All registered queries."""

from . import base_sql  # noqa: F401  (SQL pieces first)
from . import aggregates, datasets, ingest, joins, news, performance, portfolio, quality, regime, research, selection, streams, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES, build


def oracle_sql() -> dict:
    """The complete SQL of every query that has one."""
    return {name: build(sql) for name, sql in ORACLES.items()}
