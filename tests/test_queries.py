"""A spread of registered queries against their SQL on the smallest tables, and the contract of the entry file."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.verify import TABLES, compare

SAMPLE = ("J01_align J02_asof J13_intervals W01_pct W04_zscore W10_rsi_wilder W16_trend_r2 W20_cs_rank_split A05_daily_summary A15_heatmap F05_long_pool "
          "K05_topk_mean G06_gate P10_cap_iterate P16_weekly_returns time_fence_features M05_var_cvar B03_pbo D02_targets N05_news_features Q06_anomaly_report S04_upsert X09_softmax").split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert sorted(df.columns) == ["date", "mom60", "place", "rank_mom60", "ticker", "vol20"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], cols, rel.fetchall()) == ""
