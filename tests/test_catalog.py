"""Queries against their SQL on the smallest tables that have enough rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
CHOSEN = ["s15_normalize_dedup", "s08_incremental_upsert", "p05_common_range_align", "w31_neighbor_fill", "w05_trend_tvalue", "w15_rolling_zscore", "w24_future_rank", "j06_asof_risk_free", "x07_signal_backtest", "w33_segment_metrics", "f04_dev_folds", "t12_cross_section_topk", "a19_rank_ic", "p15_candidate_grid"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    a = entry.queries()[name](spark, DATA).toPandas()
    b = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if a[c].dtype.kind == "f":
            same |= (a[c] - b[c]).abs() <= 1e-6
        assert same.all(), c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
