"""Feature tables of several sources and linked codes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException

from fathomline.operators import features, signals
from fathomline.plans import stages
from fathomline.sources import prices

DAY = dt.date(2024, 1, 1)


def bars(spark, n=120):
    rng = np.random.default_rng(6)
    rows = []
    for c in ("000001", "000002", "000003"):
        nav, volume = np.cumprod(1 + 0.02 * rng.normal(size=n)), rng.integers(1, 100, n)
        rows += [(c, DAY + dt.timedelta(i), float(nav[i]), float(nav[i] * 1.5), None if i % 3 or c != "000002" else float(volume[i])) for i in range(n) if c == "000001" or i % 10]
    return spark.createDataFrame(rows, "code string, date date, nav double, cumulative_nav double, volume double")


def test_effective_codes(spark):
    pool = spark.createDataFrame([("1", "1", "one"), ("1", "2", "two"), ("7", "3", "three")], "primary string, code string, name string")
    links = spark.createDataFrame([("1", "2"), ("1", "9"), ("8", "1")], "primary string, linked string")
    got = {(r.primary[-1], r.code[-1], r.name) for r in features.effective_codes(pool, links).collect()}
    assert got == {("1", "1", "one"), ("1", "2", "two"), ("1", "9", "000009"), ("7", "7", "000007"), ("7", "3", "three"), ("8", "8", "000008"), ("8", "1", "000001")}
    kinds = spark.createDataFrame([(str(k), "ETF") for k in range(1, 9)], "code string, kind string")
    with pytest.raises(PySparkException, match="no declared kind: 000009"):
        features.effective_codes(pool, links, kinds).collect()
    assert {r.kind for r in features.effective_codes(pool, links.limit(1), kinds).collect()} == {"etf"}


def test_cumulative_join_keeps_each_row(spark):
    nav = spark.createDataFrame([("A", DAY, 1.0), ("A", None, 2.0), ("B", DAY, 3.0)], "code string, date date, nav double")
    cumulative = spark.createDataFrame([("A", DAY, 1.5), ("A", DAY, 1.6), ("C", DAY, 9.0), ("A", None, 7.0)], "code string, date date, cumulative_nav double")
    assert sorted((r.code, r.nav, r.cumulative_nav) for r in features.with_cumulative(nav, cumulative).collect()) == [("A", 1.0, 1.6), ("A", 2.0, None), ("B", 3.0, None)]


def test_sources_on_primary_days(spark):
    df = bars(spark)
    codes = spark.createDataFrame([("000001", "000001"), ("000001", "000002")], "primary string, code string")
    out = features.on_primary_days(features.long_sources(df, ["nav", "volume"]), codes)
    rows = out.collect()
    assert len(rows) == 120 * 4 and {r.code for r in rows} == {"000001"}
    missing = {r.date for r in rows if r.source == "000002__nav" and r.value is None}
    assert missing == {DAY + dt.timedelta(i) for i in range(0, 120, 10)}


def test_source_factors_are_pruned_before_they_become_rows(spark):
    sources = features.long_sources(bars(spark), ["nav", "volume"])
    wanted = [("momentum(window=10)", "momentum", {"window": 10}), ("drawdown(window=20)", "drawdown", {"window": 20})]
    out = features.source_factors(sources, wanted, score_window=20)
    labels = {(r.code, r.candidate_label) for r in out.select("code", "candidate_label").distinct().collect()}
    # The volume of one code has too many gaps for factors, that of the others no value at all; own scores stay.
    assert {c for c in labels if c[0] == "000001"} == {("000001", x) for x in ("nav__zscore", "nav__momentum(window=10)__zscore", "nav__drawdown(window=20)__zscore", "volume__zscore")}
    assert all("volume__m" not in label for _, label in labels)
    assert out.where("value is null").count() == 0
    own = out.where("candidate_label = 'nav__zscore' and code = '000001'").orderBy("date").toPandas()
    x = own.raw
    z = ((x - x.rolling(20).mean()) / x.rolling(20).std(ddof=0)).fillna(0.0)
    np.testing.assert_allclose(own.value, z, rtol=1e-7, atol=1e-9)


def test_columns_and_target():
    columns = ["date", "1__price", "1__price__zscore", "1__price__momentum(window=10)__zscore", "2__volume"]
    assert features.column_sets(columns) == {"raw": ["1__price", "2__volume"], "raw_zscore": ["1__price__zscore"], "factor": ["1__price__momentum(window=10)__zscore"]}
    assert features.target_column(columns, "1") == "1__price" and features.target_column([*columns, "1__cumulative_nav"], "1") == "1__cumulative_nav"
    with pytest.raises(ValueError):
        features.target_column(columns, "2")


def test_the_stage_uses_all_sources(spark):
    config = stages.Config().override(factor_names=("momentum", "drawdown"), sources=("nav", "cumulative_nav"), links={"000001": ["000002"]})
    out = stages.feature_matrix(bars(spark), config)
    labels = {r.candidate_label for r in out.where("code = '000001'").select("candidate_label").distinct().collect()}
    assert {"000001__nav__zscore", "000002__cumulative_nav__zscore"} <= labels and not any(x.startswith("000003") for x in labels)
    one = out.where("code = '000001' and candidate_label = '000001__nav__zscore'").orderBy("date").collect()
    nav = [r.nav for r in one]
    assert all(abs(r.fwd - (nav[i + 5] / nav[i] - 1)) < 1e-9 for i, r in enumerate(one[:-5])) and [r.pos for r in one] == list(range(1, 121))


def test_segment_trade_count(spark):
    df = spark.createDataFrame([("A", i + 1, i in (0, 3, 4, 9)) for i in range(10)], "code string, pos int, entries boolean")
    bounds = spark.createDataFrame([("A", "train", 0, 4), ("A", "valid", 4, 9), ("A", "test", 9, 10)], "code string, segment string, start_pos int, end_pos int")
    assert {r.segment: r.trade_count for r in signals.segment_trade_count(df, bounds).collect()} == {"train": 2, "valid": 1, "test": 1}


def test_standard_frame_keeps_the_last_row_of_a_date(spark):
    df = spark.createDataFrame([("2024-01-01", "1", 2), ("2024-01-01", "5", 1), ("2024-01-02", "nan", 3), ("2024-01-03", "7", 4)], "`日期` string, `收盘` string, n int")
    out = prices.standardize(df, prices.DAILY_BARS, ["date", "close"], "000001", "n").orderBy("date").collect()
    assert [(str(r.date), r.price) for r in out] == [("2024-01-01", 1.0), ("2024-01-03", 7.0)]
