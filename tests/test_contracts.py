"""Provider files as a table, and matrices under their contracts."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fathomline.plans import contracts
from fathomline.sources import providers


def put(root, provider, file, code, header, rows):
    at = root / provider / file / f"{code}.csv"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join([header, *rows]), encoding="utf-8-sig")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("providers")
    put(root, "one", "unit_nav", "000001", "净值日期,单位净值,日增长率", [])
    put(root, "two", "unit_nav", "000001", "净值日期,单位净值,日增长率", ["2023-12-29,1.0,0.1", "2024-01-02,1.1,?", "2024-01-02,1.2,0.3", "bad,9,9", "2025-02-03,1.4,0.2"])
    put(root, "two", "cumulative_nav", "000001", "净值日期,累计净值", ["2024-01-02,2.2", "2030-01-01,7"])
    put(root, "one", "daily", "510300", "日期,开盘,收盘,成交量", ["2024/05/06,3.0,3.5,100", "2024-05-07,,,"])
    put(root, "one", "daily", "broken", "日期,开盘", ["2024-05-06,1"])
    return root


def test_providers(spark, root):
    df = providers.read_providers(spark, str(root), ["one", "two"], {"000001": "fund", "510300": "etf"})
    rows = {(r.code, r.date): r for r in df.collect()}
    day = dt.date(2024, 1, 2)
    assert len(rows) == 4 and {(r.code, r.provider) for r in rows.values()} == {("000001", "two"), ("510300", "one")}
    assert (rows["000001", day].nav, rows["000001", day].cumulative_nav, rows["000001", day].daily_growth_rate) == (1.2, 2.2, 0.3)
    assert rows["000001", dt.date(2025, 2, 3)].cumulative_nav is None
    assert rows["510300", dt.date(2024, 5, 6)].price == 3.5
    assert df.rdd.getNumPartitions() == 4  # three years of one code, one of the other


def test_filters_choose_partitions(spark, root):
    df = providers.read_providers(spark, str(root), ["one", "two"], {"000001": "fund", "510300": "etf", "broken": "index"})
    with pytest.raises(PySparkException, match="lacks"):
        df.collect()
    one = df.where((F.col("code") == "000001") & (F.col("date") >= dt.date(2024, 1, 1)) & (F.col("date") < dt.date(2025, 2, 3)) & (F.col("nav") > 0))
    assert [(str(r.date), r.nav) for r in one.collect()] == [("2024-01-02", 1.2)]
    assert one.rdd.getNumPartitions() == 2
    assert df.where(F.col("code").isin("510300", "000001") & (F.col("date") > dt.date(2040, 1, 1))).count() == 0
    with pytest.raises(PySparkException, match="no provider has rows"):
        providers.read_providers(spark, str(root), ["one"], {"000001": "fund"}).collect()


@pytest.fixture
def matrix(spark, tmp_path):
    rows = [("A", dt.date(2024, 1, 1), 1, 1.0, 0.1, label, 0.5, 1.5) for label in ("x", "y")] + [("B", dt.date(2024, 1, 1), 1, 1.0, 0.1, "z", 0.5, 1.5)]
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame(rows, "code string, date date, pos int, nav double, fwd double, candidate_label string, raw double, value double").write.parquet(path)

    def artefact(**changes):
        at = tmp_path / "meta.json"
        at.write_text(json.dumps({"feature_preprocess_output": {"fund_code": "A", "data_mode": "nav_price_series", "matrix_path": path, **changes}}))
        return str(at)

    return path, artefact


def test_a_matrix_under_its_contract(spark, matrix):
    path, artefact = matrix
    held = contracts.load_matrix(spark, artefact(), path, ["x", "y"], ("code", "date", "candidate_label", "value"))
    assert [r.candidate_label for r in held.rows.orderBy("candidate_label").collect()] == ["x", "y"]
    held.verify()
    plan = held.rows._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in plan.split("ReadSchema")[1]


def test_broken_contracts(spark, matrix, tmp_path):
    path, artefact = matrix
    for changes in ({"data_mode": "bars"}, {"matrix_path": None}):
        with pytest.raises(ValueError):
            contracts.load_matrix(spark, artefact(**changes))
    with pytest.raises(ValueError, match="belongs to"):
        contracts.load_matrix(spark, artefact(), "elsewhere")
    with pytest.raises(ValueError, match="lacks"):
        contracts.load_matrix(spark, artefact(), columns=("code", "date", "candidate_label", "weight"))
    with pytest.raises(PySparkException):
        contracts.load_matrix(spark, artefact(matrix_path=str(tmp_path / "nothing")))
    for changes, labels, message in (({}, ["x", "q"], "lacks"), ({"fund_code": "C"}, None, "no rows")):
        held = contracts.load_matrix(spark, artefact(**changes), labels=labels)
        held.rows.collect()
        with pytest.raises(ValueError, match=message):
            held.verify()
    spark.read.parquet(path).withColumn("date", F.lit(None).cast("date")).write.parquet(f"{path}.bad")
    with pytest.raises(PySparkException, match="no date or label"):
        contracts.load_matrix(spark, artefact(matrix_path=f"{path}.bad")).rows.collect()
