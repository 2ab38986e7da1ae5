"""Price tables: reading, cleaning, upserting and joining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("date", "code", "fund", "nav")
# Column names of the data providers and what they are called here.
UNIT_NAV = {"净值日期": "date", "单位净值": "nav", "日增长率": "daily_growth_rate"}
CUMULATIVE_NAV = {"净值日期": "date", "累计净值": "cumulative_nav"}
DAILY_BARS = {"日期": "date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "change_pct", "涨跌额": "change_amount", "换手率": "turnover"}
#: Days since the last cached row up to which a provider's period label suffices.
PERIODS = ((31, "1月"), (92, "3月"), (183, "6月"), (366, "1年"), (1098, "3年"), (1830, "5年"))
OVERLAP_DAYS = 15


def pad_code(c: Column) -> Column:
    """Six digits at least; longer codes stay whole."""
    c = F.trim(c.cast("string"))
    return F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def keep_last(df: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """One row per key, the one with the largest ordinal."""
    w = Window.partitionBy(*keys).orderBy(ordinal.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normalize(df: DataFrame, ordinal: str, code_width: int = 6) -> DataFrame:
    """Typed, de-duplicated price rows: unreadable dates or prices go, the last row of a (date, code) stays.

    ``ordinal`` names a column that tells the rows' original order. A missing required column raises.
    """
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    numbers = [c for c in ("nav", "cumulative_nav", "daily_growth_rate") if c in df.columns]
    out = df.withColumns({"date": F.try_to_date(F.col("date").cast("string")), "code": pad_code(F.col("code")), **{c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in numbers}})
    return keep_last(out.dropna(subset=["date", "nav"]), ["date", "code"], F.col(ordinal)).drop(ordinal)


def standardize(df: DataFrame, names: dict[str, str], columns: list[str], code: str, ordinal: str | None = None) -> DataFrame:
    """A provider's frame in standard columns: renamed, typed, rows without any number dropped, of a date the last row.

    ``ordinal`` names a column that tells the rows' order; without it the table's own order counts.
    """
    df = rename_existing(df, names)
    numbers = [c for c in columns if c != "date" and c in df.columns]
    nth = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    out = df.select(F.try_to_date(F.col("date").cast("string")).alias("date"), F.lit(code).alias("code"), *(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in numbers), nth.alias("_nth"))
    if "close" in numbers and "price" not in numbers:
        out, numbers = out.withColumn("price", F.col("close")), [*numbers, "price"]
    return keep_last(out.where("date is not null").dropna(how="all", subset=numbers), ["date"], F.col("_nth")).drop("_nth")


def single_fund(df: DataFrame, code: str) -> DataFrame:
    out = df.where(F.col("code") == code)
    if out.isEmpty():
        raise ValueError(f"no rows of code {code}")
    return out


def upsert(cached: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both, of a key in both the incoming one."""
    both = cached.withColumn("_age", F.lit(0)).unionByName(incoming.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, F.col("_age")).drop("_age")


def incremental_start(cached: DataFrame) -> DataFrame:
    """``code, last_date, start_date``: where to fetch from again."""
    return cached.groupBy("code").agg(F.max("date").alias("last_date")).withColumn("start_date", F.date_sub("last_date", OVERLAP_DAYS))


def fetch_period(days: Column) -> Column:
    """The shortest provider period that covers the days."""
    out = F.when(days <= PERIODS[0][0], PERIODS[0][1])
    for limit, name in PERIODS[1:]:
        out = out.when(days <= limit, name)
    return out.otherwise("成立来")


def yearly_windows(df: DataFrame, days: int = 364) -> DataFrame:
    """``code, start, end`` of consecutive stretches of at most ``days`` + 1 days from a code's first to its last date."""
    spans = df.groupBy("code").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first = F.explode(F.sequence("a", "b", F.expr(f"interval {days + 1} days")))
    return spans.select("code", first.alias("start"), "b").select("code", "start", F.least(F.date_add("start", days), F.col("b")).alias("end"))


def yield_curve(df: DataFrame, name: str, tenor: str, name_col: str = "曲线名称", date_col: str = "日期") -> DataFrame:
    """``date, annual_rf`` as a fraction, of a date the last row of the table."""
    rows = df.select("*", F.monotonically_increasing_id().alias("_nth")).where(F.col(name_col) == name)
    rows = rows.select(F.try_to_date(F.col(date_col).cast("string")).alias("date"), (F.col(tenor).try_cast("double") / 100).alias("annual_rf"), "_nth")
    return keep_last(rows.dropna(), ["date"], F.col("_nth")).drop("_nth")


def read_prices(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A cached price table, Parquet or CSV by its ending."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.parquet(path)


def write_prices(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.partitionBy("code").parquet(path)


def first_available(readers, *args):
    """The first reader's frame that is not empty; raises if none has rows."""
    for reader in readers:
        found = reader(*args)
        if found is not None and not found.isEmpty():
            return found
    raise ValueError("no source has rows")


def nav_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, date, nav``: mean price of shipped lines per flag, status and day, exact in cents."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("code"), F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return rows.groupBy("code", "date").agg((F.sum("cents").cast("double") / F.count("cents") / 100).alias("nav"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, date, open, high, low, volume`` of the lines per flag, status and day; the first line opens."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("code"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.col("l_quantity") * 100).cast("long").alias("q"))
    opening = F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    return rows.groupBy("code", "date").agg(opening.alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), (F.sum("q") / 100).cast("double").alias("volume"))


def cumulative_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, date, cumulative_nav``: mean price of orders' first lines per flag, status and day, exact in cents."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1").select(F.concat("l_returnflag", "l_linestatus").alias("code"), F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return rows.groupBy("code", "date").agg((F.sum("cents").cast("double") / F.count("cents") / 100).alias("cumulative_nav"))


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, annual_rf``: a made-up monthly curve over the months of the orders."""
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.trunc("o_orderdate", "MM").alias("date")).distinct()
    return months.withColumn("annual_rf", 0.01 + 0.0001 * F.month("date"))
