"""Operators on panels of series: shape, alignment, gaps, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.keeping import small
from fathomline.functions.rolling import average_rank, series


def pivot(df: DataFrame, codes: list[str], value: str = "nav") -> DataFrame:
    """Wide ``date`` x code; a (date, code) that occurs twice raises."""
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("duplicate (date, code)")).cast("double")).otherwise(F.first(value))
    return df.groupBy("date").pivot("code", codes).agg(cell)


def common_range(df: DataFrame) -> DataFrame:
    """Rows of the dates on which every code has a value, from the latest first date to the earliest last one."""
    df = df.where("nav is not null")
    spans = df.groupBy("code").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    bounds = spans.agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("codes"))
    days = df.groupBy("date").agg(F.count_distinct("code").alias("n")).join(F.broadcast(bounds), (F.col("n") == F.col("codes")) & F.col("date").between(F.col("a"), F.col("b")))
    return df.join(days.select("date"), "date", "left_semi")


def on_spine(df: DataFrame, primary: str, value: str = "nav") -> DataFrame:
    """Every other code's values on the dates of the primary one: ``date, code, value`` with gaps null."""
    spine = df.where(F.col("code") == primary).select("date")
    codes = df.select("code").distinct()
    return spine.crossJoin(small(codes)).join(df.select("date", "code", F.col(value).alias("value")), ["date", "code"], "left")


def fill_by_neighbors(df: DataFrame, most: int = 4, value: str = "value") -> DataFrame:
    """Isolated gaps become the mean of their neighbours, if a code has at most ``most`` and none adjoin.

    A gap at an end of the series, or beside another gap, stays. Adds ``filled``.
    """
    w, whole = series("code"), Window.partitionBy("code")
    gap = F.col(value).isNull()
    out = df.withColumn("_gap", gap).withColumn("_run", gap & F.coalesce(F.lag(gap).over(w), F.lit(False)))
    ok = (F.sum(F.col("_gap").cast("int")).over(whole) <= most) & ~F.bool_or("_run").over(whole)
    mean = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    out = out.withColumn("_fill", F.when(F.col("_gap") & ok, mean))
    return out.withColumn("filled", F.col("_fill").isNotNull()).withColumn(value, F.coalesce(value, "_fill")).drop("_gap", "_run", "_fill")


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "candidate_label", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def forward_return(df: DataFrame, horizon: int = 5, price: str = "nav", into: str = "fwd") -> DataFrame:
    """Return over the next ``horizon`` rows that have a price."""
    w = series("code")
    return df.where(F.col(price).isNotNull()).withColumn(into, F.try_divide(F.lead(price, horizon).over(w), F.col(price)) - 1)


def future_rank(df: DataFrame, horizon: int = 7) -> DataFrame:
    """``future_rank``: place of a code's forward return among the codes of a date, best 1, ties averaged."""
    out = forward_return(df, horizon)
    return out.withColumn("future_rank", F.when(F.col("fwd").isNotNull(), average_rank(["date"], F.col("fwd"), descending=True)))


def asof_rates(returns: DataFrame, rates: DataFrame, days: float = 252.0) -> DataFrame:
    """``returns(code, date, ...)`` with ``rf``: the daily rate of the latest curve date, or of the first one.

    Only the calendar's days are put in order (both sides' distinct dates); the rows then join on their date.
    """
    days_seen = returns.select("date").where("date is not null").distinct().select("date", F.lit(None).cast("double").alias("annual_rf"), F.lit(True).alias("asked"))
    marks = days_seen.unionByName(rates.select("date", "annual_rf", F.lit(False).alias("asked")))
    w = Window.orderBy("date", "asked")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(~F.col("asked"), F.struct("annual_rf"))
    marks = marks.withColumn("known", F.coalesce(F.last(known, ignorenulls=True).over(upto), F.first(known, ignorenulls=True).over(after)))
    table = marks.where("asked").select("date", F.col("known.annual_rf").alias("_rf"))
    out = returns.join(small(table), "date", "left")
    return out.withColumn("rf", F.pow(1 + F.col("_rf"), F.lit(1 / days)) - 1).drop("_rf")


def lookback_samples(df: DataFrame, lookback: int, ret: str = "ret") -> DataFrame:
    """``code, date, x, y``: the last ``lookback`` returns and the one that follows, both complete."""
    w = series("code").rowsBetween(-lookback, -1)
    out = df.select("code", "date", F.collect_list(ret).over(w).alias("x"), F.col(ret).alias("y"))
    return out.where((F.size("x") == lookback) & F.col("y").isNotNull())


def cross_section_top(df: DataFrame, k: int, score: str = "score", floor: float | None = None) -> DataFrame:
    """The k codes with the highest score of each date (ties to the smaller code), above ``floor`` if given."""
    w = Window.partitionBy("date").orderBy(F.col(score).desc(), "code")
    out = df.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out if floor is None else out.where(F.col(score) > floor)


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("size"))


def rank_ic(df: DataFrame, predicted: str, actual_rank: str) -> DataFrame:
    """``mean_rank_ic, days``: mean over dates of the correlation of predicted order and actual rank."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual_rank).isNotNull())
    rows = rows.withColumn("_a", average_rank(["date"], F.col(predicted), descending=True)).withColumn("_b", average_rank(["date"], F.col(actual_rank)))
    deviation = F.stddev_pop("_a") * F.stddev_pop("_b")
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_a", "_b"), F.when(F.least(F.stddev_pop("_a"), F.stddev_pop("_b")) >= 1e-12, deviation)).alias("ic"))
    return days.where("n >= 2 and ic is not null").agg(F.avg("ic").alias("mean_rank_ic"), F.count(F.lit(1)).alias("days"))
