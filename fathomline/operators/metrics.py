"""Return and risk figures of equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.keeping import small
from fathomline.functions.rolling import change, series

YEAR = 252.0


def drawdown(equity: Column, *by: str) -> Column:
    """Loss from the highest value so far."""
    return equity / F.max(equity).over(series(*by).rowsBetween(Window.unboundedPreceding, 0)) - 1


def return_metrics(df: DataFrame, by: list[str], equity: str = "equity", rf: str | None = None, mean: bool = False) -> DataFrame:
    """``cumulative_return, annual_return, annual_volatility, sharpe, max_drawdown`` per group.

    ``rf`` names a column with the daily risk-free rate. A group with a single value has zeros. ``mean`` adds
    ``mean_daily_return``.
    """
    rows = df.where(F.col(equity).isNotNull())
    rows = rows.withColumn("_ret", change(F.col(equity), 1, series(*by))).withColumn("_dd", drawdown(F.col(equity), *by))
    rows = rows.withColumn("_excess", F.col("_ret") - (F.col(rf) if rf else F.lit(0.0)))
    out = rows.groupBy(*by).agg((F.try_divide(F.max_by(equity, "date"), F.min_by(equity, "date")) - 1).alias("cumulative_return"), F.count("_ret").alias("_n"), F.avg("_ret").alias("_daily"), F.stddev_pop("_ret").alias("_sd"), F.avg("_excess").alias("_mean"), F.stddev_pop("_excess").alias("_esd"), F.min("_dd").alias("_mdd"))
    some = F.col("_n") > 0
    annual = F.pow(1 + F.col("cumulative_return"), YEAR / F.greatest(F.col("_n"), F.lit(1))) - 1
    sharpe = F.coalesce(F.try_divide(F.col("_mean"), F.when(F.col("_esd") > 0, F.col("_esd"))) * F.sqrt(F.lit(YEAR)), F.lit(0.0))
    zero = F.lit(0.0)
    return out.select(*by, "cumulative_return", F.when(some, annual).otherwise(zero).alias("annual_return"), F.when(some, F.col("_sd") * F.sqrt(F.lit(YEAR))).otherwise(zero).alias("annual_volatility"), F.when(some, sharpe).otherwise(zero).alias("sharpe"), F.when(some, F.col("_mdd")).otherwise(zero).alias("max_drawdown"), *([F.coalesce("_daily", zero).alias("mean_daily_return")] if mean else []))


def segment_metrics(df: DataFrame, bounds: DataFrame, by: list[str], mean: bool = False) -> DataFrame:
    """Metrics of each ``segment`` of ``bounds(code, segment, start_pos, end_pos)``, positions from 0, end excluded.

    ``by`` may name further columns of ``bounds``, such as a fold.

    The row before a segment is added, so its first return counts. ``df`` has ``pos`` from 1.
    """
    inside = (F.col("pos") - 1 >= F.col("start_pos") - 1) & (F.col("pos") - 1 < F.col("end_pos"))
    rows = df.join(small(bounds), "code").where(inside)
    return return_metrics(rows, [*by, "segment"], mean=mean)


def mean_daily_return(df: DataFrame, by: list[str], equity: str = "equity") -> DataFrame:
    rows = df.withColumn("_ret", change(F.col(equity), 1, series(*by)))
    return rows.groupBy(*by).agg(F.coalesce(F.avg("_ret"), F.lit(0.0)).alias("mean_daily_return"))


def normalized_curve(df: DataFrame, by: list[str], equity: str = "equity", benchmark: str = "nav") -> DataFrame:
    """What an equity plot shows: strategy and price, both from 1."""
    w = series(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*by, "date", (F.col(equity) / F.first(equity).over(w)).alias("strategy"), (F.col(benchmark) / F.first(benchmark).over(w)).alias("fund"))


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    """One row over ``folds(test_*, train_mean, test_mean)``: mean, median, deviation, worst case, efficiency."""
    aggs = []
    for m, worst in (("sharpe", F.min), ("annual_return", F.min), ("max_drawdown", F.min), ("annual_volatility", F.max)):
        c = F.col(f"test_{m}")
        aggs += [F.avg(c).alias(f"{m}_mean"), F.percentile(c, 0.5).alias(f"{m}_median"), F.stddev_pop(c).alias(f"{m}_std"), worst(c).alias(f"{m}_worst")]
    aggs += [F.avg((F.col("test_cumulative_return") > 0).cast("double")).alias("positive_return_ratio"), F.count(F.lit(1)).alias("folds")]
    train = F.avg("train_mean")
    return folds.agg(*aggs, F.try_divide(F.avg("test_mean"), F.when(F.abs(train) > 1e-12, train)).alias("efficiency"))
