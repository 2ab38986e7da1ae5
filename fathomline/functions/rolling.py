"""Rolling expressions that are null until their window holds n values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*by: str, order: str = "date") -> WindowSpec:
    """One ordered series per key."""
    return Window.partitionBy(*by).orderBy(order)


def full(fn: Callable[..., Column], x: Column, n: int, w: WindowSpec, *more: Column) -> Column:
    """``fn`` over the last n rows, null while fewer than n of them hold a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, fn(x, *more).over(frame))


def before(fn: Callable[..., Column], x: Column, n: int, w: WindowSpec) -> Column:
    """``fn`` over the n rows before this one, null while fewer than n of them hold a value."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change over n rows; missing values are not padded."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def standard(c: Column, n: int, w: WindowSpec) -> Column:
    """Rolling z-score with population deviation; undefined values become 0."""
    return F.coalesce(F.try_divide(c - full(F.avg, c, n, w), F.nullif(full(F.stddev_pop, c, n, w), F.lit(0.0))), F.lit(0.0))


def zscore(df: DataFrame, x: str, n: int, into: str, w: WindowSpec) -> DataFrame:
    """``df`` with the rolling z-score of a column."""
    return df.withColumn(into, standard(F.col(x), n, w))


def average_rank(partition: list[str], by: Column, descending: bool = False) -> Column:
    """Rank in which ties share their mean rank. Nulls rank last and should be filtered or masked."""
    order = by.desc_nulls_last() if descending else by.asc_nulls_last()
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, by)) - 1) / 2.0


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
