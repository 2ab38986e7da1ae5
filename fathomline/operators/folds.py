"""Chronological splits and walk-forward folds, as positions that series join to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.keeping import small

RATIOS, LEAST = (0.6, 0.2, 0.2), 60
WINDOW, STEP, STEP_RANGE = 700, 60, (75, 105)


def ratio_split(n: int, ratios: tuple[float, float, float] = RATIOS, least: int = LEAST) -> dict[str, tuple[int, int]]:
    """Positions (start, end excluded) of train, valid and test in a series of n rows."""
    if abs(sum(ratios) - 1) > 1e-8:
        raise ValueError("ratios must add up to 1")
    a, b = int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))
    out = {"train": (0, a), "valid": (a, b), "test": (b, n)}
    if short := [k for k, (x, y) in out.items() if y - x < least]:
        raise ValueError(f"too few rows in {short}")
    return out


def dynamic_step(dev: int, window: int, low: int = STEP_RANGE[0], high: int = STEP_RANGE[1]) -> tuple[int, int, str]:
    """The largest step that divides what exceeds the window, else the one that leaves least: (step, rest, how)."""
    if window <= 0 or low <= 0 or low > high:
        raise ValueError("window and steps must be positive and ordered")
    if dev < window:
        raise ValueError("the window exceeds the rows")
    step = min(range(low, high + 1), key=lambda s: ((dev - window) % s, -s))
    rest = (dev - window) % step
    return step, rest, "min_tail_fallback" if rest else "exact_divisor"


def walk_forward(n: int, window: int = WINDOW, step: int = STEP, ratios: tuple[float, float, float] = RATIOS, least: int = LEAST, min_folds: int = 1) -> list[tuple[int, str, int, int]]:
    """(fold, segment, start, end) of every full window."""
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    cut = ratio_split(window, ratios, least)
    out = [(k + 1, s, at + a, at + b) for k, at in enumerate(range(0, n - window + 1, step)) for s, (a, b) in cut.items()]
    if len(out) < 3 * min_folds:
        raise ValueError("too few folds")
    return out


def dev_folds(n: int, window: int = WINDOW, ratios: tuple[float, float, float] = RATIOS, least: int = LEAST, steps: tuple[int, int] = STEP_RANGE, min_folds: int = 1) -> list[tuple[int, str, int, int]]:
    """(fold, segment, start, end) of train and valid in the rows before the final test part."""
    dev = ratio_split(n, ratios, least)["valid"][1]
    step, _, _ = dynamic_step(dev, window, *steps)
    cut = min(max(round(window * (ratios[0] / (ratios[0] + ratios[1]))), 1), window - 1)
    if cut < least or window - cut < least:
        raise ValueError("too few rows in a segment")
    out = [(k + 1, s, at + a, at + b) for k, at in enumerate(range(0, dev - window + 1, step)) for s, a, b in (("train", 0, cut), ("valid", cut, window))]
    if len(out) < 2 * min_folds:
        raise ValueError("too few folds")
    return out


def fold_table(spark: SparkSession, df: DataFrame, make=dev_folds, by: str = "code", **options) -> DataFrame:
    """``n, fold_id, segment, start_pos, end_pos`` for each series length that occurs in ``df``.

    Only the distinct lengths go to the driver; series join on their length.
    """
    sizes = [r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select("n").distinct().collect()]
    rows = [(n, *f) for n in sizes for f in make(n, **options)]
    return spark.createDataFrame(rows, "n long, fold_id int, segment string, start_pos int, end_pos int")


def with_folds(df: DataFrame, folds: DataFrame, by: str = "code") -> DataFrame:
    """A row of ``df`` (``pos`` from 1) for each fold and segment that holds it."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.join(F.broadcast(folds), "n").drop("n")  # folds of each distinct length
    at = F.col("pos") - 1
    return df.join(small(spans), by).where((at >= F.col("start_pos")) & (at < F.col("end_pos")))


def context_split(df: DataFrame, train_ratio: float = 0.8, context: int = 0) -> DataFrame:
    """Rows with ``segment``; the valid part may repeat the ``context`` rows before it (``context`` true) for warm-up."""
    sizes = df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    out = df.join(small(sizes), "code").withColumn("cut", F.floor(F.col("n") * train_ratio).cast("long"))
    train = out.where(F.col("pos") <= F.col("cut")).withColumn("segment", F.lit("train")).withColumn("context", F.lit(False))
    valid = out.where(F.col("pos") > F.col("cut") - context).withColumn("segment", F.lit("valid")).withColumn("context", F.col("pos") <= F.col("cut"))
    return train.unionByName(valid).drop("n", "cut")
