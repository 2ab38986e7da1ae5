"""Information coefficients by fold, their summaries, and what they decide about candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.rolling import average_rank, safe_corr

TINY = 1e-12


def by_fold(rows: DataFrame, keys: list[str], value: str = "value", target: str = "fwd") -> DataFrame:
    """``n, spearman_ic, pearson_ic`` of each key, over the rows where both sides are known; null under 2 rows."""
    both = rows.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    both = both.withColumn("_a", average_rank(keys, F.col(value))).withColumn("_b", average_rank(keys, F.col(target)))
    n = F.count(F.lit(1))
    return both.groupBy(*keys).agg(n.alias("n"), F.when(n >= 2, safe_corr(F.col("_a"), F.col("_b"))).alias("spearman_ic"), F.when(n >= 2, safe_corr(F.col(value), F.col(target))).alias("pearson_ic"))


def icir(mean: Column, std: Column) -> Column:
    return F.when(std > TINY, F.try_divide(mean, std)).otherwise(F.lit(0.0))


def summary(ics: DataFrame, keys: list[str], ic: str = "spearman_ic") -> DataFrame:
    """``folds, ic_mean, ic_std, icir`` over the folds with a value."""
    out = ics.groupBy(*keys).agg(F.count(ic).alias("folds"), F.avg(ic).alias("ic_mean"), F.stddev_pop(ic).alias("ic_std"))
    return out.withColumn("icir", F.coalesce(icir(F.col("ic_mean"), F.col("ic_std")), F.lit(0.0)))


def weighted_summary(ics: DataFrame, keys: list[str], half_life: float = 3.0, ic: str = "spearman_ic") -> DataFrame:
    """The same with the latest fold weighing most, its weight halving every ``half_life`` folds with a value."""
    known = ics.where(F.col(ic).isNotNull())
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fold_id"))) - 1
    known = known.withColumn("_w", F.pow(F.lit(0.5), back / half_life))
    w = Window.partitionBy(*keys)
    known = known.withColumn("_m", F.sum(F.col("_w") * F.col(ic)).over(w) / F.sum("_w").over(w))
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.first("_m").alias("ic_mean"), F.sqrt(F.sum(F.col("_w") * F.pow(F.col(ic) - F.col("_m"), 2)) / F.sum("_w")).alias("ic_std"))
    return out.withColumn("icir", icir(F.col("ic_mean"), F.col("ic_std")))


def positive_ratio(ics: DataFrame, keys: list[str], ic: str = "spearman_ic") -> DataFrame:
    share = F.avg(F.when(F.col(ic).isNotNull(), (F.col(ic) > 0).cast("double")))
    return ics.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("positive_ratio"))


def trimmed_mean(ics: DataFrame, keys: list[str], ratio: float = 0.1, ic: str = "spearman_ic") -> DataFrame:
    """Mean without the floor(n * ratio) smallest and largest; the plain mean if that would leave none."""
    known = ics.where(F.col(ic).isNotNull())
    w = Window.partitionBy(*keys)
    known = known.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(ic)))
    cut = F.floor(F.col("_n") * ratio)
    inside = (F.col("_n") <= 2 * cut) | ((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return known.where(inside).groupBy(*keys).agg(F.avg(ic).alias("trimmed_mean"))


def flip_count(ics: DataFrame, keys: list[str], ic: str = "spearman_ic") -> DataFrame:
    """Changes of sign along the folds, nulls and zeros skipped."""
    known = ics.where(F.abs(ic) > TINY).withColumn("_s", F.signum(ic))
    flips = (F.col("_s") != F.lag("_s").over(Window.partitionBy(*keys).orderBy("fold_id"))).cast("long")
    return known.withColumn("_f", flips).groupBy(*keys).agg(F.coalesce(F.sum("_f"), F.lit(0)).cast("long").alias("flips"))


def tail_reject(df: DataFrame, metrics: list[str], ratio: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``tail_rejected``: among the floor(n * ratio) largest of any metric, ties with the last of them included."""
    out, bad = df, F.lit(False)
    for m in metrics:
        w = Window.partitionBy(*(by or []))
        out = out.withColumn("_k", F.floor(F.count(m).over(w) * ratio)).withColumn("_r", F.row_number().over(w.orderBy(F.col(m).desc_nulls_last())))
        out = out.withColumn(f"_t_{m}", F.max(F.when((F.col("_r") == F.col("_k")) & (F.col("_k") > 0), F.col(m))).over(w))
        bad = bad | F.coalesce(F.col(m) >= F.col(f"_t_{m}"), F.lit(False))
    return out.withColumn("tail_rejected", bad).drop("_k", "_r", *(f"_t_{m}" for m in metrics))


def candidate_summary(ics: DataFrame, keys: list[str], ic: str = "spearman_ic") -> DataFrame:
    """Train and valid figures of each candidate in one row, from one pass over the folds."""
    aggs, both = [], F.lit(True)
    for s in ("train", "valid"):
        x = F.when(F.col("segment") == s, F.col(ic))
        mean, share = F.avg(x), F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))
        aggs += [mean.alias(f"{s}_ic_mean"), F.coalesce(icir(mean, F.stddev_pop(x)), F.lit(0.0)).alias(f"{s}_icir"), F.coalesce(share, F.lit(0.0)).alias(f"{s}_positive_ratio"), F.count_if(F.col("segment") == s).alias(f"_{s}")]
        both = both & (F.col(f"_{s}") > 0)
    return ics.groupBy(*keys).agg(*aggs).where(both).drop("_train", "_valid")


def select_factors(summaries: DataFrame, min_ic: float = 0.0, min_icir: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """``train_passed, valid_passed, selected, final_rank`` by the pass rules."""
    train = (F.col("train_ic_mean") >= min_ic) & (F.col("train_icir") >= min_icir) & (F.col("train_positive_ratio") > 0.5)
    valid = (F.col("valid_ic_mean") > 0) & (F.col("valid_icir") > 0) & (F.col("valid_positive_ratio") > 0.5)
    out = summaries.withColumn("train_passed", F.coalesce(train, F.lit(False))).withColumn("valid_passed", F.coalesce(valid, F.lit(False)))
    out = out.withColumn("selected", F.col("train_passed") & F.col("valid_passed"))
    order = [F.col(c).desc_nulls_last() for c in ("train_passed", "valid_passed", "valid_icir", "valid_ic_mean", "train_icir")]
    place = F.row_number().over(Window.partitionBy(*(by or []), "selected").orderBy(*order, "candidate_label"))
    return out.withColumn("final_rank", F.when(F.col("selected"), place))


def stability(ics: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Gaps and flips of each candidate, the tail rejected, ranked."""
    trimmed = trimmed_mean(ics, [*keys, "segment"])
    trimmed = trimmed.groupBy(*keys).agg(*(F.max(F.when(F.col("segment") == s, F.col("trimmed_mean"))).alias(f"{s}_trimmed") for s in ("train", "valid")))
    out = candidate_summary(ics, keys).join(trimmed, keys)
    out = out.join(flip_count(ics.where("segment = 'valid'"), keys).withColumnRenamed("flips", "valid_ic_flip_count"), keys, "left").fillna(0, ["valid_ic_flip_count"])
    out = out.withColumn("train_valid_ic_mean_gap", F.abs(F.col("train_ic_mean") - F.col("valid_ic_mean"))).withColumn("valid_trimmed_ic_gap", F.abs(F.col("valid_ic_mean") - F.col("valid_trimmed")))
    out = tail_reject(out, ["train_valid_ic_mean_gap", "valid_ic_flip_count", "valid_trimmed_ic_gap"], by=by)
    order = [F.col("tail_rejected").asc(), F.desc("valid_ic_mean"), F.desc("valid_icir"), F.asc("train_valid_ic_mean_gap"), F.asc("valid_ic_flip_count"), F.asc("valid_trimmed_ic_gap"), F.asc("candidate_label")]
    return out.withColumn("stability_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def flip_candidates(ics: DataFrame, keys: list[str]) -> DataFrame:
    """``negative, positive, flipped``: whether a candidate predicts the opposite in training."""
    train = ics.where("segment = 'train'")
    out = train.groupBy(*keys).agg(F.avg("spearman_ic").alias("ic_mean"), F.count_if(F.col("spearman_ic") < 0).alias("negative"), F.count_if(F.col("spearman_ic") > 0).alias("positive"))
    return out.withColumn("flipped", (F.col("ic_mean") < 0) & (F.col("negative") > F.col("positive")))


def quality(rows: DataFrame, keys: list[str], raw: str = "raw", normal: str = "value", null_limit: float = 0.2, zero_limit: float = 0.8) -> DataFrame:
    """``raw_null_ratio, zero_ratio, dropped`` of each candidate."""
    out = rows.groupBy(*keys).agg(F.avg(F.col(raw).isNull().cast("double")).alias("raw_null_ratio"), F.avg((F.col(normal) == 0).cast("double")).alias("zero_ratio"))
    return out.withColumn("dropped", (F.col("raw_null_ratio") > null_limit) | (F.col("zero_ratio") > zero_limit))
