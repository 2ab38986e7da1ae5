"""Correlated candidates, and the level-wise search for combinations."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.keeping import kept
from fathomline.functions.rolling import safe_corr
from fathomline.operators import ic, packed, sampler


def pair_correlations(wide: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """``keys, a, b, corr`` for every pair of columns a < b, over rows where both are known.

    One aggregate with a cell for each pair: the rows are read once and only the sums are shuffled.
    """
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    cells = wide.groupBy(*keys).agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("corr")) for a, b in pairs)).alias("_p"))
    return cells.select(*keys, F.explode("_p").alias("_p")).select(*keys, "_p.a", "_p.b", "_p.corr")


def mean_fold_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "a", "b").agg(F.avg("corr").alias("mean_corr"))


def _weaker(metrics: list[str]) -> Column:
    """The label that loses: the first metric that differs decides, a null loses, else the greater label."""
    out = F.greatest("a", "b")
    for m in reversed(metrics):
        x, y = F.col(f"a_{m}"), F.col(f"b_{m}")
        differs = F.when(x.isNull() & y.isNotNull(), F.col("a")).when(y.isNull() & x.isNotNull(), F.col("b")).when(x < y, F.col("a")).when(y < x, F.col("b"))
        out = F.coalesce(differs, out)
    return out


def corr_losers(pairs: DataFrame, summaries: DataFrame, by: list[str], limit: float = 0.9) -> DataFrame:
    """``candidate_label, losses, max_abs_corr``: candidates that lose to a highly correlated one."""
    metrics = ["train_icir", "valid_icir", "valid_ic_mean"]
    out = pairs.where(F.abs("mean_corr") >= limit)
    for side in ("a", "b"):
        out = out.join(summaries.select(*by, F.col("candidate_label").alias(side), *(F.col(m).alias(f"{side}_{m}") for m in metrics)), [*by, side])
    return out.withColumn("candidate_label", _weaker(metrics)).groupBy(*by, "candidate_label").agg(F.count(F.lit(1)).alias("losses"), F.max(F.abs("mean_corr")).alias("max_abs_corr"))


def corr_drop(losers: DataFrame, summaries: DataFrame, by: list[str]) -> DataFrame:
    """Of the losers max(2, a tenth of all candidates), those with most losses and weakest figures."""
    n = summaries.groupBy(*by).agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * 0.1)).alias("quota"))
    rows = losers.join(summaries.select(*by, "candidate_label", "train_icir", "valid_icir"), [*by, "candidate_label"]).join(n, by)
    order = [F.desc("losses"), F.asc_nulls_first("train_icir"), F.asc_nulls_first("valid_icir"), F.asc("candidate_label")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("place <= quota").drop("quota")


def forward_search(spark: SparkSession, long: DataFrame, summaries: DataFrame, by: list[str], roots: int = 3, levels: int | None = None) -> DataFrame:
    """``labels, factor_count, train_*, valid_*`` of every subset tried.

    Starts from the best ``roots`` candidates; a level adds one candidate to every subset of the last one
    and keeps for the next what is at least as good in training as the parent it came from. It goes on until
    nothing is left to extend (or for ``levels`` levels). ``long`` may be packed already; a parent's scores
    are summed once for all its children.
    """
    w, packs, summaries = Window.partitionBy(*by), packed.pack(long, by), kept(summaries)
    first = summaries.withColumn("_n", F.row_number().over(w.orderBy(F.desc_nulls_last("train_icir"), "candidate_label"))).where(F.col("_n") <= roots)
    nothing = F.array().cast("array<string>")
    children = kept(first.select(*by, F.array("candidate_label").alias("labels"), F.col("candidate_label").alias("subset_id"), F.col("candidate_label").alias("added"), F.lit("").alias("parent"), nothing.alias("base"), F.lit(None).cast("double").alias("parent_icir")))
    singles, done = summaries.select(*by, F.col("candidate_label").alias("_c")), None
    for k in itertools.count() if levels is None else range(levels):
        asks = kept(children.groupBy(*by, "parent", F.col("base").alias("labels")).agg(F.collect_list(F.struct("subset_id", "added")).alias("_x")))
        asks = asks.select(*by, F.transform("_x", lambda x: x["subset_id"]).alias("ids"), "labels", F.transform("_x", lambda x: x["added"]).alias("added"), F.lit(None).cast("array<double>").alias("weights"))
        found = ic.candidate_summary(packed.evaluate(packs, asks, by, asks.count()), [*by, "subset_id"])
        scored = children.drop("parent", "base", "added").join(found, [*by, "subset_id"])
        scored = kept(scored.withColumn("factor_count", F.size("labels")).withColumn("step", F.lit(k + 1)))
        done = scored if done is None else done.unionByName(scored)
        better = scored.where(F.col("parent_icir").isNull() | (F.col("train_icir") >= F.col("parent_icir")))
        grown = better.join(singles, by).where(~F.array_contains("labels", F.col("_c")))
        grown = grown.select(*by, F.array_sort(F.array_append("labels", F.col("_c"))).alias("labels"), F.col("_c").alias("added"), F.col("subset_id").alias("parent"), F.col("labels").alias("base"), F.col("train_icir").alias("parent_icir"))
        best = Window.partitionBy(*by, "labels").orderBy(F.desc("parent_icir"), "parent")
        children = kept(grown.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("subset_id", F.concat_ws("|", "labels")))
        if children.isEmpty():
            break
    return done.drop("parent_icir")


def top_train_paths(paths: DataFrame, by: list[str], ratio: float = 0.5) -> DataFrame:
    """The better part of the paths by training figures, one at least."""
    order = [F.desc_nulls_last("train_icir"), F.desc_nulls_last("train_ic_mean"), F.asc("factor_count"), F.asc("step"), F.asc("subset_id")]
    w = Window.partitionBy(*by)
    out = paths.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * ratio)))
    return out.where("_n <= _k").drop("_n", "_k")


def best_path(paths: DataFrame, by: list[str]) -> DataFrame:
    order = [F.desc_nulls_last("valid_icir"), F.desc_nulls_last("valid_ic_mean"), F.desc_nulls_last("train_icir"), F.asc("factor_count"), F.asc("step"), F.asc("subset_id")]
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def extension_search(long: DataFrame, summaries: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """``by, subset_id, labels, factor_count, step, train_*, valid_*, source, is_final`` of a baseline and what extends it.

    ``baseline`` holds one best path a key. A study of as many trials as the square of the number of candidates
    outside it decides for each of them whether to add it, by training ICIR. Subsets better in training than
    the baseline stay; the best of them in validation and the baseline are compared by the same order.
    """
    packs, baseline = packed.pack(long, by), kept(baseline)
    rest = summaries.select(*by, "candidate_label").join(baseline.select(*by, F.col("labels").alias("_base")), by).where(~F.array_contains("_base", F.col("candidate_label")))
    rest = kept(rest.groupBy(*by, "_base").agg(F.array_sort(F.collect_list("candidate_label")).alias("_rest")))  # candidates of one key
    most = rest.agg(F.max(F.size("_rest"))).first()[0]
    columns = [*by, "subset_id", "labels", "factor_count", "step", "train_ic_mean", "train_icir", "valid_ic_mean", "valid_icir", "source"]
    every = baseline.withColumn("source", F.lit("forward")).select(*columns)
    if most:

        def evaluate(proposed: DataFrame) -> DataFrame:
            asked = proposed.join(rest, by).where(F.col("trial_number") < F.size("_rest") * F.size("_rest"))
            added = F.filter("_rest", lambda x, i: F.col("u")[i] > 0.5)
            asked = asked.withColumn("labels", F.array_sort(F.array_union("_base", added))).withColumn("subset_id", F.concat_ws("|", "labels"))
            asked = asked.where(F.size("labels") > F.size("_base"))
            distinct = kept(asked.select(*by, "subset_id", "labels").distinct())
            found = ic.candidate_summary(packed.subset_ics(packs, distinct, by), [*by, "subset_id"])
            return asked.drop("_base", "_rest").join(found, [*by, "subset_id"]).withColumn("value", F.col("train_icir"))

        keys = rest.select(*by, F.transform("_rest", lambda x: F.lit(2)).alias("kinds"))
        batch = max(sampler.ROUND, -(-most * most // 6))
        tried = sampler.study(keys, by, evaluate, most * most, max(sampler.STARTUP, most * most // 4), batch)
        found = tried.dropDuplicates([*by, "subset_id"]).withColumn("factor_count", F.size("labels")).withColumn("step", F.size("labels")).withColumn("source", F.lit("extension"))
        better = found.join(baseline.select(*by, F.col("train_icir").alias("_floor")), by).where(F.col("train_icir") > F.col("_floor"))
        every = every.unionByName(better.select(*columns))
    every = kept(every)
    final = best_path(every, by).select(*by, F.col("subset_id").alias("_final"))
    return every.join(final, by).withColumn("is_final", F.col("subset_id") == F.col("_final")).drop("_final")


def equal_weights(summaries: DataFrame, by: list[str]) -> DataFrame:
    return summaries.select(*by, "candidate_label", F.try_divide(F.lit(1.0), F.count(F.lit(1)).over(Window.partitionBy(*by))).alias("weight"))


def icir_weights(summaries: DataFrame, by: list[str], icir: str = "train_icir") -> DataFrame:
    """Shares of the positive ICIRs; equal if none is positive."""
    w = Window.partitionBy(*by)
    part = F.greatest(F.coalesce(icir, F.lit(0.0)), F.lit(0.0))
    total, n = F.sum(part).over(w), F.count(F.lit(1)).over(w)
    return summaries.select(*by, "candidate_label", F.when(total <= 1e-12, 1.0 / n).otherwise(F.try_divide(part, total)).alias("weight"))


def weight_box(weight: Column, share: float = 0.05) -> tuple[Column, Column]:
    """Search range of a weight."""
    return weight * (1 - share), weight * (1 + share)
