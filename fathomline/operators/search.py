"""Parameter search: adaptive studies whose rounds are evaluated together, and the rules that choose among trials."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import chunks, factors, kernels
from fathomline.functions.keeping import kept
from fathomline.operators import ic, metrics, packed, positions, sampler, selection, signals


def objective(sharpe: Column, max_drawdown: Column, penalty: float = 0.2) -> Column:
    return sharpe - penalty * F.abs(F.least(F.lit(0.0), max_drawdown))


def top_trials(trials: DataFrame, by: list[str] | None = None, least: int = 5, ratio: float = 0.2) -> DataFrame:
    """The best max(least, ratio) trials by value."""
    w = Window.partitionBy(*(by or []))
    out = trials.withColumn("_k", F.greatest(F.lit(least), F.floor(F.count(F.lit(1)).over(w) * ratio)))
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("value"), "trial_number"))).where("place <= _k").drop("_k")


def running_best(trials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trials that beat all before them."""
    w = Window.partitionBy(*(by or [])).orderBy("trial_number").rowsBetween(Window.unboundedPreceding, -1)
    return trials.withColumn("_b", F.max("value").over(w)).where("value is not null and (_b is null or value > _b)").drop("_b")


# Search spaces of the strategies' parameters (low, high, step).
SPACES = {
    "ma_cross": {"fast": (3, 30, 1), "slow_over_fast": (5, 117, 1), "slow": (8, 120, 1)},
    "momentum": {"window": (5, 120, 1)},
    "multi_factor_score": {"entry_threshold": (-0.2, 1.0, 0.1), "exit_threshold": (-0.8, 0.2, 0.1)},
}


def _pick(u: float, low: float, high: float, step: float) -> float:
    """The value of a stepped range at the share u of it."""
    return low + step * min(int(u * (int((high - low) / step + 1e-9) + 1)), int((high - low) / step + 1e-9))


def _dimensions(strategy: str, base: dict) -> list[tuple[str, str, tuple[int, int, int]]]:
    """(factor, parameter, (low, high, step)) that multi_factor_score searches before its thresholds."""
    return [(name, p, factors.POOL[name].params[p][1:]) for name in base["factor_weight_dict"] for p in factors.POOL[name].params]


def kinds_of(strategy: str, base: dict | None = None) -> list[int]:
    """The number of values of each searched dimension, 0 where its range depends on another."""
    base = signals.params_of(strategy, base)
    if strategy == "ma_cross":
        low, high, _ = SPACES[strategy]["fast"]
        return [high - low + 1, 0]
    if strategy == "momentum":
        low, high, step = SPACES[strategy]["window"]
        return [(high - low) // step + 1]
    if strategy != "multi_factor_score":
        raise ValueError(f"{strategy} has no parameters to search")
    low, high, step = SPACES[strategy]["entry_threshold"]
    return [*((b - a) // c + 1 for _, _, (a, b, c) in _dimensions(strategy, base)), int((high - low) / step + 1e-9) + 1, 0]


def params_at(strategy: str, u: list[float], base: dict | None = None) -> dict:
    """The parameters at a point of the unit cube; an exit is never above its entry, a slow window never under fast + 5."""
    base = signals.params_of(strategy, base)
    if strategy == "ma_cross":
        fast = int(_pick(u[0], *SPACES[strategy]["fast"]))
        return {**base, "fast": fast, "slow": int(_pick(u[1], fast + SPACES[strategy]["slow_over_fast"][0], SPACES[strategy]["slow"][1], 1))}
    if strategy == "momentum":
        return {**base, "window": int(_pick(u[0], *SPACES[strategy]["window"]))}
    params: dict[str, dict[str, int]] = {k: dict(v) for k, v in base["factor_param_dict"].items()}
    for x, (name, p, space) in zip(u, _dimensions(strategy, base), strict=False):
        params.setdefault(name, {})[p] = int(_pick(x, *space))
    entry = round(_pick(u[-2], *SPACES[strategy]["entry_threshold"]), 10)
    low, high, step = SPACES[strategy]["exit_threshold"]
    return {**base, "factor_param_dict": params, "entry_threshold": entry, "exit_threshold": min(entry, round(_pick(u[-1], low, min(high, entry), step), 10))}


def trial_params(strategy: str, n: int, base: dict | None = None) -> list[dict]:
    """Parameters of the n trials that a study without results begins with."""
    return [params_at(strategy, u.tolist(), base) for u in sampler.spread(n, kinds_of(strategy, base))]


def _conditions(strategy: str, base: dict | None):
    """Rows of a chunk once for each variant of its series: whether the strategy would enter, and leave."""

    def run(rows: pa.Table, variants: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        own = int(np.searchsorted(rows.column("pos").to_numpy(), rows.column("_chunk")[0].as_py() * chunks.CHUNK_ROWS, side="right")) if rows.num_rows else 0
        of, held, out = kernels.Series(rows.column("nav").to_numpy().astype(float)), {}, []
        kept_rows = rows.slice(own).select(["code", "date", "pos", "nav"])
        with np.errstate(invalid="ignore"):
            for variant, u in zip(variants.column("variant").to_pylist(), variants.column("u").to_pylist(), strict=True):
                params = params_at(strategy, u, base)
                if strategy == "ma_cross":
                    fast, slow = of.price.mean(params["fast"]), of.price.mean(params["slow"])
                    enter, leave = fast > slow, fast < slow
                elif strategy == "momentum":
                    x = kernels.relative(of.price.x, params["window"])
                    enter, leave = x > 0, x <= 0
                else:
                    score = 0.0
                    for name, weight in params["factor_weight_dict"].items():
                        chosen = factors.resolve(name, params["factor_param_dict"].get(name))
                        key = (name, *chosen.values(), params["score_window"])
                        if key not in held:
                            held[key] = kernels.Rolled(of.factor(name, chosen["window"], chosen.get("lookback", 0))).standard(params["score_window"]) * (-1 if factors.POOL[name].inverted else 1)
                        score = score + held[key] * weight
                    enter, leave = score > params["entry_threshold"], score <= params["exit_threshold"]
                out.append(kept_rows.append_column("variant", pa.array(np.full(kept_rows.num_rows, variant), pa.int64())).append_column("_in", pa.array(enter[own:])).append_column("_out", pa.array(leave[own:])))
        return pa.concat_tables(out) if out else kept_rows.slice(0, 0).append_column("variant", pa.array([], pa.int64())).append_column("_in", pa.array([], pa.bool_())).append_column("_out", pa.array([], pa.bool_()))

    return run


def optimize(spark: SparkSession, panel: DataFrame, bounds: DataFrame, strategy: str = "ma_cross", n_trials: int = 30, base: dict | None = None) -> DataFrame:
    """Train, valid and test figures of every trial and code (and fold, where ``bounds`` names one), and the trial chosen.

    Each code (and fold) has an adaptive study of its own by training objective. Every trial runs over the
    whole series and its curve is cut afterwards, so no segment starts cold; trials that several folds propose
    run once. Candidates are the top trials and the running best by training objective; the best validation
    Sharpe wins.
    """
    by = ["code", *(c for c in ("fold_id",) if c in bounds.columns)]
    panel, bounds, kinds = kept(panel.select("code", "date", "pos", "nav")), kept(bounds), kinds_of(strategy, base)
    settings = signals.params_of(strategy, base)
    halo = 121 if strategy != "multi_factor_score" else max(spec[2] for f in factors.POOL.values() for spec in f.params.values()) + 21 + settings["score_window"]
    cut = chunks.overlapping(panel, halo)
    at = kept(cut.select("code", F.col("_chunk").alias("_part")).distinct())
    names = ("sharpe", "annual_return", "max_drawdown", "cumulative_return", "annual_volatility", "mean_daily_return")

    def evaluate(proposed: DataFrame) -> DataFrame:
        proposed = proposed.withColumn("variant", F.xxhash64("u"))
        variants = proposed.select("code", "variant", "u").dropDuplicates(["code", "variant"]).join(at, "code").withColumnRenamed("code", "_of")
        rows = cut.groupBy("code", "_chunk").cogroup(variants.groupBy("_of", "_part")).applyInArrow(_conditions(strategy, base), f"code {dict(panel.dtypes)['code']}, date {dict(panel.dtypes)['date']}, pos int, nav double, variant long, _in boolean, _out boolean")
        w = Window.partitionBy("code", "variant").orderBy("date")
        rows = rows.withColumns({"entries": signals.rising(F.col("_in"), w), "exits": signals.rising(F.col("_out"), w)}).drop("_in", "_out")
        curves = signals.backtest(rows, by=("code", "variant"))
        asked = proposed.select(*by, "trial_number", "variant").join(bounds, by)
        inside = (F.col("pos") - 1 >= F.col("start_pos") - 1) & (F.col("pos") - 1 < F.col("end_pos"))
        figures = metrics.return_metrics(curves.join(asked, ["code", "variant"]).where(inside), [*by, "trial_number", "segment"], mean=True)
        value = F.max(F.when(F.col("segment") == "train", objective(F.col("sharpe"), F.col("max_drawdown"))))
        wide = figures.groupBy(*by, "trial_number").agg(value.alias("value"), *(F.max(F.when(F.col("segment") == s, F.col(m))).alias(f"{s}_{m}") for s in ("train", "valid", "test") for m in names))
        return proposed.drop("variant").join(wide, [*by, "trial_number"])

    keys = bounds.select(*by).distinct().withColumn("kinds", F.array(*map(F.lit, kinds)))
    wide = sampler.study(keys, by, evaluate, n_trials)
    chosen = top_trials(wide, by).select(*by, "trial_number").union(running_best(wide, by).select(*by, "trial_number")).distinct()
    best = wide.join(chosen, [*by, "trial_number"])
    order = [F.desc_nulls_last("valid_sharpe"), F.desc_nulls_last("value"), F.asc("trial_number")]
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").select(*by, F.col("trial_number").alias("chosen"))

    def named(parts):
        for part in parts:
            found = [params_at(strategy, list(u), base) for u in part["u"]]
            part = part.drop(columns="u").assign(params=[json.dumps(t, sort_keys=True, ensure_ascii=False) for t in found])
            yield part.assign(**{c: pd.array([t.get(c) for t in found], dtype="Int32") for c in ("fast", "slow", "window")})

    out = wide.join(best, by).withColumn("is_best", F.col("trial_number") == F.col("chosen")).drop("chosen")
    schema = T.StructType([f for f in out.schema.fields if f.name != "u"]).add("params", T.StringType()).add("fast", T.IntegerType()).add("slow", T.IntegerType()).add("window", T.IntegerType())
    return out.mapInPandas(named, schema)


def tune_weights(spark: SparkSession, long: DataFrame, weights: DataFrame, by: list[str], n_trials: int = 100, top: int = 50, share: float = 0.05) -> DataFrame:
    """A study in a box around given weights, by training ICIR: its best ``top`` trials, the first by validation marked.

    Weights are the box's values at the trial's point, none under 0, rescaled to 1 (the given ones if all are 0).
    """
    packs = packed.pack(long, by)
    start = kept(weights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("candidate_label", "weight"))).alias("_l")))  # candidates of one key

    def evaluate(proposed: DataFrame) -> DataFrame:
        moved = proposed.join(start, by).withColumn("_m", F.zip_with("_l", "u", lambda x, u: F.greatest(F.lit(0.0), x["weight"] * (1 - share + 2 * share * u))))
        total = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x)
        rescaled = F.when(total > 1e-12, F.transform("_m", lambda x: x / total)).otherwise(F.transform("_l", lambda x: x["weight"]))
        subsets = kept(moved.select(*by, "trial_number", "u", F.col("trial_number").cast("string").alias("subset_id"), F.transform("_l", lambda x: x["candidate_label"]).alias("labels"), rescaled.alias("weights")))
        found = ic.candidate_summary(packed.subset_ics(packs, subsets, by, weights=True), [*by, "subset_id"])
        return subsets.join(found, [*by, "subset_id"], "left").withColumn("value", F.col("train_icir")).drop("subset_id")

    found = sampler.study(start.select(*by, F.transform("_l", lambda x: F.lit(0)).alias("kinds")), by, evaluate, n_trials, batch=30)
    w = Window.partitionBy(*by)
    found = found.where("value is not null").withColumn("train_place", F.row_number().over(w.orderBy(F.desc_nulls_last("train_icir"), F.desc_nulls_last("train_ic_mean"), "trial_number"))).where(F.col("train_place") <= top)
    return found.withColumn("is_best", F.row_number().over(w.orderBy(F.desc_nulls_last("valid_icir"), F.desc_nulls_last("valid_ic_mean"), F.desc_nulls_last("train_icir"), "trial_number")) == 1).drop("u", "value")


def best_method(long: DataFrame, summaries: DataFrame, by: list[str]) -> DataFrame:
    """``by, method_name, labels, weights, train_*, valid_*, is_best`` of equal and of train-ICIR weights.

    The better validation ICIR wins, then its mean, then training; equal weights win a tie.
    """
    methods = selection.equal_weights(summaries, by).withColumn("method_name", F.lit("equal_weight")).unionByName(selection.icir_weights(summaries, by).withColumn("method_name", F.lit("train_icir_weighted")))
    pairs = F.array_sort(F.collect_list(F.struct("candidate_label", "weight")))
    subsets = methods.groupBy(*by, F.col("method_name").alias("subset_id")).agg(pairs.alias("_l"))
    subsets = subsets.select(*by, "subset_id", F.transform("_l", lambda x: x["candidate_label"]).alias("labels"), F.transform("_l", lambda x: x["weight"]).alias("weights"))
    found = ic.candidate_summary(packed.subset_ics(packed.pack(long, by), subsets, by, weights=True), [*by, "subset_id"]).join(subsets, [*by, "subset_id"])
    order = [F.desc_nulls_last("valid_icir"), F.desc_nulls_last("valid_ic_mean"), F.desc_nulls_last("train_icir"), F.asc("subset_id")]
    return found.withColumn("is_best", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1).withColumnRenamed("subset_id", "method_name")


#: Trials of each position function, and of those the best in training that validation sees.
POSITION_TRIALS, POSITION_TOP = 100, 50
#: Position functions, their slopes, smoothing spans and largest gate.
POSITION_KINDS, SLOPES, SPANS, GATE = ("sigmoid", "tanh", "piecewise"), (0.5, 20.0), (1, 30), 0.2


def _position_figures(fees: float):
    """Figures of each trial of a packed segment: score to position, smoothing, gate, returns; days one by one, trials together."""

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                fold, segment, code, asks = (batch.column(c)[row].as_py() for c in ("fold_id", "segment", "code", "asks"))
                nav, score = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(float) for c in ("nav", "score"))
                p1, p2, span, gate = (np.array([a[c] for a in asks], float) for c in ("p1", "p2", "span", "gate"))
                kind = np.array([a["kind"] for a in asks])
                with np.errstate(over="ignore"):
                    x = score[:, None]
                    raw = np.where(kind == "sigmoid", 1 / (1 + np.exp(-p2 * (x - p1))), np.where(kind == "tanh", 0.5 * (np.tanh(p2 * (x - p1)) + 1), (x - p1) / np.where(p2 == p1, 1.0, p2 - p1)))
                figures = positions.figures(np.clip(raw, 0.0, 1.0), nav, span, gate, fees)
                out += [(code, fold, segment, a["kind"], a["trial_number"], *(float(figures[m][k]) for m in positions.FIGURES)) for k, a in enumerate(asks)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 6)], names=["code", "fold_id", "segment", "kind", "trial_number", *positions.FIGURES]).cast(pa.schema([("code", pa.string()), ("fold_id", pa.int32()), ("segment", pa.string()), ("kind", pa.string()), ("trial_number", pa.int32()), *((m, pa.float64()) for m in positions.FIGURES)]))

    return run


def search_positions(spark: SparkSession, scored: DataFrame, folds: DataFrame, n_trials: int = POSITION_TRIALS, top: int = POSITION_TOP, fees: float = 0.001) -> DataFrame:
    """Mean figures over folds of the best position functions: ``code, kind, trial_number, p1, p2, span, gate, train_*, valid_*``.

    Each code and function has a study of ``n_trials`` by training Sharpe; its ``top`` trials in training are
    run over the validation segments. ``is_best_of_kind`` marks a function's best in validation, ``is_best``
    the best of a code. A fold restarts smoothing and holding. ``scored(code, date, pos, nav, score)``;
    ``folds`` are its rows cut by ``fold_id, segment``.
    """
    cells = F.array_sort(F.collect_list(F.struct("date", "nav", F.coalesce("score", F.lit(0.0)).alias("score"))))
    packs = folds.where("segment in ('train', 'valid')").groupBy("code", "fold_id", "segment").agg(cells.alias("c"))
    packs = kept(packs.select("code", "fold_id", "segment", F.transform("c", lambda x: x["nav"]).alias("nav"), F.transform("c", lambda x: x["score"]).alias("score")))
    ranges = kept(positions.score_quantiles(scored, ["code"]))
    u, by = F.col("u"), ["code", "kind"]
    piece = F.col("kind") == "piecewise"
    schema = "code string, fold_id int, segment string, kind string, trial_number int, " + ", ".join(f"{m} double" for m in positions.FIGURES)

    def placed(proposed: DataFrame) -> DataFrame:
        p1 = F.when(piece, F.col("low") + u[0] * (F.col("q50") - F.col("low"))).otherwise(F.col("q10") + u[0] * (F.col("q90") - F.col("q10")))
        p2 = F.when(piece, F.greatest(F.col("q50") + u[1] * (F.col("high") - F.col("q50")), p1 + 1e-6)).otherwise(SLOPES[0] + u[1] * (SLOPES[1] - SLOPES[0]))
        return proposed.join(ranges, "code").select(*proposed.columns, p1.alias("p1"), p2.alias("p2"), F.least(F.lit(SPANS[1]), SPANS[0] + F.floor(u[2] * SPANS[1])).cast("double").alias("span"), (u[3] * GATE).alias("gate"))

    def figures(trials: DataFrame, segment: str) -> DataFrame:
        asks = trials.groupBy("code").agg(F.collect_list(F.struct("kind", "trial_number", "p1", "p2", "span", "gate")).alias("asks"))  # at most a round of each function
        met = packs.where(F.col("segment") == segment).join(asks, "code").select("code", "fold_id", "segment", "nav", "score", "asks")
        found = positions.fold_aggregate(met.mapInArrow(_position_figures(fees), schema), [*by, "trial_number"])
        return found.select(*by, "trial_number", *(F.col(m).alias(f"{segment}_{m}") for m in positions.FIGURES))

    def evaluate(proposed: DataFrame) -> DataFrame:
        trials = kept(placed(proposed))
        return trials.join(figures(trials, "train"), [*by, "trial_number"]).withColumn("value", F.col("train_sharpe"))

    keys = ranges.select("code", F.explode(F.array(*map(F.lit, POSITION_KINDS))).alias("kind"), F.array(*map(F.lit, [0, 0, SPANS[1], 0])).alias("kinds"))
    tried = sampler.study(keys, by, evaluate, n_trials, batch=30)
    order = [F.desc_nulls_last("train_sharpe"), F.desc_nulls_last("train_annual_return"), F.asc_nulls_last("train_max_drawdown"), F.asc("trial_number")]
    best = kept(tried.withColumn("train_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("train_place") <= top).drop("u", "value"))
    out = best.join(figures(best, "valid"), [*by, "trial_number"])
    order = [F.desc_nulls_last("valid_sharpe"), F.desc_nulls_last("valid_annual_return"), F.asc_nulls_last("valid_max_drawdown"), F.asc("trial_number")]
    out = out.withColumn("is_best_of_kind", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)
    return out.withColumn("is_best", F.row_number().over(Window.partitionBy("code").orderBy(*order[:3], "kind", "trial_number")) == 1)


def walk_forward(spark: SparkSession, panel: DataFrame, folds: DataFrame, n_trials: int = 10, strategy: str = "ma_cross", base: dict | None = None) -> DataFrame:
    """Each fold's chosen trial with its figures and the mean daily returns behind the efficiency.

    ``folds(code, fold_id, segment, start_pos, end_pos)``. Signals come from the whole history; folds only cut it.
    """
    best = optimize(spark, panel, folds, strategy, n_trials, base).where("is_best")
    return best.withColumn("train_mean", F.col("train_mean_daily_return")).withColumn("test_mean", F.col("test_mean_daily_return"))
