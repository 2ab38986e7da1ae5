"""The research chain as stages with JSON artefacts, and the backtest commands."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.functions.chunks import positions as positions_of
from fathomline.functions.keeping import kept, small
from fathomline.functions.rolling import safe_corr
from fathomline.operators import features, folds, ic, metrics, packed, panel, positions, search, selection, signals

# The alphabet of lineage codes, one character for each stage.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
STAGES = ("data-preprocess", "factor-select", "stability", "dedup", "combination", "strategy-backtest")
OUTPUTS = ("feature_preprocess_output", "factor_selection_output", "stability_analysis_output", "dedup_selection_output", "factor_combination_output", "strategy_backtest_output")


KEY = ["code", "candidate_label"]


@dataclass(frozen=True)
class Config:
    """Settings of a run; ``override`` returns a changed copy."""

    output_dir: str = "outputs"
    factor_names: tuple[str, ...] = tuple(factors.POOL)
    factor_groups: tuple[str, ...] = ()
    sources: tuple[str, ...] = ("nav",)
    links: dict = field(default_factory=dict)
    full_grid: bool = False
    horizon: int = 5
    min_ic: float = 0.0
    min_icir: float = 0.0
    exp_weighted: bool = False
    half_life: float = 3.0
    root_topk: int = 3
    levels: int | None = None
    corr_limit: float = 0.9
    init_cash: float = 10000.0
    fees: float = 0.001
    window: int = folds.WINDOW
    step: int = folds.STEP
    n_trials: int = 30
    weight_trials: int = 100
    position_trials: int = 100
    strategy: str = "multi_factor_score"
    params: dict = field(default_factory=dict)

    def override(self, **changes) -> Config:
        return Config(**{**self.__dict__, **{k: v for k, v in changes.items() if v is not None}})

    def names(self) -> list[str]:
        return factors.names_of_groups(list(self.factor_groups)) if self.factor_groups else list(self.factor_names)


def path_code(parent: str | None, stage: int, payload: dict) -> str:
    """A lineage code: the parent's characters before ``stage``, one from the content's hash, zeros after."""
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).digest()
    return (parent or "0" * 6)[:stage] + ALPHABET[1 + digest[0] % 61] + "0" * (5 - stage)


def save_stage(config: Config, stage: int, code: str, output: dict, source: dict | None = None, source_path: str | None = None) -> str:
    """Writes ``<stage>_<code>_<lineage>.json`` and returns its path."""
    lineage = path_code((source or {}).get("path_code"), stage, output)
    body = {"path_code": lineage, "input_ref": source_path, OUTPUTS[stage]: {"fund_code": code, "data_mode": "nav_price_series", **output}}
    os.makedirs(config.output_dir, exist_ok=True)
    path = os.path.join(config.output_dir, f"{OUTPUTS[stage].removesuffix('_output')}_{code}_{lineage}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, indent=1, default=str)
    return path


def read_artefact(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_stage(path: str, stage: int) -> dict:
    """A stage's artefact; raises if it isn't one."""
    body = read_artefact(path)
    if not isinstance(body, dict) or not isinstance(body.get(OUTPUTS[stage]), dict):
        raise ValueError(f"{path} has no {OUTPUTS[stage]}")
    if stage in (1, 2) and not isinstance(body[OUTPUTS[stage]].get("record_dict", {}), dict):
        raise ValueError(f"{path} has no record_dict")
    return body


def candidates_of(config: Config) -> list[tuple[str, str, dict[str, int]]]:
    if config.full_grid:
        return factors.candidates(config.names())
    return [(factors.label(n, factors.resolve(n)), n, factors.resolve(n)) for n in config.names()]


def feature_matrix(prices: DataFrame, config: Config) -> DataFrame:
    """``code, date, pos, nav, candidate_label, raw, value, fwd``: all candidates of all series, long.

    One pass over overlapping chunks works out all of them, then each gets a row. With ``sources`` beside the
    NAV, or ``links`` to other codes, candidates come from every source column of the code and its linked
    codes (labelled by it), pruned before they become rows; returns are those of the cumulative NAV if there is one.
    """
    some, target = candidates_of(config), "cumulative_nav" if "cumulative_nav" in prices.columns else "nav"
    if config.sources == ("nav",) and not config.links:
        table = panel.forward_return(factors.candidate_values(positions_of(prices), [(name, params) for _, name, params in some]), config.horizon)
        labels = F.array(*(F.lit(label) for label, _, _ in some))
        cells = F.explode(F.arrays_zip(labels.alias("candidate_label"), F.col("raws").alias("raw"), F.col("scores").alias("value")))
        return table.select("code", "date", "pos", "nav", "fwd", cells.alias("c")).select("code", "date", "pos", "nav", "fwd", "c.*")
    pairs = [(p, c) for p, linked in config.links.items() for c in linked]  # a setting
    codes = prices.select(F.col("code").alias("primary"), "code").distinct()
    if pairs:
        codes = codes.unionByName(prices.sparkSession.createDataFrame(pairs, "primary string, code string")).distinct()
    sources = features.on_primary_days(features.long_sources(prices, list(config.sources)), codes)
    cells = features.source_factors(sources, some).select("code", "date", "candidate_label", "raw", "value")
    returns = panel.forward_return(positions_of(prices.where(F.col(target).isNotNull())), config.horizon, target)
    return returns.select("code", "date", "pos", "nav", "fwd").join(cells, ["code", "date"])


def preprocess(spark: SparkSession, prices: DataFrame, config: Config, matrix_path: str) -> DataFrame:
    """Writes the checked matrix: candidates with too many gaps or zeros dropped, contrary ones appended flipped."""
    long = feature_matrix(prices, config)
    long.write.mode("overwrite").partitionBy("code").parquet(f"{matrix_path}.raw")
    long = spark.read.parquet(f"{matrix_path}.raw").withColumn("code", F.col("code").cast("string"))
    good = ic.quality(long, ["code", "candidate_label"]).where("not dropped").select("code", "candidate_label")
    kept = long.join(small(good), ["code", "candidate_label"], "left_semi")
    flips = ic.flip_candidates(fold_ics(spark, kept, prices, config), ["code", "candidate_label"]).where("flipped").select("code", "candidate_label")
    turned = kept.join(small(flips), ["code", "candidate_label"], "left_semi").withColumn("candidate_label", F.concat(F.lit("-"), "candidate_label")).withColumn("value", -F.col("value"))
    kept.unionByName(turned).write.mode("overwrite").partitionBy("code").parquet(matrix_path)
    return spark.read.parquet(matrix_path).withColumn("code", F.col("code").cast("string"))


def cut_folds(spark: SparkSession, long: DataFrame, prices: DataFrame, config: Config) -> DataFrame:
    table = folds.fold_table(spark, prices, lambda n: folds.dev_folds(n, config.window))
    sizes = prices.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.join(F.broadcast(table), "n").drop("n")
    at = F.col("pos") - 1
    return long.join(small(spans), "code").where((at >= F.col("start_pos")) & (at < F.col("end_pos")))


def fold_ics(spark: SparkSession, long: DataFrame, prices: DataFrame, config: Config) -> DataFrame:
    return ic.by_fold(cut_folds(spark, long, prices, config), ["code", "candidate_label", "fold_id", "segment"])


def candidate_pairs(long: DataFrame) -> DataFrame:
    """``code, a, b, mean_corr`` of all pairs of candidates: correlation over the training rows of each fold, averaged.

    Candidates meet on their days, so the work is spread by series, fold and day, not one cell for each pair.
    """
    rows = kept(long.where(F.col("segment") == "train").select("code", "fold_id", "date", "candidate_label", "value"))
    a, b = rows.withColumnsRenamed({"candidate_label": "a", "value": "x"}), rows.withColumnsRenamed({"candidate_label": "b", "value": "y"})
    pairs = a.join(b, ["code", "fold_id", "date"]).where(F.col("a") < F.col("b")).groupBy("code", "fold_id", "a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("corr"))
    return selection.mean_fold_correlation(pairs, ["code"])


class Chain:
    """A run of the research stages, from prices or from the artefacts of an earlier stage.

    ``start`` holds each series' artefact path to go on from; stages before it are not run again.
    """

    def __init__(self, spark: SparkSession, prices: DataFrame, config: Config, start: dict[str, str] | None = None):
        self.spark, self.prices, self.config = spark, prices, config
        self.codes = sorted(start) if start else [r["code"] for r in prices.select("code").distinct().orderBy("code").collect()]
        self.paths: dict[str, list[str]] = {c: [] for c in self.codes}
        self.bodies: dict[int, dict[str, dict]] = {}
        self.done = -1
        for c, path in (start or {}).items():
            chain = [path]
            while (ref := read_artefact(chain[0])["input_ref"]) is not None:
                chain.insert(0, ref)
            for stage, at in enumerate(chain):
                self.bodies.setdefault(stage, {})[c] = load_stage(at, stage)[OUTPUTS[stage]]
            self.paths[c], self.done = chain, len(chain) - 1
        self.matrix_path = self.bodies[0][self.codes[0]]["matrix_path"] if start else os.path.join(config.output_dir, "feature_matrix.parquet")

    def record(self, stage: int, by_code: dict[str, dict]) -> None:
        self.bodies[stage] = {}
        for c in self.codes:
            source = load_stage(self.paths[c][-1], stage - 1) if self.paths[c] else None
            self.bodies[stage][c] = by_code.get(c, {})
            self.paths[c].append(save_stage(self.config, stage, c, self.bodies[stage][c], source, self.paths[c][-1] if self.paths[c] else None))
        self.done = stage

    def candidates(self, stage: int, schema: str) -> DataFrame:
        """The records of a stage's artefacts as a table."""
        names = [x.split(" ")[0] for x in schema.split(", ")]
        rows = [tuple({"code": c, **r}.get(n) for n in names) for c, body in self.bodies[stage].items() for r in body.get("record_dict", {}).values()]
        return self.spark.createDataFrame(rows, schema)

    def long(self) -> DataFrame:
        rows = self.spark.read.parquet(self.matrix_path).withColumn("code", F.col("code").cast("string"))
        return rows.where(F.col("code").isin(self.codes))

    def ics(self) -> DataFrame:
        path = self.matrix_path.removesuffix(".parquet") + ".ics.parquet"
        fold_ics(self.spark, self.long(), self.prices, self.config).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def summaries(self, ics: DataFrame) -> DataFrame:
        out = ic.candidate_summary(ics, KEY)
        if self.config.exp_weighted:
            for s in ("train", "valid"):
                w = ic.weighted_summary(ics.where(F.col("segment") == s), KEY, self.config.half_life).select(*KEY, F.col("ic_mean").alias(f"{s}_ic_mean"), F.col("icir").alias(f"{s}_icir"))
                out = out.drop(f"{s}_ic_mean", f"{s}_icir").join(w, KEY)
        return out

    def preprocess(self) -> None:
        preprocess(self.spark, self.prices, self.config, self.matrix_path)
        self.record(0, {c: {"matrix_path": self.matrix_path, "target_nav_column": f"{c}__cumulative_nav"} for c in self.codes})

    def select(self) -> None:
        self.record(1, _records(ic.select_factors(self.summaries(self.ics()), self.config.min_ic, self.config.min_icir, ["code"])))

    def stability(self) -> None:
        passed = self.candidates(1, "code string, candidate_label string, selected boolean").where("selected").select(*KEY)
        self.record(2, _records(ic.stability(self.ics().join(small(passed), KEY, "left_semi"), KEY, ["code"])))

    def _sure(self) -> tuple[DataFrame, DataFrame]:
        """Candidates that stability kept, with their figures, and their rows in the folds."""
        stable = small(self.candidates(2, "code string, candidate_label string, tail_rejected boolean").where("not tail_rejected").select(*KEY))
        sure = kept(self.summaries(self.ics().join(stable, KEY, "left_semi")))
        return sure, kept(cut_folds(self.spark, self.long().join(stable, KEY, "left_semi"), self.prices, self.config))

    def dedup(self) -> None:
        """Highly correlated candidates go, then the forward search and what extends its best path."""
        sure, cut = self._sure()
        packs = packed.pack(cut, ["code"])
        losers = selection.corr_losers(candidate_pairs(cut), sure, ["code"], self.config.corr_limit)
        dropped = kept(selection.corr_drop(losers, sure, ["code"]).select(*KEY))
        left = kept(sure.join(small(dropped), KEY, "left_anti"))
        paths = selection.forward_search(self.spark, packs, left, ["code"], self.config.root_topk, self.config.levels)
        baseline = kept(selection.best_path(selection.top_train_paths(paths, ["code"]), ["code"]))
        final = selection.extension_search(packs, left, baseline, ["code"]).where("is_final")
        gone: dict[str, list[str]] = {}
        for r in dropped.collect():  # a tenth of the candidates
            gone.setdefault(r["code"], []).append(r["candidate_label"])
        self.record(3, {r["code"]: {"record_dict": {x: {"candidate_label": x} for x in r["labels"]}, "best_final_selection_summary": r.asDict(recursive=True), "candidate_label_list": r["labels"], "corr_dropped_label_list": sorted(gone.get(r["code"], []))} for r in final.collect()})

    def combine(self) -> None:
        """Equal and ICIR weights, and trials around the better of them; the best in validation stays."""
        sure, cut = self._sure()
        cut = packed.pack(cut, ["code"])
        chosen = small(self.candidates(3, "code string, candidate_label string"))
        methods = kept(search.best_method(cut, sure.join(chosen, KEY, "left_semi"), ["code"]))
        start = methods.where("is_best").select("code", F.explode(F.arrays_zip("labels", "weights")).alias("x")).select("code", F.col("x.labels").alias("candidate_label"), F.col("x.weights").alias("weight"))
        tuned = search.tune_weights(self.spark, cut, start, ["code"], self.config.weight_trials).where("is_best").withColumn("method_name", F.lit("tuned"))
        columns = ["code", "method_name", "labels", "weights", "train_icir", "valid_icir", "valid_ic_mean"]
        every = methods.select(*columns).unionByName(tuned.select(*columns))
        order = [F.desc_nulls_last("valid_icir"), F.desc_nulls_last("valid_ic_mean"), F.desc_nulls_last("train_icir"), F.asc("method_name")]
        best = every.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where("_n = 1").drop("_n")
        self.record(4, {r["code"]: {"best_combination_selection_summary": {"candidate_label_list": r["labels"], "selected_method": r["method_name"], "candidate_weight_dict": dict(zip(r["labels"], r["weights"], strict=True)), "valid_icir": r["valid_icir"]}} for r in best.collect()})

    def position(self) -> None:
        weights = [(c, x, w) for c, body in self.bodies[4].items() for x, w in body.get("best_combination_selection_summary", {}).get("candidate_weight_dict", {}).items()]
        table = self.spark.createDataFrame(weights, "code string, candidate_label string, weight double")
        scored = self.long().join(small(table), KEY).groupBy("code", "date", "pos", "nav").agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("weight")).alias("score"))
        best = search.search_positions(self.spark, scored, cut_folds(self.spark, scored, self.prices, self.config), self.config.position_trials).where("is_best").collect()
        self.record(5, {r["code"]: {"best_position_function": r.asDict()} for r in best})

    def run(self, upto: str) -> dict[str, list[str]]:
        steps = (self.preprocess, self.select, self.stability, self.dedup, self.combine, self.position)
        for step in steps[self.done + 1 : STAGES.index(upto) + 1]:
            step()
        return self.paths


def _records(df: DataFrame) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for r in df.collect():  # one row for each candidate of a series, as the artefact holds them
        out.setdefault(r["code"], {"record_dict": {}})["record_dict"][r["candidate_label"]] = r.asDict(recursive=True)
    return out


def research(spark: SparkSession, prices: DataFrame, config: Config, upto: str = STAGES[-1], start: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Runs the chain up to a stage for all series at once, or on from artefacts; returns each series' artefact paths."""
    return Chain(spark, prices, config, start).run(upto)


def backtests(prices: DataFrame, config: Config, strategies: list[str] | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Figures of every series and strategy, best Sharpe first within a series."""
    names = strategies or [config.strategy]
    curve = signals.backtest(signals.generate_all(prices, [(n, config.params.get(n)) for n in names]), config.init_cash, config.fees, by=("code", "variant"))
    curve = panel.asof_rates(curve, rates) if rates is not None else curve
    by = ["code", "variant"]
    out = metrics.return_metrics(curve, by, rf="rf" if rates is not None else None).join(signals.trade_count(curve, tuple(by)), by)
    out = out.withColumn("strategy_name", F.element_at(F.array(*map(F.lit, names)), F.col("variant") + 1)).drop("variant")
    return out.orderBy("code", F.desc("sharpe"), F.desc("annual_return"))


def target_positions(scored: DataFrame, kind: str, span: float, gate: float, **params) -> DataFrame:
    """Score to target position: map, smooth, gate."""
    return positions.smooth_and_gate(scored.withColumn("raw", positions.raw_position(F.col("score"), kind, **params)), ["code"], span=span, gate=gate)
