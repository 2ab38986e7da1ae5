"""The queries of the price-series operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.functions.keeping import kept
from fathomline.functions.rolling import change, series, zscore
from fathomline.operators import features, folds, ic, metrics, packed, panel, positions, ranker, search, selection, signals
from fathomline.oracles import FACTORS6, ORACLE
from fathomline.sources import prices

__all__ = ["ORACLE", "QUERIES", "flagship"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def num(x, digits: int = 6) -> Column:
    x = F.round(F.col(x) if isinstance(x, str) else x, digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def shown(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Dates as text, doubles rounded: what queries return."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("string") if kind == "date" else num(c, special.get(name, digits)) if kind == "double" else c).alias(name))
    return df.select(*out)


def nav(spark: SparkSession, d: str) -> DataFrame:
    return prices.nav_panel(spark, d)


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return factors.prepare(nav(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return factors.multi_factor_score(nav(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """``code, date, candidate_label, value, fwd, fold_id, segment`` of six normalised factors over all folds."""
    table = factors.factor_table(prepared(spark, d).select("code", "date", "nav", "pos"), FACTORS6)
    wide = panel.forward_return(table).select("code", "date", "pos", "fwd", *(F.col(f"{f}_z").alias(f) for f in FACTORS6))
    cut = folds.with_folds(wide, folds.fold_table(spark, nav(spark, d)))
    return panel.unpivot(cut, ["code", "date", "fwd", "fold_id", "segment"], FACTORS6)


KEYS = ["code", "candidate_label"]


def ics(spark: SparkSession, d: str) -> DataFrame:
    return ic.by_fold(labelled(spark, d), [*KEYS, "fold_id", "segment"])


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return ic.candidate_summary(ics(spark, d), KEYS)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    table = factors.factor_table(prepared(spark, d).select("code", "date", "nav", "pos"), FACTORS6)
    wide = table.select("code", "pos", *(F.col(f"{f}_z").alias(f) for f in FACTORS6))
    train = folds.fold_table(spark, nav(spark, d)).where("segment = 'train'")
    return selection.mean_fold_correlation(selection.pair_correlations(folds.with_folds(wide, train), sorted(FACTORS6), ["code", "fold_id"]), ["code"])


def crossed(spark: SparkSession, d: str) -> DataFrame:
    return signals.backtest(signals.generate(nav(spark, d), "ma_cross"))


def gated(spark: SparkSession, d: str) -> DataFrame:
    raw = scored(spark, d).withColumn("raw", positions.sigmoid(F.col("score"), 0.1, 2.0)).select("code", "date", "nav", "raw")
    return positions.smooth_and_gate(raw, ["code"], span=5.0, gate=0.05)


def trials(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    value = (n * 7919 % 101) / 101.0 + n % 7 * 0.01 - F.abs(F.least(F.lit(0.0), (n * 31 % 23 - 11) / 23.0)) * 0.2
    rows = nav(spark, d).select("code").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(59))))
    return rows.select("code", n.alias("trial_number"), F.when(n % 17 != 3, value).alias("value"))


def split_bounds(spark: SparkSession, d: str) -> DataFrame:
    def make(n: int) -> list[tuple[int, str, int, int]]:
        return [(1, s, a, b) for s, (a, b) in folds.ratio_split(n).items()]

    sizes = nav(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(folds.fold_table(spark, nav(spark, d), make)), "n").select("code", "segment", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Score, signals, position and equity of every series and day."""
    return shown(signals.backtest(signals.generate(nav(spark, d), "multi_factor_score")), equity=4)


@query
def s15_normalize_dedup(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("code"), F.lit("").alias("fund"), F.col("value").alias("nav"), "event_id")
    return prices.normalize(rows, "event_id").select("code", F.col("date").cast("string").alias("date"), "nav")


@query
def s08_incremental_upsert(spark, d):
    rows = nav(spark, d)
    fresh = rows.where("date >= date'1999-12-17'").withColumn("nav", F.col("nav") * 2)
    return shown(prices.upsert(rows.where("date < date'2000-01-01'"), fresh, ["code", "date"]))


@query
def s10_fetch_window(spark, d):
    rows = prices.incremental_start(nav(spark, d))
    return shown(rows.withColumn("period", prices.fetch_period(F.date_diff(F.to_date(F.lit("2003-01-01")), "last_date"))))


@query
def s05_yearly_windows(spark, d):
    return shown(prices.yearly_windows(nav(spark, d)))


@query
def p05_common_range_align(spark, d):
    return shown(panel.common_range(nav(spark, d)))


@query
def p04_pivot_panel(spark, d):
    return shown(panel.pivot(nav(spark, d), [a + b for a in "ANR" for b in "FO"]))


@query
def p09_spine_left_join(spark, d):
    return shown(panel.on_spine(nav(spark, d), "AF").select("code", "date", "value"))


@query
def w31_neighbor_fill(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("code"), F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    rows = rows.groupBy("code", "date").agg((F.sum("cents").cast("double") / F.count("cents") / 100).alias("value"))
    days = rows.select("date").distinct().join(F.broadcast(rows.select("code").distinct()))
    return shown(panel.fill_by_neighbors(days.join(rows, ["code", "date"], "left")))


@query
def p12_unpivot_features(spark, d):
    table = prepared(spark, d)
    for f in ("momentum", "drawdown"):
        table = factors.add_factor(table, f, factors.resolve(f), f)
    return shown(panel.unpivot(table, ["code", "date"], ["momentum", "drawdown"]).where("value is not null"))


@query
def p15_candidate_grid(spark, d):
    return factors.fitting_candidates(nav(spark, d)).select("code", "factor_name", "candidate_label")


def _factor_query(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(factors.add_factor(prepared(spark, d), name, factors.resolve(name), name).select("code", "date", name))

    return run


QUERIES |= {f"w{i:02d}_{f}": _factor_query(f) for i, f in enumerate(("momentum", "ma_trend_state", "ma_slope", "trend_r2", "trend_tvalue", "price_position", "breakout_strength", "donchian_breakout", "trend_residual", "volatility", "drawdown", "risk_adjusted_momentum", "sharpe_like_trend"), 1)}


@query
def w15_rolling_zscore(spark, d):
    w = series("code")
    return shown(zscore(nav(spark, d).withColumn("x", change(F.col("nav"), 20, w)), "x", 60, "z", w).select("code", "date", "z"))


@query
def w17_factor_table(spark, d):
    return shown(factors.factor_table(nav(spark, d)).drop("nav"))


@query
def w18_multi_factor_score(spark, d):
    return shown(scored(spark, d).select("code", "date", "score"))


@query
def w22_panel_features(spark, d):
    return shown(factors.panel_features(nav(spark, d)))


@query
def w23_forward_return(spark, d):
    return shown(panel.forward_return(nav(spark, d)).select("code", "date", "fwd"))


@query
def w24_future_rank(spark, d):
    return shown(panel.future_rank(nav(spark, d)).select("code", "date", "future_rank"))


@query
def w28_drawdown(spark, d):
    return shown(nav(spark, d).select("code", "date", metrics.drawdown(F.col("nav"), "code").alias("drawdown")))


@query
def a18_daily_return(spark, d):
    return shown(prepared(spark, d).select("code", "date", "ret"))


@query
def j06_asof_risk_free(spark, d):
    return shown(panel.asof_rates(nav(spark, d), prices.risk_free(spark, d)).select("code", "date", "rf"), rf=10)


def _signal_query(name: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(signals.generate(nav(spark, d), name, **options).select("code", "date", "entries", "exits"))

    return run


QUERIES |= {"x01_buy_and_hold": _signal_query("buy_and_hold"), "x01_ma_cross_signals": _signal_query("ma_cross"), "x01_momentum_signals": _signal_query("momentum"), "x01_multi_factor_signals": _signal_query("multi_factor_score"), "w27_t_plus_one": _signal_query("ma_cross", delay=True)}


@query
def x07_signal_backtest(spark, d):
    out = crossed(spark, d).select("code", "date", F.col("position").cast("long").alias("position"), F.col("traded").cast("long").alias("traded"), "equity")
    return shown(out, equity=4)


@query
def a16_trade_count(spark, d):
    return signals.trade_count(crossed(spark, d))


@query
def a17_segment_trade_count(spark, d):
    curve = signals.generate(prepared(spark, d).drop("ret"), "ma_cross")
    return signals.segment_trade_count(curve, split_bounds(spark, d))


@query
def j01_cumulative_join(spark, d):
    return shown(features.with_cumulative(nav(spark, d), prices.cumulative_panel(spark, d)))


def pool_and_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each code's pool holds the codes of its flag; those of its status are linked to it."""
    codes = nav(spark, d).select("code").distinct()
    pairs = codes.select(F.col("code").alias("primary")).join(codes, F.substring("primary", 1, 1) == F.substring("code", 1, 1))
    links = codes.select(F.col("code").alias("primary")).join(codes.select(F.col("code").alias("linked")), F.substring("primary", 2, 1) == F.substring("linked", 2, 1))
    return pairs.select("primary", "code", F.concat(F.lit("pool "), "code").alias("name")), links


@query
def p19_effective_codes(spark, d):
    pool, links = pool_and_links(spark, d)
    kinds = nav(spark, d).select("code", F.when(F.col("code").endswith("F"), "Fund").otherwise("index").alias("kind")).distinct()
    return features.effective_codes(pool, links, kinds)


SOURCE_CANDIDATES = [(factors.label(n, p), n, p) for n, p in (("momentum", {"window": 20}), ("volatility", {"window": 20}), ("donchian_breakout", {"window": 20}), ("price_position", {"window": 60}))]


@query
def w21_source_factors(spark, d):
    bars = prices.daily_bars(spark, d)
    sources = features.long_sources(bars, ["open", "high", "low", "volume"])
    out = features.source_factors(sources, SOURCE_CANDIDATES, zero_limit=0.3)
    return shown(out.select("code", "date", "candidate_label", "raw", "value"))


@query
def p10_linked_sources(spark, d):
    _, links = pool_and_links(spark, d)
    sources = features.long_sources(prices.daily_bars(spark, d), ["open", "volume"])
    return shown(features.on_primary_days(sources, links.where("primary = 'AF'").withColumnRenamed("linked", "code")))


@query
def a12_return_metrics(spark, d):
    return shown(metrics.return_metrics(crossed(spark, d), ["code"]))


@query
def a12_metrics_with_rf(spark, d):
    return shown(metrics.return_metrics(panel.asof_rates(crossed(spark, d), prices.risk_free(spark, d)), ["code"], rf="rf"))


@query
def a15_mean_daily_return(spark, d):
    return shown(metrics.mean_daily_return(crossed(spark, d), ["code"]), 9)


@query
def j07_benchmark_curve(spark, d):
    return shown(metrics.normalized_curve(crossed(spark, d), ["code"]))


@query
def w33_segment_metrics(spark, d):
    curve = signals.backtest(signals.generate(prepared(spark, d).drop("ret"), "ma_cross"))
    return shown(metrics.segment_metrics(curve, split_bounds(spark, d), ["code"]))


@query
def t09_strategy_summary(spark, d):
    names = list(signals.STRATEGIES)
    curves = signals.backtest(signals.generate_all(nav(spark, d), [(n, None) for n in names]), by=("code", "variant"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("variant") + 1)
    out = metrics.return_metrics(curves, ["code", "variant"]).withColumn("strategy", name).drop("variant")
    order = series("code").orderBy(F.desc("sharpe"), F.desc("annual_return"), "strategy")
    return shown(out).withColumn("place", F.row_number().over(order).cast("long"))


@query
def f01_ratio_split(spark, d):
    return split_bounds(spark, d)


def _folds(spark: SparkSession, d: str, make) -> DataFrame:
    sizes = nav(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(folds.fold_table(spark, nav(spark, d), make)), "n").select("code", "fold_id", "segment", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


@query
def f02_walk_forward_folds(spark, d):
    return _folds(spark, d, folds.walk_forward)


@query
def f03_dynamic_step(spark, d):
    def make(n: int) -> list[tuple[int, str, int, int]]:
        step, rest, how = folds.dynamic_step(folds.ratio_split(n)["valid"][1], folds.WINDOW)
        return [(1, how, step, rest)]

    return _folds(spark, d, make).select("code", F.col("start_pos").alias("step"), F.col("end_pos").alias("tail"))


@query
def f04_dev_folds(spark, d):
    return _folds(spark, d, folds.dev_folds)


@query
def f05_context_split(spark, d):
    return shown(folds.context_split(prepared(spark, d), 0.8, 30).select("code", "date", "segment", "context"))


@query
def a01_ic_by_fold(spark, d):
    return shown(ics(spark, d))


@query
def a02_icir_classic(spark, d):
    return shown(ic.summary(ics(spark, d), [*KEYS, "segment"]))


@query
def a03_icir_exp_weighted(spark, d):
    return shown(ic.weighted_summary(ics(spark, d), [*KEYS, "segment"]))


@query
def a05_positive_ratio(spark, d):
    return shown(ic.positive_ratio(ics(spark, d), [*KEYS, "segment"]))


@query
def a06_trimmed_mean(spark, d):
    return shown(ic.trimmed_mean(ics(spark, d), [*KEYS, "segment"]))


@query
def a07_flip_count(spark, d):
    return ic.flip_count(ics(spark, d), [*KEYS, "segment"])


@query
def a08_tail_reject(spark, d):
    table = prepared(spark, d)
    for f in ("momentum", "volatility"):
        table = factors.add_factor(table, f, factors.resolve(f), f).withColumn(f, F.round(f, 9))
    return shown(ic.tail_reject(table, ["momentum", "volatility"], by=["code"]).select("code", "date", "tail_rejected"))


@query
def t01_factor_selection(spark, d):
    out = ic.select_factors(summaries(spark, d), by=["code"])
    return shown(out.withColumn("final_rank", F.col("final_rank").cast("long")))


@query
def t02_stability_rank(spark, d):
    return shown(ic.stability(ics(spark, d), KEYS, ["code"]).withColumn("stability_rank", F.col("stability_rank").cast("long")))


@query
def a22_quality_filter(spark, d):
    names = [*FACTORS6, "donchian_breakout"]
    table = factors.factor_table(nav(spark, d), names)
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("candidate_label"), F.col(f).alias("raw"), F.col(f"{f}_z").alias("value")) for f in names)))
    return shown(ic.quality(table.select("code", cells.alias("c")).select("code", "c.*"), KEYS))


@query
def a23_flip_detection(spark, d):
    return shown(ic.flip_candidates(ics(spark, d), KEYS))


@query
def a09_mean_fold_corr(spark, d):
    return shown(pairs(spark, d))


@query
def a10_corr_losers(spark, d):
    return shown(selection.corr_losers(pairs(spark, d), summaries(spark, d), ["code"], 0.7))


@query
def t03_corr_drop(spark, d):
    summed = summaries(spark, d)
    out = selection.corr_drop(selection.corr_losers(pairs(spark, d), summed, ["code"], 0.7), summed, ["code"])
    return out.select("code", "candidate_label", "losses", F.col("place").cast("long").alias("place"))


@query
def x16_forward_search(spark, d):
    long = labelled(spark, d)
    paths = selection.forward_search(spark, long, summaries(spark, d), ["code"])
    return shown(paths.select("code", "subset_id", "factor_count", "step", "train_icir", "valid_icir"))


def _best_forward(spark: SparkSession, long: DataFrame, summed: DataFrame) -> DataFrame:
    paths = selection.forward_search(spark, long, summed, ["code"])
    return selection.best_path(selection.top_train_paths(paths, ["code"]), ["code"])


@query
def x20_extension_search(spark, d):
    long, summed = packed.pack(labelled(spark, d), ["code"]), kept(summaries(spark, d))
    out = selection.extension_search(long, summed, _best_forward(spark, long, summed), ["code"])
    return shown(out.select("code", "subset_id", "factor_count", "source", "train_icir", "valid_icir", "is_final"))


@query
def t06_best_method(spark, d):
    out = search.best_method(labelled(spark, d), summaries(spark, d), ["code"])
    return shown(out.select("code", "method_name", "train_icir", "valid_icir", "is_best"))


@query
def t05_best_path(spark, d):
    return shown(_best_forward(spark, labelled(spark, d), summaries(spark, d)).select("code", "subset_id", "factor_count", "train_icir", "valid_icir"))


@query
def x13_equal_weights(spark, d):
    return shown(selection.equal_weights(summaries(spark, d), ["code"]))


@query
def x13_icir_weights(spark, d):
    return shown(selection.icir_weights(summaries(spark, d), ["code"]))


@query
def x14_weighted_score_ic(spark, d):
    weights = {"momentum": 0.5, "drawdown": 0.3, "volatility": 0.2}
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = labelled(spark, d).where(F.col("candidate_label").isin(list(weights)))
    sums = rows.groupBy("code", "fold_id", "segment", "date").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0)) * w[F.col("candidate_label")]), 9).alias("score"), F.first("fwd").alias("fwd"))
    return shown(ic.by_fold(sums, ["code", "fold_id", "segment"], "score"))


@query
def x15_weight_tuning(spark, d):
    weights = selection.icir_weights(summaries(spark, d), ["code"])
    return shown(search.tune_weights(spark, labelled(spark, d), weights, ["code"]).select("code", "trial_number", "train_icir", "valid_icir", "is_best"))


@query
def a21_score_quantiles(spark, d):
    return shown(positions.score_quantiles(scored(spark, d), ["code"]))


def _position_query(kind: str, **params) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(scored(spark, d).select("code", "date", positions.raw_position(F.col("score"), kind, **params).alias("position")))

    return run


QUERIES |= {"x09_sigmoid": _position_query("sigmoid", center=0.1, slope=2.0), "x09_tanh": _position_query("tanh", center=0.1, slope=2.0), "x09_piecewise": _position_query("piecewise", low=-0.2, high=0.5)}


@query
def w29_ema(spark, d):
    return shown(gated(spark, d).select("code", "date", "smoothed"))


@query
def w30_gate(spark, d):
    return shown(gated(spark, d).select("code", "date", "target"))


@query
def x08_continuous_backtest(spark, d):
    return shown(positions.backtest(gated(spark, d)).select("code", "date", "held", "turnover", "strategy_return", F.log("equity").alias("log_equity")))


@query
def a13_fold_aggregate(spark, d):
    curve = positions.backtest(gated(spark, d))
    cut = folds.with_folds(curve.withColumn("pos", F.row_number().over(series("code"))), folds.fold_table(spark, nav(spark, d)))
    by = ["code", "fold_id", "segment"]
    trades = cut.groupBy(*by).agg(F.count_if(F.col("turnover") > 1e-12).alias("trade_count"))
    return shown(positions.fold_aggregate(metrics.return_metrics(cut, by).join(trades, by), ["code", "segment"]))


@query
def x12_position_search(spark, d):
    rows = scored(spark, d).withColumn("pos", F.row_number().over(series("code")))
    cut = folds.with_folds(rows, folds.fold_table(spark, nav(spark, d)))
    out = search.search_positions(spark, rows, cut)
    return shown(out.select("code", "kind", "trial_number", "train_sharpe", "valid_sharpe", "is_best_of_kind", "is_best"))


@query
def t10_topk_trials(spark, d):
    return shown(search.top_trials(trials(spark, d), ["code"]).withColumn("place", F.col("place").cast("long")))


@query
def t11_running_best(spark, d):
    return shown(search.running_best(trials(spark, d), ["code"]))


@query
def x21_objective(spark, d):
    figures = metrics.return_metrics(crossed(spark, d), ["code"])
    return shown(figures.select("code", search.objective(F.col("sharpe"), F.col("max_drawdown")).alias("objective")))


def _optimize_query(strategy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = search.optimize(spark, prepared(spark, d).drop("ret"), split_bounds(spark, d), strategy)
        return shown(out.select("code", "trial_number", "params", "value", "train_sharpe", "valid_sharpe", "test_sharpe", "is_best"))

    return run


QUERIES |= {"x22_optimize": _optimize_query("ma_cross"), "x22_optimize_momentum": _optimize_query("momentum"), "x22_optimize_multi_factor": _optimize_query("multi_factor_score")}


@query
def a14_walk_forward(spark, d):
    bounds = _folds(spark, d, folds.walk_forward)
    return shown(metrics.walk_forward_summary(search.walk_forward(spark, prepared(spark, d).drop("ret"), bounds)))


@query
def p08_lookback_samples(spark, d):
    rows = panel.lookback_samples(prepared(spark, d).where("ret is not null or pos = 1"), 5)
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return shown(rows.select("code", "date", "y", F.col("x")[4].alias("newest"), F.col("x")[0].alias("oldest"), total.alias("total")))


@query
def t12_cross_section_topk(spark, d):
    rows = nav(spark, d).withColumn("score", change(F.col("nav"), 20, series("code")))
    return shown(panel.cross_section_top(rows, 2, floor=0.0).select("code", "date", "score", F.col("place").cast("long").alias("place")))


@query
def a19_rank_ic(spark, d):
    rows = panel.future_rank(nav(spark, d)).withColumn("x", change(F.col("nav"), 20, series("code")))
    return shown(panel.rank_ic(rows, "x", "future_rank"))


@query
def a20_group_sizes(spark, d):
    return shown(panel.group_sizes(nav(spark, d)))


RANK_FEATURES = ["ret_5", "ret_20", "vol_20", "ma_ratio_20", "drawdown_20"]


def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    return factors.panel_features(panel.future_rank(nav(spark, d)).select("code", "date", "nav", "future_rank"))


@query
def x05_mlp_predict(spark, d):
    _, scored, _ = ranker.fit_split(ranked_rows(spark, d), RANK_FEATURES, epochs=30)
    return shown(scored.select("code", "date", "segment", "score"))


@query
def x06_boosted_ranker(spark, d):
    _, scored, _ = ranker.fit_split(ranked_rows(spark, d), RANK_FEATURES, "boosted", trees=10)
    return shown(scored.select("code", "date", "segment", "score"))


@query
def x04_neural_signals(spark, d):
    out = ranker.neural_signals(spark, nav(spark, d), lookback=10, top_k=2, epochs=30)
    return shown(out.select("code", "date", "score", "held", "entries", "exits"))
