"""Goldens and properties of the price-series operators on tiny panels."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.functions.rolling import series, zscore
from fathomline.operators import folds, ic, metrics, panel, positions, ranker, search, selection, signals
from fathomline.sources import prices

DAY = dt.date(2024, 1, 1)
TREND = [1.0001, 1.0004, 1.0012, 1.0007, 1.0015, 1.0021, 1.0018, 1.0024, 1.003, 1.0027, 1.0031, 1.0029, 1.0038, 1.0035, 1.0042, 1.0048, 1.0044, 1.0052, 1.0058, 1.0061]


def nav(spark, values, code="A"):
    return spark.createDataFrame([(code, DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "code string, date date, nav double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_normalize(spark):
    rows = [("2024-01-02", "7301", "x", "1.0", 0), ("2024-01-01", "007301", "x", "2.0", 1), ("2024-01-02", "007301", "x", "3.0", 2), ("bad", "1", "x", "1", 3), ("2024-01-03", "1", "x", "?", 4)]
    out = prices.normalize(spark.createDataFrame(rows, "date string, code string, fund string, nav string, n int"), "n").orderBy("date").collect()
    assert [(r.code, r.nav) for r in out] == [("007301", 2.0), ("007301", 3.0)]
    with pytest.raises(ValueError):
        prices.normalize(spark.range(1), "id")
    with pytest.raises(ValueError):
        prices.single_fund(nav(spark, [1.0]), "B")


def test_standardize_provider_frame(spark):
    df = spark.createDataFrame([("2024-01-01", "1.5", "9"), ("2024-01-02", None, None)], "`日期` string, `收盘` string, `成交量` string")
    out = prices.standardize(df, prices.DAILY_BARS, ["date", "close", "volume"], "000001").collect()
    assert [(r.code, r.close, r.price) for r in out] == [("000001", 1.5, 1.5)]


def test_forward_return(spark):
    out = column(panel.forward_return(nav(spark, [1.0, 1.1, 1.21, 1.331, 1.4641, 1.61051])), "fwd")
    assert math.isclose(out[0], 0.61051, abs_tol=1e-12) and out[1:] == [None] * 5


def test_regressions_against_formulas(spark):
    df = factors.prepare(nav(spark, TREND))
    for f in ("trend_r2", "trend_tvalue", "trend_residual"):
        df = factors.add_factor(df, f, {"window": 20}, f)
    last = df.orderBy(F.desc("date")).first()
    n, xs = 20, range(20)
    mx, my = sum(xs) / n, sum(TREND) / n
    sxx, sxy, syy = sum((x - mx) ** 2 for x in xs), sum((x - mx) * (y - my) for x, y in zip(xs, TREND, strict=True)), sum((y - my) ** 2 for y in TREND)
    rest = syy - sxy * sxy / sxx
    assert math.isclose(last.trend_r2, 1 - rest / syy, rel_tol=1e-9)
    assert math.isclose(last.trend_tvalue, sxy / sxx / math.sqrt(rest / (n - 2) / sxx), rel_tol=1e-9)
    assert math.isclose(last.trend_residual, TREND[-1] / (my + sxy / sxx * (19 - mx)) - 1, abs_tol=1e-12)


def test_constant_series(spark):
    df = factors.prepare(nav(spark, [2.0] * 8))
    out = factors.add_factor(df, "trend_r2", {"window": 4}, "r2")
    assert column(out, "r2") == [None] * 3 + [0.0] * 5
    assert column(zscore(df, "nav", 3, "z", series("code")), "z") == [0.0] * 8


def test_pool():
    assert len(factors.candidates()) == 389
    assert factors.label("ma_slope", {"window": 20, "lookback": 5}) == "ma_slope(lookback=5, window=20)"
    with pytest.raises(ValueError):
        factors.resolve("nothing")
    with pytest.raises(ValueError):
        factors.validate([], {})
    with pytest.raises(ValueError):
        factors.names_of_groups(["none"])


def test_splits():
    assert folds.ratio_split(300) == {"train": (0, 180), "valid": (180, 240), "test": (240, 300)}
    with pytest.raises(ValueError):
        folds.ratio_split(90, least=40)
    cut = folds.walk_forward(900)
    assert len(cut) == 12 and [b - a for _, _, a, b in cut[:3]] == [420, 140, 140]
    assert folds.dynamic_step(1999, 700) == (81, 3, "min_tail_fallback") and folds.dynamic_step(1300, 700)[2] == "exact_divisor"
    assert len(folds.dev_folds(2499)) == 34


def test_fold_figures(spark):
    def ics(values):
        return spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "candidate_label string, fold_id int, spearman_ic double")

    k = ["candidate_label"]
    assert ic.positive_ratio(ics([0.1, -0.2, 0.0, 0.3, None]), k).first().positive_ratio == 0.5
    assert ic.trimmed_mean(ics([1.0, 2.0, 3.0, 100.0, -50.0, 4.0, 5.0, 6.0, 7.0, 8.0]), k).first().trimmed_mean == 4.5
    assert ic.flip_count(ics([0.1, 0.2, -0.1, 0.0, -0.3, 0.4, None]), k).first().flips == 2
    w = ic.weighted_summary(ics([0.1, 0.2, 0.5]), k, 1.0).first()
    assert 0.2 < w.ic_mean < 0.5 and w.icir > 0


def test_tail_reject(spark):
    rows = [(f"f{i}", i / 10, i % 3, 0.1) for i in range(20)]
    df = spark.createDataFrame([(*r[:3], 9.0 if r[0] == "f19" else r[3] - i * 1e-6) for i, r in enumerate(rows)], "candidate_label string, a double, b int, c double")
    out = ic.tail_reject(df, ["a", "c"]).where("tail_rejected").collect()
    assert [r.candidate_label for r in out] == ["f19"]


def test_corr_drop(spark):
    summed = spark.createDataFrame([("x", f"factor_{i}", 20.0 - i, 20.0 - i, 0.1) for i in range(20)], "code string, candidate_label string, train_icir double, valid_icir double, valid_ic_mean double")
    pairs = spark.createDataFrame([("x", "factor_18", "factor_19", 0.95), ("x", "factor_16", "factor_17", 0.95)], "code string, a string, b string, mean_corr double")
    out = selection.corr_drop(selection.corr_losers(pairs, summed, ["code"]), summed, ["code"]).orderBy("place")
    assert [r.candidate_label for r in out.collect()] == ["factor_19", "factor_17"]


def test_signal_backtest_against_a_loop(spark):
    values = [10.0, 11.0, 9.0, 12.0, 13.0, 8.0, 9.5, 10.5]
    entries, exits = {0, 3, 4, 6}, {2, 4, 5}
    df = nav(spark, values).withColumn("i", F.date_diff("date", F.lit(DAY))).withColumn("entries", F.col("i").isin(list(entries))).withColumn("exits", F.col("i").isin(list(exits)))
    cash, units, want = 10000.0, 0.0, []
    for i, p in enumerate(values):
        if i in entries and i not in exits and not units:
            units, cash = cash / 1.001 / p, 0.0
        elif i in exits and i not in entries and units:
            cash, units = units * p * 0.999, 0.0
        want.append(cash + units * p)
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(column(signals.backtest(df), "equity"), want, strict=True))
    with pytest.raises(ValueError):
        signals.generate(df, "ma_cross", {"fast": 20, "slow": 5})


def test_risk_free_lowers_sharpe(spark):
    df = nav(spark, [1.0, 1.02, 1.01, 1.05, 1.08]).withColumn("equity", F.col("nav"))
    rates = spark.createDataFrame([(dt.date(2024, 1, 3), 0.0365)], "date date, annual_rf double")
    with_rf = panel.asof_rates(df, rates)
    assert all(math.isclose(r.rf, 1.0365 ** (1 / 252) - 1) for r in with_rf.collect())
    a, b = metrics.return_metrics(df, ["code"]).first(), metrics.return_metrics(with_rf, ["code"], rf="rf").first()
    assert b.sharpe < a.sharpe and a.max_drawdown < 0


def test_positions(spark):
    df = nav(spark, [-2.0, -0.5, 0.0, 0.5, 2.0]).withColumn("score", F.col("nav"))
    for c in (positions.sigmoid(F.col("score"), 0.0, 2.0), positions.tanh(F.col("score"), 0.0, 2.0), positions.piecewise(F.col("score"), 0.3, 0.3)):
        assert all(0 <= x <= 1 for x in column(df.withColumn("p", c), "p"))
    out = positions.smooth_and_gate(df.withColumn("raw", F.lit(0.5) + F.col("score") / 10), ["code"], span=1.0, gate=0.1)
    assert [round(x, 6) for x in column(out, "target")] == [0.3, 0.45, 0.45, 0.55, 0.7]


def test_trials(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.3, None, 0.2, 0.5, 0.4])], "trial_number int, value double")
    assert [r.trial_number for r in search.running_best(df).orderBy("trial_number").collect()] == [0, 1, 4]
    assert [r.trial_number for r in search.top_trials(df, least=2).orderBy("place").collect()] == [4, 5]
    assert all(0 < t["fast"] < t["slow"] <= 120 and t["slow"] >= t["fast"] + 5 for t in search.trial_params("ma_cross", 50))
    assert {t["window"] for t in search.trial_params("momentum", 400)} <= set(range(5, 121))
    for t in search.trial_params("multi_factor_score", 20):
        assert t["exit_threshold"] <= t["entry_threshold"] and len(t["factor_param_dict"]) == 13
        assert all(p["window"] in range(factors.POOL[n].params["window"][1], factors.POOL[n].params["window"][2] + 1, factors.POOL[n].params["window"][3]) for n, p in t["factor_param_dict"].items())


def test_neighbor_fill(spark):
    def fill(values):
        return column(panel.fill_by_neighbors(nav(spark, values).withColumnRenamed("nav", "value")), "value")

    assert fill([1.0, None, 3.0, None, 5.0]) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert fill([1.0, None, None, 4.0]) == [1.0, None, None, 4.0]
    assert fill([None, 2.0, 3.0]) == [None, 2.0, 3.0]


def test_ranker_learns(spark):
    df = spark.range(400).select("id", ((F.col("id") * 37 % 101) / 101.0).alias("x"), F.lit(1.0).alias("k")).withColumn("y", F.col("x") * 2).withColumn("date", F.date_add(F.lit(DAY), F.col("id").cast("int") % 50))
    model = ranker.train(df, ["x", "k"], "y", epochs=60, rate=0.05)
    worst = df.select(F.max(F.abs(ranker.predict(model) - F.col("y")))).first()[0]
    assert worst < 0.5
    with pytest.raises(ValueError):
        ranker.train(df.limit(5), ["x"], "y")


def test_yield_curve_keeps_the_last_row(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 9.0), ("a", "2024-01-01", 2.0), ("b", "2024-01-01", 5.0), ("a", "?", 1.0)], "`曲线名称` string, `日期` string, `1年` double").coalesce(1)
    assert [tuple(r) for r in prices.yield_curve(rows, "a", "1年").collect()] == [(DAY, 0.02)]


def test_stream_keeps_the_latest_of_a_batch(spark, tmp_path):
    from fathomline.streaming.upsert import keep_current

    spark.createDataFrame([("A", 1, 3.0), ("A", 3, 1.0), ("A", 2, 2.0)], "code string, at int, nav double").write.parquet(str(tmp_path / "in"))
    os.makedirs(tmp_path / "out.before")  # left by a broken exchange, before any table stood
    spark.createDataFrame([("B", 1, 7.0)], "code string, at int, nav double").write.mode("overwrite").parquet(str(tmp_path / "out.before"))
    stream = spark.readStream.schema("code string, at int, nav double").parquet(str(tmp_path / "in"))
    keep_current(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["code"], order="at").awaitTermination()
    assert {(r.code, r.at, r.nav) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("A", 3, 1.0), ("B", 1, 7.0)}


def test_stream_upsert(spark, tmp_path):
    from fathomline.streaming.upsert import keep_current

    for k, v in ((0, 1.0), (1, 2.0)):
        nav(spark, [v, v]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("code string, date date, nav double").parquet(str(tmp_path / "in"))
        keep_current(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["code", "date"]).awaitTermination()
        assert {r.nav for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {v}


def plain_curve(values, window, cash=10000.0, fees=0.001):
    """Equity of the momentum strategy, row by row."""
    equity, held, was_in, was_out, out = cash, False, False, False, []
    for i, p in enumerate(values):
        x = p / values[i - window] - 1 if i >= window else None
        now_in, now_out = x is not None and x > 0, x is not None and x <= 0
        if held:
            equity *= p / values[i - 1]
        if now_in and not was_in and not held:
            equity, held = equity / (1 + fees), True
        elif now_out and not was_out and held:
            equity, held = equity * (1 - fees), False
        was_in, was_out = now_in, now_out
        out.append(equity)
    return out


def test_optimize_against_a_plain_version(spark):
    """Trials run over the whole series; folds and segments cut the curve, with the row before each."""
    values = [1.0 + 0.3 * math.sin(i / 17) + 0.002 * i for i in range(260)]
    spans = [(1, "train", 0, 120), (1, "valid", 120, 160), (1, "test", 160, 200), (2, "train", 60, 180), (2, "valid", 180, 220), (2, "test", 220, 260)]
    table = factors.prepare(nav(spark, values)).drop("ret")
    bounds = spark.createDataFrame([("A", *s) for s in spans], "code string, fold_id int, segment string, start_pos int, end_pos int")
    out = {(r.fold_id, r.trial_number): r for r in search.optimize(spark, table, bounds, "momentum", 4).collect()}
    windows, wanted = [t["window"] for t in search.trial_params("momentum", 4)], {}
    for fold in (1, 2):
        for k, window in enumerate(windows):
            curve, row = plain_curve(values, window), out[fold, k]
            for segment, a, b in ((s, a, b) for f, s, a, b in spans if f == fold):
                part = curve[max(0, a - 1) : b]
                returns = [y / x - 1 for x, y in zip(part, part[1:], strict=False)]
                mean = sum(returns) / len(returns)
                deviation = math.sqrt(sum((r - mean) ** 2 for r in returns) / len(returns))
                assert math.isclose(row[f"{segment}_sharpe"], mean / deviation * math.sqrt(252) if deviation > 0 else 0.0, rel_tol=1e-6, abs_tol=1e-9)
                assert math.isclose(row[f"{segment}_mean_daily_return"], mean, rel_tol=1e-6, abs_tol=1e-12)
                assert math.isclose(row[f"{segment}_cumulative_return"], part[-1] / part[0] - 1, rel_tol=1e-6, abs_tol=1e-12)
            assert f'"window": {window}' in row.params
        best = max(range(4), key=lambda k: (out[fold, k].valid_sharpe, out[fold, k].value, -k))
        assert [k for k in range(4) if out[fold, k].is_best] == [best]
    found = search.walk_forward(spark, table, bounds, 4, "momentum").collect()
    assert {(r.fold_id, r.trial_number) for r in found} == {f for f, r in out.items() if r.is_best}


def test_extension_search(spark):
    """The extension wins only with a better validation figure, and never drops a label of its baseline."""
    rng = [math.sin(k * 12.9898) * 43758.5453 % 1 for k in range(4000)]
    rows = []
    for fold in (1, 2, 3):
        for segment in ("train", "valid"):
            for day in range(40):
                fwd = rng[(fold * 997 + day * 31 + (segment == "valid") * 501) % 4000]
                for n, label in enumerate("abc"):
                    noise = rng[(fold * 613 + day * 77 + n * 1009 + (segment == "valid") * 211) % 4000]
                    rows.append(("X", fold, segment, DAY + dt.timedelta(day), label, fwd * (n > 0) + noise, fwd))
    long = spark.createDataFrame(rows, "code string, fold_id int, segment string, date date, candidate_label string, value double, fwd double")
    summed = ic.candidate_summary(ic.by_fold(long, ["code", "candidate_label", "fold_id", "segment"]), ["code", "candidate_label"])
    paths = selection.forward_search(spark, long, summed, ["code"], roots=1, levels=1)
    baseline = selection.best_path(paths, ["code"])
    base = baseline.collect()[0]
    out = selection.extension_search(long, summed, baseline, ["code"]).collect()
    assert sum(r.is_final for r in out) == 1 and sum(r.source == "forward" for r in out) == 1
    assert all(set(base.labels) < set(r.labels) and r.train_icir > base.train_icir for r in out if r.source == "extension")
    assert max(r.valid_icir for r in out) == next(r.valid_icir for r in out if r.is_final)
    whole = selection.forward_search(spark, long, summed, ["code"], roots=3).collect()
    assert max(r.step for r in whole) <= 3 and {tuple(r.labels) for r in whole} >= {("a",), ("b",), ("c",)}
