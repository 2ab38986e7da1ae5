"""Chunked windows, packed folds, adaptive studies and the searches on them, against plain versions."""

import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import chunks, factors
from fathomline.operators import folds, ic, metrics, packed, positions, sampler, search, selection

DAY = dt.date(2024, 1, 1)


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return np.cumprod(1 + 0.02 * rng.normal(size=n) + 0.0005)


def table(spark, series):
    rows = [(c, DAY + dt.timedelta(i), None if v is None or np.isnan(v) else float(v)) for c, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "code string, date date, nav double")


def plain_factor(p, name, n, lookback=0):
    """A raw factor by definition, with windows of pandas."""
    p = pd.Series(p, dtype=float)
    r = p / p.shift(1) - 1

    def fit(w):
        x, y = np.arange(len(w)) - (len(w) - 1) / 2, w - w.mean()
        sxx, sxy, syy = (x * x).sum(), (x * y).sum(), (y * y).sum()
        return sxx, sxy, syy, w.mean()

    def r2(w):
        sxx, sxy, syy, _ = fit(w)
        return 0.0 if syy <= 0 else sxy * sxy / (sxx * syy)

    def t(w):
        sxx, sxy, syy, _ = fit(w)
        left = max(syy - sxy * sxy / sxx, 0.0)
        return 0.0 if left <= 1e-13 * syy or left == 0 else (sxy / sxx) / math.sqrt(left / (len(w) - 2) / sxx)

    def residual(w):
        sxx, sxy, _, mean = fit(w)
        return w[-1] / (mean + sxy / sxx * (len(w) - 1) / 2) - 1

    mean, low, high = p.rolling(n).mean(), p.rolling(n).min(), p.rolling(n).max()
    deviation = r.rolling(n).apply(lambda w: w.std(ddof=1), raw=True)
    of = {
        "momentum": lambda: p / p.shift(n) - 1, "ma_trend_state": lambda: p / mean - 1, "ma_slope": lambda: mean / mean.shift(lookback) - 1,
        "trend_r2": lambda: p.rolling(n).apply(r2, raw=True), "trend_tvalue": lambda: p.rolling(n).apply(t, raw=True), "trend_residual": lambda: p.rolling(n).apply(residual, raw=True),
        "price_position": lambda: (p - low) / (high - low).replace(0, np.nan), "breakout_strength": lambda: p / high.shift(1) - 1,
        "donchian_breakout": lambda: (p > high.shift(1)).astype(float), "volatility": lambda: deviation, "drawdown": lambda: p / high - 1,
        "risk_adjusted_momentum": lambda: (p / p.shift(n) - 1) / deviation.replace(0, np.nan),
        "sharpe_like_trend": lambda: r.rolling(n).mean() / r.rolling(n).apply(lambda w: w.std(), raw=True).replace(0, np.nan),
    }
    return of[name]().to_numpy(float)


def plain_score(raw, n):
    x = pd.Series(raw)
    d = x.rolling(n).apply(lambda w: 0.0 if (w == w[0]).all() else w.std(), raw=True)
    return ((x - x.rolling(n).mean()) / d.replace(0, np.nan)).fillna(0.0).to_numpy()


SERIES = {"A": walk(400, 1), "B": np.r_[walk(120, 2), [np.nan], walk(80, 3), np.full(90, 1.5)], "C": walk(30, 4)}


def test_windows_of_a_series_over_many_tasks(spark, monkeypatch):
    """Small chunks, gaps, a stretch that never changes and a short series: every factor and score by definition."""
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 64)
    monkeypatch.setattr(chunks, "SPAN_DAYS", 16)
    params = {n: {p: min(spec[0], 25) for p, spec in f.params.items()} for n, f in factors.POOL.items()}
    out = factors.factor_table(table(spark, SERIES), params=params, score_window=20).toPandas().sort_values("date")
    assert len(out) == sum(map(len, SERIES.values()))
    for code, values in SERIES.items():
        own = out[out.code == code]
        for name, p in params.items():
            raw = plain_factor(values, name, p["window"], p.get("lookback", 0))
            np.testing.assert_allclose(own[name].to_numpy(float), raw, rtol=1e-7, atol=1e-9, err_msg=f"{code} {name}")
            z = plain_score(own[name].to_numpy(float), 20) * (-1 if factors.POOL[name].inverted else 1)
            np.testing.assert_allclose(own[f"{name}_z"].to_numpy(float), z, rtol=1e-5, atol=1e-6, err_msg=f"{code} {name}_z")


def test_positions_number_a_series_in_spans(spark, monkeypatch):
    monkeypatch.setattr(chunks, "SPAN_DAYS", 7)
    out = chunks.positions(table(spark, SERIES)).orderBy("code", "date").collect()
    assert [r.pos for r in out] == [i + 1 for v in SERIES.values() for i in range(len(v))]


def plain_ic(x, y):
    a, b = pd.Series(np.round(x, packed.DIGITS)).rank(), pd.Series(y).rank()
    return None if len(x) < 2 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def plain_summary(rows, labels, weights=None):
    """(train mean, train ICIR, valid mean, valid ICIR) of a weighted sum; rows: {(fold, segment): ({label: values}, forward returns)}."""
    out = []
    for segment in ("train", "valid"):
        found = [plain_ic(sum(v[c] * (weights[k] if weights else 1.0) for k, c in enumerate(labels)), y) for (_, s), (v, y) in sorted(rows.items()) if s == segment]
        found = [x for x in found if x is not None]
        mean, std = (float(np.mean(found)), float(np.std(found))) if found else (None, None)
        out += [mean, mean / std if std and std > 1e-12 else 0.0]
    return out


@pytest.fixture(scope="module")
def candidates(spark):
    """Two series, three folds, five candidates of which some predict the forward return."""
    rng, rows, held = np.random.default_rng(9), [], {}
    for code in ("X", "Y"):
        for fold, segment in itertools.product((1, 2, 3), ("train", "valid")):
            fwd = rng.normal(size=40)
            values = {c: np.round(fwd * strength + rng.normal(size=40), 6) for c, strength in zip("abcde", rng.uniform(-0.2, 0.6, 5), strict=True)}
            values["a"][:10] = 0.0
            held.setdefault(code, {})[fold, segment] = values, fwd
            rows += [(code, fold, segment, DAY + dt.timedelta(d), c, None if c == "a" and d < 10 else float(v[d]), float(fwd[d])) for c, v in values.items() for d in range(40)]
    long = spark.createDataFrame(rows, "code string, fold_id int, segment string, date date, candidate_label string, value double, fwd double").repartition(5)
    packs = packed.pack(long, ["code"])
    singles = spark.createDataFrame([(code, c, [c]) for code in held for c in "abcde"], "code string, subset_id string, labels array<string>")
    summed = ic.candidate_summary(packed.subset_ics(packs, singles, ["code"]), ["code", "subset_id"]).withColumnRenamed("subset_id", "candidate_label")
    return packs, summed.cache(), held


def test_packed_ics_equal_the_ranked_table(spark, candidates):
    packs, summed, held = candidates
    for r in summed.collect():
        want = plain_summary(held[r.code], [r.candidate_label])
        assert np.allclose([r.train_ic_mean, r.train_icir, r.valid_ic_mean, r.valid_icir], want, atol=1e-9)


def plain_forward(rows, roots=3):
    """Every subset tried, with its figures and step."""
    figures = {}

    def figure(s):
        return figures.setdefault(s, plain_summary(rows, sorted(s)))

    level = sorted("abcde", key=lambda c: (-figure(frozenset(c))[1], c))[:roots]
    level, step, out = {frozenset(c): None for c in level}, 1, {}
    while level:
        out |= {s: (step, figure(s)) for s in level}
        nxt: dict = {}
        for s, floor in level.items():
            if floor is None or figure(s)[1] >= floor:
                for c in set("abcde") - s:
                    nxt[s | {c}] = max(nxt.get(s | {c}, -np.inf), figure(s)[1])
        level, step = nxt, step + 1
    return out


def test_forward_search(spark, candidates):
    packs, summed, held = candidates
    paths = selection.forward_search(spark, packs, summed, ["code"]).cache()
    for code, rows in held.items():
        want = plain_forward(rows)
        got = {frozenset(r.labels): r for r in paths.where(F.col("code") == code).collect()}
        assert set(got) == set(want)
        for s, (step, f) in want.items():
            r = got[s]
            assert r.step == step == r.factor_count and np.allclose([r.train_ic_mean, r.train_icir, r.valid_ic_mean, r.valid_icir], f, atol=1e-9)
        half = sorted(want, key=lambda s: (-want[s][1][1], -want[s][1][0], len(s), sorted(s)))[: max(1, len(want) // 2)]
        best = min(half, key=lambda s: (-want[s][1][3], -want[s][1][2], -want[s][1][1], len(s), sorted(s)))
        found = selection.best_path(selection.top_train_paths(paths, ["code"]), ["code"]).where(F.col("code") == code).first()
        assert frozenset(found.labels) == best


def test_extension_and_weights_score_what_they_say(spark, candidates):
    packs, summed, held = candidates
    base = selection.best_path(selection.forward_search(spark, packs, summed, ["code"], roots=1, levels=1), ["code"])
    out = selection.extension_search(packs, summed, base, ["code"]).collect()
    again = selection.extension_search(packs, summed, base, ["code"]).collect()
    assert sorted((r.code, r.subset_id, r.is_final) for r in out) == sorted((r.code, r.subset_id, r.is_final) for r in again)
    for code, rows in held.items():
        own = [r for r in out if r.code == code]
        start = next(r for r in own if r.source == "forward")
        for r in own:
            assert np.allclose([r.train_ic_mean, r.train_icir, r.valid_ic_mean, r.valid_icir], plain_summary(rows, r.labels), atol=1e-9)
            assert r.source == "forward" or (set(start.labels) < set(r.labels) and r.train_icir > start.train_icir)
        final = max(own, key=lambda r: (r.valid_icir, r.valid_ic_mean, r.train_icir, -r.factor_count))
        assert [r.subset_id for r in own if r.is_final] == [final.subset_id]
        # Sixteen trials over the fifteen ways to extend a single candidate: the study finds one of the better.
        ways = [plain_summary(rows, sorted({*start.labels, *more}))[1] for n in range(1, 5) for more in itertools.combinations(sorted(set("abcde") - set(start.labels)), n)]
        assert max(r.train_icir for r in own) >= sorted(ways)[len(ways) // 2]
    weights = selection.icir_weights(summed, ["code"])
    tuned = search.tune_weights(spark, packs, weights, ["code"], 25, top=10).collect()
    given = {(r.code, r.candidate_label): r.weight for r in weights.collect()}
    for r in tuned:
        assert abs(sum(r.weights) - 1) < 1e-9 and r.train_place <= 10
        raw = [w / sum(r.weights) for w in r.weights]
        assert all(0.95 / 1.05 - 1e-9 <= w / given[r.code, c] <= 1.05 / 0.95 + 1e-9 for w, c in zip(raw, r.labels, strict=True) if given[r.code, c] > 0)
        assert np.allclose([r.train_icir, r.valid_icir], [plain_summary(held[r.code], r.labels, r.weights)[i] for i in (1, 3)], atol=1e-9)
    assert len(tuned) == 20 and sum(r.is_best for r in tuned) == 2
    methods = search.best_method(packs, summed, ["code"]).collect()
    for code, rows in held.items():
        own = {r.method_name: r for r in methods if r.code == code}
        for r in own.values():
            assert np.allclose([r.train_icir, r.valid_icir], [plain_summary(rows, r.labels, r.weights)[i] for i in (1, 3)], atol=1e-9)
        assert max(own.values(), key=lambda r: (r.valid_icir, r.valid_ic_mean)).is_best


def bowl(u):
    return -float(((u - np.linspace(0.2, 0.8, len(u))) ** 2).sum())


def ridge(u):
    x, y = 4 * u[0] - 2, 3 * u[1] - 1
    return -((1 - x) ** 2) - 10 * (y - x * x) ** 2 - float(((u[2:] - 0.5) ** 2).sum())


def steps(u):
    return float(sum((x > 0.5) == (k % 2 == 0) for k, x in enumerate(u)))


@pytest.mark.parametrize(("objective", "kinds"), [(bowl, [0] * 6), (ridge, [0, 40, 0, 0]), (steps, [2] * 12)])
def test_studies_beat_even_points(objective, kinds):
    """The study's best of 80 trials beats that of as many evenly spread points for most of ten seeds, and on average."""
    wins, ahead = 0, 0.0
    for seed in range(10):
        u = sampler.spread(10, kinds, seed)
        values = np.array([objective(x) for x in u])
        while len(u) < 80:
            more = sampler.propose(u, values, kinds, 10, [seed, len(u)])
            u, values = np.vstack([u, more]), np.r_[values, [objective(x) for x in more]]
        even = max(objective(x) for x in sampler.spread(80, kinds, seed))
        wins, ahead = wins + (values.max() > even), ahead + values.max() - even
    assert wins >= 7 and ahead > 0


def test_study_over_spark(spark):
    keys = spark.createDataFrame([("a", [0, 5]), ("b", [2])], "code string, kinds array<int>")

    def evaluate(proposed):
        return proposed.withColumn("value", F.when(F.col("code") == "a", -F.abs(F.col("u")[0] - 0.3) - F.abs(F.col("u")[1] - 0.5)).otherwise(F.col("u")[0]))

    one, two = (sampler.study(keys, ["code"], evaluate, 30).orderBy("code", "trial_number").collect() for _ in range(2))
    assert one == two and len(one) == 60
    assert max(r.value for r in one if r.code == "a") > -0.05
    assert all(min(abs(r.u[1] - x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)) < 1e-12 for r in one if r.code == "a")
    alone = sampler.study(keys.where("code = 'a'"), ["code"], evaluate, 30).orderBy("trial_number").collect()
    assert alone == [r for r in one if r.code == "a"]


def test_position_figures_equal_the_windows(spark):
    rng = np.random.default_rng(3)
    nav, score = walk(90, 8), rng.normal(size=90) * 0.5
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), float(a), float(s)) for i, (a, s) in enumerate(zip(nav, score, strict=True))], "code string, date date, nav double, score double")
    target = positions.smooth_and_gate(df.withColumn("raw", positions.sigmoid(F.col("score"), 0.1, 3.0)), ["code"], span=4.0, gate=0.07)
    curve = positions.backtest(target)
    want = metrics.return_metrics(curve, ["code"]).first()
    trades = curve.where("turnover > 1e-12").count()
    raw = 1 / (1 + np.exp(-3.0 * (score - 0.1)))
    got = positions.figures(np.clip(np.stack([raw, raw * 0 + 1], 1), 0, 1), nav, np.array([4.0, 1.0]), np.array([0.07, 0.0]))
    for m in positions.FIGURES[:5]:
        assert math.isclose(got[m][0], want[m], rel_tol=1e-9, abs_tol=1e-12), m
    assert got["trade_count"][0] == trades and got["trade_count"][1] == 1


def test_position_search(spark):
    rng = np.random.default_rng(5)
    rows = [(c, DAY + dt.timedelta(i), i + 1, float(v), float(s)) for c in "AB" for i, (v, s) in enumerate(zip(walk(200, ord(c)), rng.normal(size=200), strict=True))]
    scored = spark.createDataFrame(rows, "code string, date date, pos int, nav double, score double")
    table_ = spark.createDataFrame([(200, f, s, a, b) for f, s, a, b in [(1, "train", 0, 80), (1, "valid", 80, 120), (2, "train", 60, 150), (2, "valid", 150, 200)]], "n long, fold_id int, segment string, start_pos int, end_pos int")
    out = search.search_positions(spark, scored, folds.with_folds(scored, table_), 12, top=5).toPandas()
    assert out.groupby(["code", "kind"]).size().eq(5).all() and len(out) == 30
    assert out.groupby("code").is_best.sum().eq(1).all() and out.groupby(["code", "kind"]).is_best_of_kind.sum().eq(1).all()
    for _, own in out.groupby("code"):
        assert own.loc[own.is_best, "valid_sharpe"].item() == own.valid_sharpe.max()
    r, data = out.iloc[0], scored.toPandas()
    own = data[data.code == r.code].sort_values("date")
    score, nav = own.score.to_numpy(), own.nav.to_numpy()
    x = {"sigmoid": lambda: 1 / (1 + np.exp(-r.p2 * (score - r.p1))), "tanh": lambda: 0.5 * (np.tanh(r.p2 * (score - r.p1)) + 1), "piecewise": lambda: (score - r.p1) / (r.p2 - r.p1)}[r.kind]()
    each = [positions.figures(np.clip(x[a:b, None], 0, 1), nav[a:b], np.array([r.span]), np.array([r.gate]))["sharpe"][0] for a, b in ((80, 120), (150, 200))]
    assert math.isclose(r.valid_sharpe, np.mean(each), rel_tol=1e-9)


def test_multi_factor_trials_against_a_plain_version(spark, monkeypatch):
    """Thirty trials: factors, scores, signals, curve and figures row by row, each trial by its own parameters."""
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 100)
    values = walk(260, 12)
    spans = [("train", 0, 160), ("valid", 160, 210), ("test", 210, 260)]
    bounds = spark.createDataFrame([("A", *s) for s in spans], "code string, segment string, start_pos int, end_pos int")
    out = search.optimize(spark, factors.prepare(table(spark, {"A": values})).drop("ret"), bounds, "multi_factor_score", 30).collect()
    assert sorted(r.trial_number for r in out) == list(range(30)) and sum(r.is_best for r in out) == 1
    assert len({r.params for r in out}) > 25
    for r in out:
        p = json.loads(r.params)
        score = sum(plain_score(plain_factor(values, n, q["window"], q.get("lookback", 0)), p["score_window"]) * (-1 if factors.POOL[n].inverted else 1) * p["factor_weight_dict"][n] for n, q in ((n, factors.resolve(n, p["factor_param_dict"].get(n))) for n in p["factor_weight_dict"]))
        assert p["exit_threshold"] <= p["entry_threshold"]
        equity, held, was_in, was_out, curve = 10000.0, False, False, False, []
        for i, x in enumerate(values):
            now_in, now_out = score[i] > p["entry_threshold"], score[i] <= p["exit_threshold"]
            if held:
                equity *= x / values[i - 1]
            enter, leave = now_in and not was_in, now_out and not was_out
            if enter and not leave and not held:
                equity, held = equity / 1.001, True
            elif leave and not enter and held:
                equity, held = equity * 0.999, False
            was_in, was_out = now_in, now_out
            curve.append(equity)
        for segment, a, b in spans:
            part = np.array(curve[max(0, a - 1) : b])
            assert math.isclose(r[f"{segment}_cumulative_return"], part[-1] / part[0] - 1, rel_tol=1e-6, abs_tol=1e-9), (r.trial_number, segment)
    train = {r.trial_number: r.value for r in out}
    chosen = set(sorted(train, key=lambda k: (-train[k], k))[:6]) | {k for k in train if all(train[k] > train[j] for j in range(k))}
    best = max((r for r in out if r.trial_number in chosen), key=lambda r: (r.valid_sharpe, r.value, -r.trial_number))
    assert best.is_best
