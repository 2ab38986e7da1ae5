"""Ranking models summed over partitions, against single-process versions, and the strategy on top of them."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline import catalog
from fathomline.operators import panel, ranker

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    """500 rows of 50 dates; the order within a date follows a step and a bend of the features."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)).round(3)
    y = ((x[:, 0] > 0.3) * 1.0 + np.abs(x[:, 1]) + 0.2 * rng.normal(size=500)).round(3)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, date=[DAY + dt.timedelta(i % 50) for i in range(500)])
    return spark.createDataFrame(pdf).repartition(6), pdf.sort_values("date", kind="stable").reset_index(drop=True)


FEATURES = ["a", "b", "c"]


def test_gradient_by_small_steps():
    rng, net = np.random.default_rng(0), ranker.Network(3, 4)
    x, y, w = rng.normal(size=(20, 3)), rng.normal(size=20), net.start(1)
    found = net.gradient(w, x, y)
    error = lambda v: ((net.output(v, x) - y) ** 2).sum()
    assert math.isclose(found[-1], error(w))
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert math.isclose((error(w + step) - error(w - step)) / 2e-6, found[k], rel_tol=1e-4, abs_tol=1e-5)


def test_network_equals_a_single_process(spark, samples, monkeypatch):
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 40)
    df, pdf = samples
    model = ranker.train(df, FEATURES, "y", hidden=5, epochs=8, decay=1e-3)
    x, y = pdf[FEATURES].to_numpy(), pdf.y.to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    net = ranker.Network(3, 5)
    w, m, v = net.start(42), 0.0, 0.0
    for k in range(1, 9):
        g = net.gradient(w, x, y)[:-1] / len(y) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    got = np.concatenate([np.ravel(model[c]) for c in ("into", "off", "out", "last")])
    np.testing.assert_allclose(got, w, rtol=1e-7, atol=1e-9)
    assert model["samples"] == 500
    scored = df.select(*FEATURES, ranker.predict(ranker.load(ranker.save(model))).alias("s")).toPandas()
    mean, std = pdf[FEATURES].to_numpy().mean(0), pdf[FEATURES].to_numpy().std(0)
    np.testing.assert_allclose(scored.s, net.output(w, (scored[FEATURES].to_numpy() - mean) / std), rtol=1e-6, atol=1e-8)


def plain_boost(pdf, edges, trees, depth, rate, penalty, bins):
    """Trees by pairs one by one and every cut tried on the rows themselves."""
    b = np.stack([np.searchsorted(e, pdf[f].to_numpy(), side="left") for f, e in zip(FEATURES, edges, strict=True)], 1)
    y, days, score = pdf.y.to_numpy(), pdf.date.to_numpy(), np.zeros(len(pdf))
    for _ in range(trees):
        g, h = np.zeros(len(y)), np.zeros(len(y))
        for day in np.unique(days):
            rows = np.flatnonzero(days == day)
            for i in rows:
                for j in rows:
                    if y[i] > y[j]:
                        p = 1 / (1 + math.exp(score[i] - score[j]))
                        g[i] -= p
                        g[j] += p
                        h[i] += p * (1 - p)
                        h[j] += p * (1 - p)

        def grow(rows, level):
            value = -rate * g[rows].sum() / (h[rows].sum() + penalty)
            best = (1e-9, None)
            for j in range(3):
                for cut in range(min(bins - 1, len(edges[j]))):
                    left, right = rows[b[rows, j] <= cut], rows[b[rows, j] > cut]
                    if min(h[left].sum(), h[right].sum()) < 1e-6:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if level == depth or best[1] is None:
                score[rows] += value
            else:
                for part in best[1]:
                    grow(part, level + 1)

        grow(np.arange(len(y)), 0)
    return score


def test_boosted_trees_equal_a_single_process(spark, samples, monkeypatch):
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 40)
    df, pdf = samples
    model = ranker.boost(df, FEATURES, "y", trees=3, depth=2, rate=0.3, bins=8)
    want = pdf.assign(want=plain_boost(pdf, [np.array(e) for e in model["edges"]], 3, 2, 0.3, 1.0, 8))
    got = df.select("date", *FEATURES, ranker.predict(ranker.load(ranker.save(model))).alias("s")).toPandas()
    both = got.merge(want, on=["date", *FEATURES])
    assert len(both) == 500
    np.testing.assert_allclose(both.s, both.want, rtol=1e-7, atol=1e-9)
    assert df.limit(1).select(ranker.predict(model).alias("s"), F.lit(1)).count() == 1
    nothing = spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double").select(ranker.predict(model).alias("s")).first()
    assert nothing.s is None


def test_days_stay_in_one_block(spark, samples, monkeypatch):
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 7)
    df, _ = samples
    seen = [np.unique(day).tolist() for day, _, _ in ranker._read(iter(ranker.blocks(df, FEATURES, "y").toArrow().to_batches()))]
    flat = [d for days in seen for d in days]
    assert len(flat) == len(set(flat)) == 50 and len(seen) > 10


def test_boosted_ranker_beats_a_linear_model(spark):
    """Mean rank IC in training on the whole panel."""
    rows = catalog.ranked_rows(spark, "/root/testdata/sf0.1")
    _, scored, figures = ranker.fit_split(rows, catalog.RANK_FEATURES, "boosted", trees=20, rate=0.3)
    pdf = scored.where("segment = 'train'").toPandas()
    x = np.c_[pdf[catalog.RANK_FEATURES].to_numpy(), np.ones(len(pdf))]
    fit = x @ np.linalg.lstsq(x, -pdf.future_rank.to_numpy(), rcond=None)[0]
    linear = panel.rank_ic(spark.createDataFrame(pdf.assign(fit=fit)[["date", "fit", "future_rank"]]), "fit", "future_rank").first().mean_rank_ic
    assert figures["train_samples"] == len(pdf) > 5000
    assert figures["train_rank_ic"] > linear > 0.1


def prices(spark, n, codes="ABCD", seed=1, bump=None):
    rng = np.random.default_rng(seed)
    rows = []
    for c in codes:
        path = np.cumprod(1 + 0.01 * rng.normal(size=n))
        if bump is not None:
            path[bump:] *= 3
        rows += [(c, DAY + dt.timedelta(i), float(v)) for i, v in enumerate(path)]
    return spark.createDataFrame(rows, "code string, date date, nav double")


def test_neural_signals(spark):
    options = {"lookback": 4, "top_k": 2, "epochs": 5, "hidden": 4}
    out = ranker.neural_signals(spark, prices(spark, 60), **options).toPandas().sort_values(["code", "date"])
    assert len(out) == 240
    for _, own in out.groupby("date"):
        ranked = own.dropna(subset="score").sort_values(["score", "code"], ascending=[False, True]).head(2)
        assert set(own[own.held].code) == set(ranked[ranked.score > 0].code)
    for _, own in out.groupby("code"):
        held = own.held.to_numpy()
        before = np.r_[False, held[:-1]]
        assert (own.entries.to_numpy() == (held & ~before)).all() and (own.exits.to_numpy() == (~held & before)).all()
    late = ranker.neural_signals(spark, prices(spark, 60), delay=True, **options).toPandas().sort_values(["code", "date"])
    for code, own in late.groupby("code"):
        assert (own.entries.to_numpy()[1:] == out[out.code == code].entries.to_numpy()[:-1]).all() and not own.entries.to_numpy()[0]
    few = ranker.neural_signals(spark, prices(spark, 7, "A"), **options)
    assert few.where("held or entries or exits or score is not null").count() == 0


def test_refits_see_only_the_rows_before(spark):
    """Prices that change from day 54 on leave the scores of models fitted before as they are."""
    options = {"lookback": 4, "top_k": 1, "epochs": 4, "hidden": 3, "train_ratio": 0.5, "refits": 3}
    one, two = (ranker.neural_signals(spark, prices(spark, 60, bump=b), **options).where(F.col("date") < F.lit(DAY + dt.timedelta(54))).orderBy("code", "date").collect() for b in (None, 54))
    assert [r.score for r in one] == [r.score for r in two] and any(r.score is not None for r in one)


def test_unknown_model(spark, samples):
    with pytest.raises(ValueError):
        ranker.fit_split(samples[0].withColumn("future_rank", F.lit(1.0)), FEATURES, "other")
