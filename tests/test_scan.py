"""Smoothing and gate over chunks against a loop over whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from fathomline.functions import chunks
from fathomline.operators import positions

DAY = dt.date(2000, 1, 1)


def plain(x, alpha, gate):
    smooth = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().clip(0, 1).to_numpy()
    out, last = [], None
    for v in smooth:
        last = v if not np.isnan(v) and (last is None or abs(v - last) >= gate) else last
        out.append(np.nan if last is None else last)
    return smooth, np.array(out)


@pytest.mark.parametrize(("span", "gate"), [(5.0, 0.05), (1.0, 0.0), (12.0, 0.3)])
def test_scan_equals_the_loop(spark, monkeypatch, span, gate):
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 37)
    rng = np.random.default_rng(3)
    series = {("A", 1): rng.random(400), ("A", 2): np.where(rng.random(300) < 0.3, np.nan, rng.random(300)), (None, 3): np.r_[[np.nan] * 80, rng.random(30), [np.nan] * 90, rng.random(5)], ("B", 1): np.full(60, 0.5)}
    rows = [(c, k, DAY + dt.timedelta(i), None if np.isnan(v) else float(v)) for (c, k), x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "code string, k int, date date, raw double").repartition(5)
    out = positions.smooth_and_gate(df, ["code", "k"], span=span, gate=gate).toPandas().sort_values("date")
    assert len(out) == len(rows)
    for (c, k), x in series.items():
        own = out[(out.code.isna() if c is None else out.code == c) & (out.k == k)]
        smooth, target = plain(x, 2 / (span + 1), gate)
        np.testing.assert_allclose(own.smoothed.to_numpy(float), smooth, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(own.target.to_numpy(float), target, rtol=1e-9, atol=1e-12)


def test_composition_on_a_million_rows():
    """Chunk by chunk as tasks would, against one loop over the whole series."""
    x = np.random.default_rng(8).random(1_000_000)
    alpha, gate, size = 0.3, 0.12, chunks.CHUNK_ROWS
    smooth = np.clip(positions.ema_values(x, alpha, None), 0, 1)
    target = positions.gate_values(smooth, gate, None)
    mean = kept = None
    for at in range(0, len(x), size):
        part, own = x[at : at + size], smooth[at : at + size]
        if at % (size * 40) == 0:
            np.testing.assert_allclose(positions.ema_values(part[:50], alpha, mean), smooth[at : at + 50], rtol=1e-9)
            np.testing.assert_allclose(positions.gate_values(own[:50], gate, kept), target[at : at + 50], rtol=1e-9)
        mean = positions.ema_compose(mean, positions.ema_summary(part, alpha), alpha)
        kept = positions.gate_compose(kept, positions.gate_summary(own, gate), gate)
    assert abs(mean[0] - positions.ema_values(x, alpha, None)[-1]) < 1e-9 and kept == target[-1]
