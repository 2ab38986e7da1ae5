"""Adaptive parameter search: batched tree-structured Parzen estimators, one study for each key.

A study proposes points of the unit cube. After a first round of evenly spread points there are two
densities, of the better and of the other trials so far; proposals are drawn from the first, and of each few
the one with the best ratio of both is taken. All studies propose a round together, the round is evaluated in one
job, and the trials so far, a bounded table for each key, are what the next round starts from.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keeping import kept

#: Trials of the first round and of a later one, share of better trials and their bound, width of bells.
STARTUP, ROUND, BETTER, MOST_BETTER, SPREAD = 10, 10, 0.1, 25, 1.5
#: Proposals drawn for one trial, and values drawn for one dimension of few values.
DRAWN, DRAWN_FEW = 2, 24
#: Trials a proposal looks at: all better ones, and the latest others.
REMEMBERED = 2000


def halton(n: int, base: int, first: int = 1) -> list[float]:
    """Points ``first`` to ``first`` + n - 1 of a low-discrepancy sequence in 0..1."""
    out = []
    for i in range(first, first + n):
        f, x = 1.0, 0.0
        while i:
            f /= base
            x += f * (i % base)
            i //= base
        out.append(x)
    return out


def primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def spread(n: int, kinds: list[int], seed: int = 42) -> np.ndarray:
    """n evenly spread points, moved around the cube by a seeded shift; beyond 16 dimensions they are drawn."""
    rng, d = np.random.default_rng([seed, 77]), len(kinds)
    out = rng.random((n, d))
    for j, b in enumerate(primes(min(d, 16))):
        out[:, j] = halton(n, b)
    return snapped((out + rng.random(d)) % 1.0, kinds)


def snapped(u: np.ndarray, kinds: list[int]) -> np.ndarray:
    """Dimensions of k > 0 values hold the middle of one of k equal parts; 0 is continuous."""
    k = np.array(kinds, float)
    return np.where(k > 0, (np.minimum(np.floor(u * np.maximum(k, 1)), np.maximum(k - 1, 0)) + 0.5) / np.maximum(k, 1), u)


def _log_density(x: np.ndarray, points: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Logarithm of a mixture of bells at ``points`` and one even share over the whole cube."""
    z = (x[:, None, :] - points) / width
    bells = np.concatenate([(-0.5 * z * z - np.log(width * np.sqrt(2 * np.pi))).sum(2), np.zeros((len(x), 1))], 1)
    top = bells.max(1)
    return top + np.log(np.exp(bells - top[:, None]).mean(1))


def _draw(rng: np.random.Generator, points: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Points near one of ``points``, or (as often as near one of them) anywhere."""
    pick = rng.integers(0, len(points) + 1, n)
    x = rng.random((n, points.shape[1]))
    near = pick < len(points)
    mid = points[pick[near]]
    y = rng.normal(mid, width)
    for _ in range(20):
        bad = (y < 0) | (y > 1)
        if not bad.any():
            break
        y[bad] = rng.normal(mid, width)[bad]
    x[near] = np.clip(y, 0.0, 1.0)
    return x


def _widths(points: np.ndarray, least: np.ndarray) -> np.ndarray:
    n, d = points.shape
    return np.clip(SPREAD * points.std(0) * n ** (-1.0 / (d + 4)), least, 0.5)


def propose(u: np.ndarray, values: np.ndarray, kinds: list[int], n: int, seed: list[int]) -> np.ndarray:
    """The next n points of a study with trials ``u`` and their ``values`` (higher is better, NaN for failed).

    Dimensions of few values go by the shares that each value has among better and other trials, one by one;
    the rest is drawn together, near a better trial.
    """
    rng, kind = np.random.default_rng(seed), np.array(kinds)
    rank = np.argsort(-np.nan_to_num(values, nan=-np.inf), kind="stable")
    cut = min(MOST_BETTER, len(values), max(3, int(np.ceil(BETTER * len(values)))))
    good, bad = u[rank[:cut]], u[np.sort(rank[cut:])[-REMEMBERED:]]
    out = np.empty((n, len(kinds)))
    few = (kind > 0) & (kind <= 4)
    for j in np.flatnonzero(few):
        k = int(kind[j])

        def share(x, k=k):
            c = np.bincount(np.minimum((x * k).astype(int), k - 1), minlength=k) + 1.0 / k
            return c / c.sum()

        p, q = share(good[:, j]), share(bad[:, j])
        drawn = rng.choice(k, (n, DRAWN_FEW), p=p)
        best = drawn[np.arange(n), np.argmax(np.log(p[drawn] / q[drawn]), 1)]
        # The best ratio alone would always be the same value: half of the proposals keep the better trials' shares.
        out[:, j] = (np.where(rng.random(n) < 0.5, best, drawn[:, 0]) + 0.5) / k
    if (~few).any():
        least = np.where(kind > 0, 0.5 / np.maximum(kind, 1), 0.01)[~few]
        a, b = good[:, ~few], bad[:, ~few]
        drawn = _draw(rng, a, _widths(a, least), n * DRAWN)
        ratio = _log_density(drawn, a, _widths(a, least)) - (_log_density(drawn, b, _widths(b, least)) if len(b) else 0.0)
        out[:, ~few] = drawn.reshape(n, DRAWN, -1)[np.arange(n), ratio.reshape(n, DRAWN).argmax(1)]
    return snapped(out, kinds)


def _next(by: list[str], n: int, done: int, seed: int):
    def run(parts):
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                key, kinds = tuple(getattr(r, f"k{i}") for i in range(len(by))), list(r.kinds)
                code = zlib.crc32(json.dumps([str(x) for x in key]).encode())
                told = r.told if r.told is not None else []
                if len(told) == 0:
                    u = spread(n, kinds, seed)
                else:
                    told = sorted(told, key=lambda t: t["trial_number"])
                    held = np.array([t["u"] for t in told], float).reshape(len(told), len(kinds))
                    u = propose(held, np.array([np.nan if t["value"] is None else t["value"] for t in told], float), kinds, n, [seed, code, done])
                rows += [(*key, done + i, x.tolist()) for i, x in enumerate(u)]
            yield pd.DataFrame(rows, columns=[*by, "trial_number", "u"])

    return run


def study(keys: DataFrame, by: list[str], evaluate: Callable[[DataFrame], DataFrame], n_trials: int, startup: int = STARTUP, batch: int = ROUND, seed: int = 42) -> DataFrame:
    """All trials of a study for each row of ``keys(by, kinds)``: ``by, trial_number, u, value`` and what else ``evaluate`` gives.

    ``kinds`` holds 0 for a continuous dimension, else its number of values. ``evaluate`` takes proposals
    ``by, trial_number, u`` and returns them with ``value`` (higher is better) and more columns. Runs with the
    same seed repeat exactly; keys do not influence each other.
    """
    kinds = dict(keys.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "trial_number int", "u array<double>"])
    done, trials = 0, None
    while done < n_trials:
        n = min(startup if not done else batch, n_trials - done)
        if trials is None:
            asked = keys.withColumn("told", F.lit(None).cast("array<struct<trial_number:int,u:array<double>,value:double>>"))
        else:
            told = trials.groupBy(*by).agg(F.collect_list(F.struct("trial_number", "u", "value")).alias("told"))  # at most n_trials of a key
            asked = keys.join(told, by, "left")
        asked = asked.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), "kinds", "told")
        proposed = kept(asked.mapInPandas(_next(by, n, done, seed), schema))
        found = kept(evaluate(proposed))
        trials = found if trials is None else trials.unionByName(found)
        done += n
    return trials
