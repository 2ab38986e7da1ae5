"""Ranking models trained where the samples lie: tasks send sums, never samples, and the driver holds the model.

Samples are packed once into blocks of a few thousand, all of a date in one block. A pass over the blocks sums
a gradient (network) or histograms of gradients (boosted trees) on the executors; the driver takes one step
and starts the next pass. Models are applied as plain column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.keeping import kept
from fathomline.functions.rolling import change, series
from fathomline.operators import panel, signals

#: Samples of a block at least, unless they are the last.
BLOCK_ROWS = 4096


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``day, x, y`` as blocks of bytes; a day is never cut."""
    days, xs, ys = [], [], []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal size
        day, x, y = np.concatenate(days), np.concatenate(xs), np.concatenate(ys)
        days.clear(), xs.clear(), ys.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (day.astype("<i8"), x.astype("<f8"), y.astype("<f8")))], names=["n", "day", "x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        day = batch.column("day").to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(len(day), -1)
        y = batch.column("y").to_numpy()
        cuts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), len(day)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if size >= BLOCK_ROWS and day[a] != days[-1][-1]:
                yield block()
            days.append(day[a:b]), xs.append(x[a:b]), ys.append(y[a:b])
            size += b - a
    if size:
        yield block()


def blocks(samples: DataFrame, features: list[str], target: str, day: str = "date") -> DataFrame:
    """Samples without nulls as blocks ``n, day, x, y``, written once; a date stays in one block."""
    parts = max(1, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.unix_date(F.col(day).cast("date")).cast("long") if dict(samples.dtypes)[day] in ("date", "timestamp", "string") else F.col(day).cast("long")
    rows = samples.dropna(subset=[*features, target, day]).select(number.alias("day"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"), F.col(target).cast("double").alias("y"))
    return kept(rows.repartition(parts, "day").sortWithinPartitions("day").mapInArrow(_pack, "n int, day binary, x binary, y binary"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(days, features, targets) of each block."""
    for batch in batches:
        for n, day, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "day", "x", "y")), strict=True):
            yield np.frombuffer(day, "<i8"), np.frombuffer(x, "<f8").reshape(n, -1), np.frombuffer(y, "<f8")


def summed(held: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a vector that ``of`` works out from a block's days, features and targets.

    Tasks add up their blocks and executors add up tasks; one vector reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for day, x, y in _read(batches):
            v = of(day, x, y)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])

    rows = held.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the model has parameters or cells
    out = np.zeros(max((r["i"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


class Network:
    """One hidden layer of rectified units and a linear output, its weights in one flat vector."""

    def __init__(self, inputs: int, hidden: int):
        self.shapes = [(inputs, hidden), (hidden,), (hidden,), ()]
        self.ends = np.cumsum([int(np.prod(s)) for s in self.shapes])

    def parts(self, weights: np.ndarray) -> list[np.ndarray]:
        return [w.reshape(s) for w, s in zip(np.split(weights, self.ends[:-1]), self.shapes, strict=True)]

    def start(self, seed: int) -> np.ndarray:
        """Weights whose outputs keep the scale of their inputs; offsets 0."""
        rng = np.random.default_rng(seed)
        into, off, out, last = (np.zeros(s) for s in self.shapes)
        into += rng.normal(size=into.shape) * np.sqrt(2.0 / into.shape[0])
        out += rng.normal(size=out.shape) / np.sqrt(len(out))
        return np.concatenate([into.ravel(), off, out, last.ravel()])

    def output(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        into, off, out, last = self.parts(weights)
        return np.maximum(x @ into + off, 0.0) @ out + last

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum over samples of the squared error's gradient, and the error itself at the end."""
        into, off, out, last = self.parts(weights)
        before = x @ into + off
        active = np.maximum(before, 0.0)
        miss = active @ out + last - y
        back = np.where(before > 0, np.outer(miss, out), 0.0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), active.T @ miss, [miss.sum(), (miss * miss).sum()]]) * np.r_[np.full(self.ends[-1], 2.0), 1.0]


def moments(held: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of samples, mean and deviation of each feature); a constant feature deviates by 1."""
    sums = summed(held, lambda day, x, y: np.concatenate([[len(y)], x.sum(0), (x * x).sum(0)]))
    if not len(sums):
        return 0, np.zeros(0), np.zeros(0)
    n, d = sums[0], (len(sums) - 1) // 2
    mean = sums[1 : d + 1] / n
    std = np.sqrt(np.maximum(sums[d + 1 :] / n - mean * mean, 0.0))
    return int(n), mean, np.where(std < 1e-8, 1.0, std)


def train(samples: DataFrame, features: list[str], target: str, hidden: int = 16, epochs: int = 50, rate: float = 0.05, decay: float = 1e-4, seed: int = 42, day: str = "date", held: DataFrame | None = None) -> dict:
    """A network fitted to all samples by full gradients, one pass of all partitions an epoch.

    Steps are scaled by running means of the gradients and their squares. Features are standardised by the
    training samples; under ten samples it raises ValueError. ``held`` may give the blocks.
    """
    held = blocks(samples, features, target, day) if held is None else held
    n, mean, std = moments(held)
    if n < 10:
        raise ValueError("too few samples")
    net = Network(len(features), hidden)
    weights, first, second = net.start(seed), 0.0, 0.0
    for k in range(1, epochs + 1):
        found = summed(held, lambda day, x, y, w=weights: net.gradient(w, (x - mean) / std, y))
        g = found[:-1] / n + decay * weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights = weights - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    into, off, out, last = net.parts(weights)
    return {"kind": "network", "features": features, "mean": mean.tolist(), "std": std.tolist(), "into": into.tolist(), "off": off.tolist(), "out": out.tolist(), "last": float(last), "samples": n}


def _tree_places(tree: list, bins: np.ndarray) -> np.ndarray:
    """The node of each row of binned features: (feature, bin, left, right) or a leaf's value."""
    at = np.zeros(len(bins), int)
    for k, node in enumerate(tree):
        if isinstance(node, tuple):
            here = at == k
            at[here] = np.where(bins[here, node[0]] <= node[1], node[2], node[3])
    return at


def _margin(trees: list[list], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        values = np.array([0.0 if isinstance(v, tuple) else v for v in tree])
        out += values[_tree_places(tree, bins)]
    return out


def pair_gradients(days: np.ndarray, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over pairs of a day in which the first should rank higher."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    cuts = [0, *(np.flatnonzero(days[1:] != days[:-1]) + 1).tolist(), len(days)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at in range(a, b, 512):  # rows of the day against all of it, some at a time
            some = slice(at, min(b, at + 512))
            better = y[some, None] > y[None, a:b]
            p = np.where(better, 1.0 / (1.0 + np.exp(np.clip(score[some, None] - score[None, a:b], -500, 500))), 0.0)
            curve = p * np.where(better, 1 - p, 0.0)
            g[some] -= p.sum(1)
            g[a:b] += p.sum(0)
            h[some] += curve.sum(1)
            h[a:b] += curve.sum(0)
    return g, h


def boost(samples: DataFrame, features: list[str], relevance: str, trees: int = 15, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, day: str = "date", held: DataFrame | None = None) -> dict:
    """Boosted trees for the order within a date: a sample should score above those of the date with less ``relevance``.

    Features are cut at quantiles into ``bins``. A level of a tree is one pass: tasks score their blocks with
    the trees so far, work out pairwise gradients within each date, and add them up by node, feature and bin.
    """
    held = blocks(samples, features, relevance, day) if held is None else held
    known = samples.dropna(subset=[*features, relevance, day])
    cuts = known.select(*(F.percentile_approx(c, F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(10_000)).alias(c) for c in features)).first()  # a list for each feature
    if cuts[0] is None:
        raise ValueError("too few samples")
    edges = [np.unique(np.array(cuts[c], float)) for c in features]

    def binned(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)

    d, grown = len(features), []
    for _ in range(trees):
        tree: list = [0.0]
        open_ = [0]
        for level in range(depth + 1):

            def histogram(days, x, y, tree=tree, open_=open_):
                b = binned(x)
                g, h = pair_gradients(days, y, _margin(grown, b))
                at, out = _tree_places(tree, b), np.zeros((len(open_), d, bins, 2))
                for k, node in enumerate(open_):
                    here = at == node
                    for j in range(d):
                        out[k, j, :, 0] = np.bincount(b[here, j], g[here], bins)
                        out[k, j, :, 1] = np.bincount(b[here, j], h[here], bins)
                return out.ravel()

            found = summed(held, histogram)
            if not len(found):
                raise ValueError("too few samples")
            found = found.reshape(len(open_), d, bins, 2)
            nxt = []
            for k, node in enumerate(open_):
                total = found[k, 0].sum(0)
                tree[node] = float(-rate * total[0] / (total[1] + penalty))
                if level == depth:
                    continue
                left = found[k].cumsum(1)[:, :-1]
                right = total - left
                gain = left[..., 0] ** 2 / (left[..., 1] + penalty) + right[..., 0] ** 2 / (right[..., 1] + penalty) - total[0] ** 2 / (total[1] + penalty)
                gain[(left[..., 1] < 1e-6) | (right[..., 1] < 1e-6)] = -np.inf
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-9 and b < len(edges[j]):
                    tree[node] = (int(j), int(b), len(tree), len(tree) + 1)
                    nxt += [len(tree), len(tree) + 1]
                    tree += [0.0, 0.0]
            open_ = nxt
            if not open_:
                break
        grown.append(tree)
    return {"kind": "boosted", "features": features, "edges": [e.tolist() for e in edges], "trees": grown}


def predict(model: dict) -> Column:
    """The model as one expression, evaluated without leaving the JVM; null where a feature is."""
    names = model["features"]
    if model["kind"] == "network":
        x = [(F.col(f) - m) / s for f, m, s in zip(names, model["mean"], model["std"], strict=True)]
        units = [v * F.greatest(F.lit(0.0), sum((c * row[j] for c, row in zip(x, model["into"], strict=True)), F.lit(model["off"][j]))) for j, v in enumerate(model["out"])]
        return sum(units, F.lit(model["last"]))

    def node(tree: list, k: int) -> Column:
        if not isinstance(tree[k], tuple):
            return F.lit(tree[k])
        j, b, left, right = tree[k]
        return F.when(F.col(names[j]) <= model["edges"][j][b], node(tree, left)).otherwise(node(tree, right))

    known = F.lit(True)
    for f in names:
        known = known & F.col(f).isNotNull()
    return F.when(known, sum((node(t, 0) for t in model["trees"]), F.lit(0.0)))


def relevance(rank: Column) -> Column:
    """Training target of a rank: 1 for the best, 1/2 for the second, and so on."""
    return 1.0 / F.greatest(rank, F.lit(1.0))


def day_at(df: DataFrame, share: float, day: str = "date"):
    """The date at a share of the distinct dates, in order; None without dates."""
    days = F.array_sort(F.collect_set(day))  # one calendar
    return df.agg(F.element_at(days, (F.least(F.floor(F.size(days) * share) + 1, F.size(days))).cast("int")).alias("d")).first()["d"]


def fit_split(rows: DataFrame, features: list[str], kind: str = "network", train_ratio: float = 0.8, rank: str = "future_rank", **options) -> tuple[dict, DataFrame, dict]:
    """(model, rows with ``score`` and ``segment``, figures) of a model fitted to the dates before ``train_ratio`` of them.

    Networks learn 1 / rank, boosted trees the order of ranks within a date. Figures hold the samples and the
    mean rank IC of both parts.
    """
    if kind not in ("network", "boosted"):
        raise ValueError(f"unknown model: {kind}")
    rows = kept(rows.dropna(subset=[*features, rank]))
    cut = day_at(rows, train_ratio)
    part = rows.where(F.col("date") < F.lit(cut)) if cut is not None else rows
    if kind == "network":
        model = train(part.withColumn("_y", relevance(F.col(rank))), features, "_y", **options)
    else:
        model = boost(part.withColumn("_y", -F.col(rank)), features, "_y", **options)
    scored = kept(rows.withColumn("score", predict(model)).withColumn("segment", F.when(F.col("date") < F.lit(cut), "train").otherwise("valid")))
    figures = {}
    for s in ("train", "valid"):
        own = scored.where(F.col("segment") == s)
        figures[f"{s}_samples"], figures[f"{s}_rank_ic"] = own.count(), panel.rank_ic(own, "score", rank).first()["mean_rank_ic"]
    return model, scored, figures


def neural_signals(spark: SparkSession, prices: DataFrame, lookback: int = 20, top_k: int = 3, floor: float = 0.0, train_ratio: float = 0.8, refits: int = 1, delay: bool = False, hidden: int = 16, epochs: int = 50, rate: float = 0.05, decay: float = 0.0, seed: int = 42) -> DataFrame:
    """``code, date, nav, score, held, entries, exits``: daily holds of the ``top_k`` codes with the highest predicted return.

    A network learns the next return from the ``lookback`` before it, on the dates before ``train_ratio`` of
    the calendar; with more ``refits`` it is fitted anew at even distances after that, each time on all dates
    before, and scores the dates from there on. Only scores above ``floor`` are held. Under ten training
    samples there are no signals. ``delay`` moves signals by a row.
    """
    w = series("code")
    rows = prices.select("code", "date", "nav").withColumn("ret", change(F.col("nav"), 1, w))
    names = [f"x{k}" for k in range(lookback)]
    samples = panel.lookback_samples(rows, lookback).select("code", "date", "y", *(F.col("x")[k].alias(n) for k, n in enumerate(names)))
    samples = kept(samples.dropna())
    shares = [train_ratio + (1 - train_ratio) * k / refits for k in range(refits)]
    cuts = [day_at(prices, s) for s in shares]
    models = []
    for cut in cuts:
        part = samples.where(F.col("date") < F.lit(cut)) if cut is not None else samples
        held = blocks(part, names, "y")
        if moments(held)[0] >= 10:
            models.append((cut, train(part, names, "y", hidden, epochs, rate, decay, seed, held=held)))
    score = F.lit(None).cast("double")
    for k, (cut, model) in enumerate(models):
        score = F.when(F.col("date") >= F.lit(cut), predict(model)).otherwise(score) if k else predict(model)
    scored = samples.select("code", "date", score.alias("score"))
    best = panel.cross_section_top(scored, top_k, floor=floor).select("code", "date", F.lit(True).alias("held"))
    out = rows.join(scored, ["code", "date"], "left").join(best, ["code", "date"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    before = F.coalesce(F.lag("held").over(w), F.lit(False))
    entries, exits = F.col("held") & ~before, ~F.col("held") & before
    out = out.withColumns({"entries": entries, "exits": exits})
    if delay:
        out = out.withColumns({"entries": signals.delayed(F.col("entries"), w), "exits": signals.delayed(F.col("exits"), w)})
    return out.select("code", "date", "nav", "score", "held", "entries", "exits")


def save(model: dict) -> str:
    """A model as text; ``load`` reads it back."""
    return json.dumps(model)


def load(text: str) -> dict:
    model = json.loads(text)
    if model.get("kind") == "boosted":
        model["trees"] = [[tuple(v) if isinstance(v, list) else v for v in t] for t in model["trees"]]
    return model
