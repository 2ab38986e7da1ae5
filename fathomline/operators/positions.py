"""Continuous positions from scores, and their backtest."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import chunks
from fathomline.functions.keeping import kept
from fathomline.functions.rolling import change, series


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column, center, slope) -> Column:
    return _clip(1.0 / (1.0 + F.exp(-F.lit(slope) * (x - F.lit(center)))))


def tanh(x: Column, center, slope) -> Column:
    return _clip(0.5 * (F.tanh(F.lit(slope) * (x - F.lit(center))) + 1.0))


def piecewise(x: Column, low: float, high: float) -> Column:
    high = low + 1e-6 if high <= low else high
    return _clip((x - F.lit(low)) / F.lit(high - low))


def raw_position(x: Column, kind: str, **params) -> Column:
    maps = {"sigmoid": sigmoid, "tanh": tanh, "piecewise": piecewise}
    if kind not in maps:
        raise ValueError(f"unknown position function: {kind}")
    return maps[kind](x, **params)


def score_quantiles(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """q10, q50, q90, min and max of a score; ranges without width are widened."""
    q = F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*by).agg(q.alias("_q"), F.min(score).alias("low"), F.max(score).alias("high"))
    out = out.select(*by, F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q90"), "low", "high")
    return out.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1e-6).otherwise(F.col("high")))


def ema_summary(x: np.ndarray, alpha: float) -> dict:
    """What a chunk does to a running mean, whatever came before.

    The first known value enters by the mean so far; from there the mean at the end is ``scale`` times it plus
    ``shift``. A gap lets the weight of the mean fade by a step.
    """
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return {"rows": len(x), "first": None, "value": None, "scale": 1.0, "shift": 0.0, "gaps": len(x)}
    scale, shift, last = 1.0, 0.0, known[0]
    for i in known[1:]:
        w = (1 - alpha) ** int(i - last)
        scale, shift, last = scale * w / (w + alpha), (shift * w + alpha * x[i]) / (w + alpha), i
    return {"rows": len(x), "first": int(known[0]), "value": float(x[known[0]]), "scale": scale, "shift": shift, "gaps": int(len(x) - 1 - known[-1])}


def ema_compose(state: tuple | None, part: dict, alpha: float) -> tuple | None:
    """(mean, gaps since its last value) after a chunk, None before any value."""
    if part["first"] is None:
        return None if state is None else (state[0], state[1] + part["rows"])
    value = part["value"]
    if state is not None:
        w = (1 - alpha) ** (state[1] + part["first"] + 1)
        value = (w * state[0] + alpha * value) / (w + alpha)
    return part["scale"] * value + part["shift"], part["gaps"]


def ema_values(x: np.ndarray, alpha: float, state: tuple | None) -> np.ndarray:
    """The running mean of a chunk's rows; a gap repeats it."""
    out, (mean, gaps) = np.empty(len(x)), state or (np.nan, 0)
    for i, v in enumerate(x.tolist()):
        if v != v:
            gaps += 1
        elif mean != mean:
            mean, gaps = v, 0
        else:
            w = (1 - alpha) ** (gaps + 1)
            mean, gaps = (w * mean + alpha * v) / (w + alpha), 0
        out[i] = mean
    return out


def gate_summary(x: np.ndarray, gate: float) -> dict:
    """What a chunk does to a kept value: where it ends for each value that it may come in with.

    A kept value first moves at a new highest or lowest value, so only those are starting points; ``start`` is
    the end without a value before.
    """
    x = x[~np.isnan(x)]
    ends: dict[int, float] = {}

    def end_from(i: int) -> float:
        way = []
        while i not in ends:
            way.append(i)
            later = np.flatnonzero(np.abs(x[i + 1 :] - x[i]) >= gate)
            if not len(later):
                ends[i] = float(x[i])
                break
            i = i + 1 + int(later[0])
        for k in way:
            ends[k] = ends[i]
        return ends[i]

    if not len(x):
        return {"start": None, "high": [], "high_at": [], "high_end": [], "low": [], "low_at": [], "low_end": []}
    high = np.flatnonzero(np.r_[True, x[1:] > np.maximum.accumulate(x)[:-1]])
    low = np.flatnonzero(np.r_[True, x[1:] < np.minimum.accumulate(x)[:-1]])
    return {"start": end_from(0), **{f"{n}{k}": v for n, at in (("high", high), ("low", low)) for k, v in (("", x[at].tolist()), ("_at", at.tolist()), ("_end", [end_from(int(i)) for i in at]))}}


def gate_compose(state: float | None, part: dict, gate: float) -> float | None:
    """The kept value after a chunk."""
    if part["start"] is None:
        return state
    if state is None:
        return part["start"]
    moves = []
    for n, reached in (("high", lambda v: v - state >= gate), ("low", lambda v: state - v >= gate)):
        k = next((i for i, v in enumerate(part[n]) if reached(v)), None)
        if k is not None:
            moves.append((part[f"{n}_at"][k], part[f"{n}_end"][k]))
    return min(moves)[1] if moves else state


def gate_values(x: np.ndarray, gate: float, state: float | None) -> np.ndarray:
    out, last = np.empty(len(x)), state
    for i, v in enumerate(x.tolist()):
        if v == v and (last is None or abs(v - last) >= gate):
            last = v
        out[i] = np.nan if last is None else last
    return out


def _scan(rows: DataFrame, by: list[str], column: str, into: str, summarise, compose, values) -> DataFrame:
    """A recursion over each series (``pos``) in chunks: summaries, their composition in order, then the values.

    Chunks are summed up side by side; a series' short summaries are composed in order; then each chunk
    starts from what came before it.
    """
    kinds = dict(rows.dtypes)
    rows = kept(rows.withColumn("_chunk", F.floor((F.col("pos") - 1) / chunks.CHUNK_ROWS).cast("int")))
    keys = [*by, "_chunk"]

    def summed(table: pa.Table) -> pa.Table:
        x = table.sort_by("pos").column(column).to_numpy().astype(float)
        return pa.table([*(table.column(c).slice(0, 1) for c in keys), pa.array([json.dumps(summarise(x))])], names=[*keys, "part"])

    parts = rows.select(*keys, "pos", column).groupBy(*keys).applyInArrow(summed, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_chunk int", "part string"]))
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "part"))).alias("parts"))  # one summary for each chunk

    def composed(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                state = None
                for p in r["parts"]:
                    out.append((*(r[c] for c in by), p["_chunk"], json.dumps(state)))
                    state = compose(state, json.loads(p["part"]))
            yield pd.DataFrame(out, columns=[*by, "_c", "_state"])

    states = lists.mapInPandas(composed, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_c int", "_state string"]))
    states = states.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_c", "_state")
    same = F.col("_chunk") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    ready = rows.join(states, same).select(*rows.columns, "_state")
    names = [c for c in rows.columns if c != "_chunk"]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "_chunk"), T.StructField(into, T.DoubleType())])

    def valued(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        v = values(table.column(column).to_numpy().astype(float), json.loads(table.column("_state")[0].as_py()))
        return pa.table([*(table.column(c) for c in names), pa.array(v, mask=np.isnan(v))], names=[*names, into])

    return ready.groupBy(*keys).applyInArrow(valued, schema)


def smooth_and_gate(df: DataFrame, by: list[str], raw: str = "raw", span: float = 1.0, gate: float = 0.0) -> DataFrame:
    """``smoothed`` (recursive mean, clipped) and ``target`` (kept until it moves by ``gate``).

    Both need the row before; a series is cut into chunks whose effect is composed, so one series is many
    tasks. Gaps repeat what came before them; before the first value both are null.
    """
    alpha, had = 2.0 / (span + 1.0), "pos" in df.columns
    rows = df if had else chunks.positions(df, by)
    rows = _scan(rows, by, raw, "smoothed", lambda x: ema_summary(x, alpha), lambda s, p: ema_compose(s, p, alpha), lambda x, s: ema_values(x, alpha, s))
    rows = rows.withColumn("smoothed", F.when(F.col("smoothed").isNotNull(), _clip(F.col("smoothed"))))
    out = _scan(rows, by, "smoothed", "target", lambda x: gate_summary(x, gate), lambda s, p: gate_compose(s, p, gate), lambda x, s: gate_values(x, gate, s))
    return out if had else out.drop("pos")


def backtest(df: DataFrame, by: tuple[str, ...] = ("code",), target: str = "target", fees: float = 0.001, init_cash: float = 10000.0) -> DataFrame:
    """``held, turnover, strategy_return, equity``: a target is held from the next row on; fees on its change."""
    w = series(*by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.coalesce(F.last(target, ignorenulls=True).over(upto), F.lit(0.0)))
    out = out.withColumn("held", F.coalesce(F.lag("_pos").over(w), F.lit(0.0))).withColumn("turnover", F.abs(F.col("_pos") - F.col("held")))
    out = out.withColumn("strategy_return", F.col("held") * F.coalesce(change(F.col("nav"), 1, w), F.lit(0.0)) - fees * F.col("turnover"))
    return out.withColumn("equity", init_cash * F.product(1 + F.col("strategy_return")).over(upto)).drop("_pos")


FIGURES = ("cumulative_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown", "trade_count")


def figures(raw: np.ndarray, nav: np.ndarray, span: np.ndarray, gate: np.ndarray, fees: float = 0.001) -> dict[str, np.ndarray]:
    """FIGURES of many trials over one segment: ``raw`` positions (day, trial), a span and a gate for each trial.

    The same smoothing, gate, holding and figures as ``smooth_and_gate``, ``backtest`` and
    ``metrics.return_metrics``.
    """
    alpha, days = 2.0 / (span + 1.0), len(nav)
    target = np.empty_like(raw)
    smooth = last = raw[0]
    target[0] = last
    for d in range(1, days):
        smooth = alpha * raw[d] + (1 - alpha) * smooth
        clipped = np.clip(smooth, 0.0, 1.0)
        last = np.where(np.abs(clipped - last) >= gate, clipped, last)
        target[d] = last
    held = np.vstack([np.zeros_like(target[:1]), target[:-1]])
    turnover = np.abs(target - held)
    change = np.r_[0.0, nav[1:] / nav[:-1] - 1]
    equity = np.cumprod(1 + held * change[:, None] - fees * turnover, axis=0)
    ret = equity[1:] / equity[:-1] - 1
    n = max(1, days - 1)
    total = equity[-1] / equity[0] - 1
    mean, deviation = (ret.mean(0), ret.std(0)) if days > 1 else (np.zeros(raw.shape[1]), np.zeros(raw.shape[1]))
    some = float(days > 1)
    drawdown = (equity / np.maximum.accumulate(equity, axis=0) - 1).min(0)
    sharpe = np.where(deviation > 0, mean / np.where(deviation > 0, deviation, 1.0) * np.sqrt(252.0), 0.0)
    return {"cumulative_return": total, "annual_return": some * ((1 + total) ** (252.0 / n) - 1), "annual_volatility": some * deviation * np.sqrt(252.0), "sharpe": some * sharpe, "max_drawdown": some * drawdown, "trade_count": (turnover > 1e-12).sum(0).astype(float)}


def fold_aggregate(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the figures over folds, sum of trades."""
    figures = ["cumulative_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown"]
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in figures), F.sum("trade_count").alias("trade_count"))
