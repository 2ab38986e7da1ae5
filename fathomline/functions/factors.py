"""The factor pool: thirteen technical factors over overlapping chunks, their parameters, groups and labels."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import kernels
from fathomline.functions.chunks import over_chunks, positions
from fathomline.functions.rolling import change, series


@dataclass(frozen=True)
class Factor:
    group: str
    params: dict[str, tuple[int, int, int, int]]  # default, low, high, step
    weight: float
    inverted: bool = False


def _n(default: int, low: int, high: int, step: int = 5) -> dict[str, tuple[int, int, int, int]]:
    return {"window": (default, low, high, step)}


# Names, groups, parameter grids and default weights of the pool.
POOL: dict[str, Factor] = {
    "momentum": Factor("趋势强度", _n(40, 10, 120), 0.12),
    "ma_trend_state": Factor("均线趋势", _n(60, 20, 120), 0.10),
    "ma_slope": Factor("均线趋势", {"window": (20, 10, 60, 5), "lookback": (5, 2, 20, 1)}, 0.08),
    "trend_r2": Factor("趋势强度", _n(20, 10, 60), 0.08),
    "trend_tvalue": Factor("趋势强度", _n(20, 10, 60), 0.08),
    "price_position": Factor("突破", _n(60, 20, 120), 0.08),
    "breakout_strength": Factor("突破", _n(60, 20, 120), 0.08),
    "donchian_breakout": Factor("突破", _n(20, 10, 60), 0.07),
    "trend_residual": Factor("价格结构", _n(20, 10, 60), 0.07, True),
    "volatility": Factor("波动调整趋势", _n(20, 10, 40), 0.08, True),
    "drawdown": Factor("波动调整趋势", _n(60, 20, 120), 0.08, True),
    "risk_adjusted_momentum": Factor("波动调整趋势", _n(20, 10, 60), 0.10),
    "sharpe_like_trend": Factor("波动调整趋势", _n(20, 10, 60), 0.06),
}
SCORE_WINDOW, ENTRY, EXIT = 60, 0.2, 0.0


def names_of_groups(groups: list[str]) -> list[str]:
    """Factors of the groups, in pool order within each group, each once."""
    known = {f.group for f in POOL.values()}
    if unknown := [g for g in groups if g not in known]:
        raise ValueError(f"unknown factor groups: {unknown}")
    return list(dict.fromkeys(n for g in groups for n, f in POOL.items() if f.group == g))


def resolve(name: str, override: dict[str, int] | None = None) -> dict[str, int]:
    """A factor's parameters, defaults replaced by ``override``."""
    if name not in POOL:
        raise ValueError(f"unknown factor: {name}")
    if unknown := set(override or {}) - set(POOL[name].params):
        raise ValueError(f"unknown parameters of {name}: {sorted(unknown)}")
    return {p: (override or {}).get(p, spec[0]) for p, spec in POOL[name].params.items()}


def validate(enabled: list[str], params: dict[str, dict[str, int]], weights: dict[str, float] | None = None) -> None:
    if not enabled:
        raise ValueError("no factor enabled")
    for name in enabled:
        resolve(name, params.get(name))
        if weights is not None and name not in weights:
            raise ValueError(f"no weight for {name}")


def label(name: str, params: dict[str, int]) -> str:
    return f"{name}({', '.join(f'{k}={params[k]}' for k in sorted(params))})"


def candidates(names: list[str] | None = None) -> list[tuple[str, str, dict[str, int]]]:
    """(label, factor, parameters) of the whole grid, parameters varying in declared order."""
    out = []
    for name in names or list(POOL):
        specs = POOL[name].params
        for values in itertools.product(*(range(low, high + 1, step) for _, low, high, step in specs.values())):
            params = dict(zip(specs, values, strict=True))
            out.append((label(name, params), name, params))
    return out


def candidate_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """``candidate_label, factor_name, factor_group, window, lookback`` of the grid, expanded on the cluster."""
    out = None
    for name in names or list(POOL):
        df = spark.range(1).select(F.lit(name).alias("factor_name"), F.lit(POOL[name].group).alias("factor_group"))
        for p, (_, low, high, step) in POOL[name].params.items():
            df = df.withColumn(p, F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
        if "lookback" not in df.columns:
            df = df.withColumn("lookback", F.lit(None).cast("int"))
        out = df if out is None else out.unionByName(df)
    text = F.when(F.col("lookback").isNull(), F.format_string("%s(window=%d)", "factor_name", "window")).otherwise(F.format_string("%s(lookback=%d, window=%d)", "factor_name", "lookback", "window"))
    return out.withColumn("candidate_label", text)


def fitting_candidates(df: DataFrame, names: list[str] | None = None, by: str = "code") -> DataFrame:
    """The candidates of the grid that each series is long enough for: at least one row has all the rows it looks at."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    grid = candidate_table(df.sparkSession, names)  # the grid, of fixed size
    return sizes.join(F.broadcast(grid), F.col("_n") > F.col("window") + F.coalesce("lookback", F.lit(0))).drop("_n")


def prepare(df: DataFrame, price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """Adds ``pos`` (row number from 1) and ``ret`` (daily return)."""
    w = series(by, order=order)
    return df.withColumn("pos", F.row_number().over(w)).withColumn("ret", change(F.col(price), 1, w))


def reach(params: dict[str, int]) -> int:
    """Rows before a row that a raw factor looks at."""
    return params["window"] + params.get("lookback", 0) + 1


def _worked_out(df: DataFrame, wanted: list[tuple[str, dict[str, int]]], score_window: int, finish, outs: dict[str, str], price: str, by: str, order: str) -> DataFrame:
    """``df`` with columns that ``finish`` makes of the raw factors and (with a score window) z-scores of each chunk.

    ``finish`` gets a function from a place in ``wanted`` to (raw, z-score turned so that higher is better).
    """
    had = "pos" in df.columns
    rows = df if had else positions(df, by, order)
    halo = max((reach(p) for _, p in wanted), default=1) + score_window

    def run(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        of, held = kernels.Series(columns[price]), {}

        def get(k: int, window: int = score_window) -> tuple[np.ndarray, np.ndarray | None]:
            if k not in held:  # -1 stands for the values themselves
                name, params = wanted[k] if k >= 0 else (None, {})
                raw = of.price.x if k < 0 else of.factor(name, params["window"], params.get("lookback", 0))
                raw = np.where(np.isfinite(raw), raw, np.nan)
                held[k] = raw, kernels.Rolled(raw), {}
            raw, rolled, scores = held[k]
            if window and window not in scores:
                scores[window] = rolled.standard(window) * (-1 if k >= 0 and POOL[wanted[k][0]].inverted else 1)
            return raw, scores.get(window)

        return finish(get)

    out = over_chunks(rows, halo, [price], run, outs, by)
    return out if had else out.drop("pos")


def add_factor(df: DataFrame, name: str, params: dict[str, int], into: str, price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """``df`` with the raw factor."""
    return add_factors(df, [(name, params, into)], price, by, order)


def add_factors(df: DataFrame, wanted: list[tuple[str, dict[str, int], str]], price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """``df`` with raw factors (name, parameters, column), all in one pass over overlapping chunks of each series."""
    def finish(get):
        return {into: get(k, 0)[0] for k, (_, _, into) in enumerate(wanted)}

    return _worked_out(df, [(name, params) for name, params, _ in wanted], 0, finish, {into: "double" for _, _, into in wanted}, price, by, order)


def candidate_values(df: DataFrame, wanted: list[tuple[str, dict[str, int]]], score_window: int = SCORE_WINDOW, price: str = "nav", by: str = "code", order: str = "date", own: bool = False) -> DataFrame:
    """``df`` with arrays ``raws`` and ``scores``: raw factors and z-scores (higher is better) of all candidates.

    ``own`` adds the values themselves and their z-score at the end.
    """
    def finish(get):
        pairs = [get(k) for k in [*range(len(wanted)), *([-1] if own else [])]]
        return {"raws": np.stack([r for r, _ in pairs], 1), "scores": np.stack([z for _, z in pairs], 1)}

    return _worked_out(df, wanted, score_window, finish, {"raws": "array<double>", "scores": "array<double>"}, price, by, order)


def factor_table(df: DataFrame, enabled: list[str] | None = None, params: dict[str, dict[str, int]] | None = None, score_window: int = SCORE_WINDOW, price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """Raw factors ``f`` and z-scores ``f_z`` (higher is better, gaps 0) beside the key, date and price."""
    enabled, params = enabled or list(POOL), params or {}
    validate(enabled, params)

    def finish(get):
        return {n: get(k)[0] for k, n in enumerate(enabled)} | {f"{n}_z": get(k)[1] for k, n in enumerate(enabled)}

    outs = dict.fromkeys([*enabled, *(f"{n}_z" for n in enabled)], "double")
    return _worked_out(df, [(n, resolve(n, params.get(n))) for n in enabled], score_window, finish, outs, price, by, order)


def add_scores(df: DataFrame, wanted: list[tuple[dict[str, float], dict[str, dict[str, int]], int]], by: str = "code", price: str = "nav", order: str = "date") -> DataFrame:
    """``df`` with the array ``_scores``: one score for each (weights, parameters, score window).

    Each distinct factor is worked out once, however many scores use it.
    """
    if not wanted:
        return df
    raw: dict[tuple, int] = {}
    sums = []
    for weights, params, window in wanted:
        validate(list(weights), params, weights)
        sums.append([(raw.setdefault((name, tuple(sorted(resolve(name, params.get(name)).items()))), len(raw)), weight, window) for name, weight in weights.items()])

    def finish(get):
        return {"_scores": np.stack([sum(get(k, window)[1] * weight for k, weight, window in terms) for terms in sums], 1)}

    return _worked_out(df, [(name, dict(p)) for name, p in raw], max(window for _, _, window in wanted), finish, {"_scores": "array<double>"}, price, by, order)


def multi_factor_score(df: DataFrame, weights: dict[str, float] | None = None, params: dict[str, dict[str, int]] | None = None, score_window: int = SCORE_WINDOW, price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """Weighted sum of the z-scores as ``score``; weights are not rescaled."""
    weights = weights or {n: f.weight for n, f in POOL.items()}
    return add_scores(df, [(weights, params or {}, score_window)], by, price, order).withColumn("_scores", F.col("_scores")[0]).withColumnRenamed("_scores", "score")


def panel_features(df: DataFrame, price: str = "nav", by: str = "code", order: str = "date") -> DataFrame:
    """The 28 features of the ranking panel, one column each."""
    names = [*(f"ret_{n}" for n in (1, 5, 10, 20, 60)), *(f"momentum_{n}" for n in (5, 20, 60, 120)), *(f"vol_{n}" for n in (5, 10, 20, 60)), *(f"ma_ratio_{n}" for n in (5, 10, 20, 60, 120))]
    names += ["ma_cross_5_20", "ma_cross_10_60", "ma_cross_20_120", "drawdown_20", "drawdown_60", "drawdown_120", "position_20", "position_60"]

    def run(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        of = kernels.Series(columns[price])
        out = {"return": of.returns.x}
        for name in names:
            kind, *ns = name.replace("ma_ratio", "ratio").replace("ma_cross", "cross").split("_")
            n = int(ns[0])
            if kind == "cross":
                out[name] = kernels.divided(of.price.mean(n), of.price.mean(int(ns[1]))) - 1
            else:
                out[name] = of.factor({"ret": "momentum", "vol": "volatility", "ratio": "ma_trend_state", "position": "price_position"}.get(kind, kind), n)
        return out

    had = "pos" in df.columns
    out = over_chunks(df if had else positions(df, by, order), 122, [price], run, dict.fromkeys(["return", *names], "double"), by)
    return out if had else out.drop("pos")
