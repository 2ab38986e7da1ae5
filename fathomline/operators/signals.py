"""Trading signals and the long-only backtest they drive."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.functions.rolling import change, full, series

# Default parameters of the strategies.
STRATEGIES: dict[str, dict] = {
    "buy_and_hold": {},
    "ma_cross": {"fast": 5, "slow": 20},
    "momentum": {"window": 20},
    "multi_factor_score": {"factor_weight_dict": {n: f.weight for n, f in factors.POOL.items()}, "factor_param_dict": {}, "score_window": factors.SCORE_WINDOW, "entry_threshold": factors.ENTRY, "exit_threshold": factors.EXIT},
}


def params_of(name: str, override: dict | None = None) -> dict:
    """Defaults with the override merged in, dictionaries one level deep."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    out = copy.deepcopy(STRATEGIES[name])
    for k, v in (override or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def rising(cond: Column, w: WindowSpec) -> Column:
    """True where a condition turns true."""
    now = F.coalesce(cond, F.lit(False))
    return now & ~F.coalesce(F.lag(now).over(w), F.lit(False))


def delayed(signal: Column, w: WindowSpec) -> Column:
    """The signal one row later."""
    return F.coalesce(F.lag(signal).over(w), F.lit(False))


def _conditions(df: DataFrame, wanted: list[tuple[str, dict]], by: tuple[str, ...]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """``df`` with helper columns, and (enter, leave) of each (strategy, parameters).

    Helpers are shared: averages, changes and factors that several ask for are worked out once.
    """
    w, p = series(*by), F.col("nav")
    means, changes, scores, out = set(), set(), [], []
    for name, params in wanted:
        if name == "ma_cross":
            fast, slow = int(params["fast"]), int(params["slow"])
            if not 0 < fast < slow:
                raise ValueError("fast and slow must satisfy 0 < fast < slow")
            means |= {fast, slow}
            out.append((F.col(f"_mean{fast}") > F.col(f"_mean{slow}"), F.col(f"_mean{fast}") < F.col(f"_mean{slow}")))
        elif name == "momentum":
            n = int(params["window"])
            if n <= 0:
                raise ValueError("window must be positive")
            changes.add(n)
            out.append((F.col(f"_change{n}") > 0, F.col(f"_change{n}") <= 0))
        elif name == "multi_factor_score":
            k = len(scores)
            scores.append(params)
            out.append((F.col("_scores")[k] > params["entry_threshold"], F.col("_scores")[k] <= params["exit_threshold"]))
        else:
            out.append((F.lit(True), F.lit(False)))  # bought once and held
    df = df.select("*", *(full(F.avg, p, n, w).alias(f"_mean{n}") for n in sorted(means)), *(change(p, n, w).alias(f"_change{n}") for n in sorted(changes)))
    return factors.add_scores(df, [(x["factor_weight_dict"], x["factor_param_dict"], x["score_window"]) for x in scores], by[0]), out


def generate(df: DataFrame, name: str, override: dict | None = None, by: tuple[str, ...] = ("code",), delay: bool = False) -> DataFrame:
    """``df`` with boolean ``entries`` and ``exits`` (and the ``score`` of multi_factor_score), for all series at once."""
    out, (conditions,) = _conditions(df, [(name, params_of(name, override))], by)
    w = series(*by)
    out = out.withColumns({"_in": F.coalesce(conditions[0], F.lit(False)), "_out": F.coalesce(conditions[1], F.lit(False))})
    out = out.withColumns({"entries": rising(F.col("_in"), w), "exits": rising(F.col("_out"), w)})
    if delay:
        out = out.withColumns({"entries": delayed(F.col("entries"), w), "exits": delayed(F.col("exits"), w)})
    score = [F.col("_scores")[0].alias("score")] if name == "multi_factor_score" else []
    return out.select(*df.columns, *score, "entries", "exits")


def generate_all(df: DataFrame, wanted: list[tuple[str, dict | None]], by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Rows of ``df`` once for each (strategy, override), with its number ``variant``, ``entries`` and ``exits``.

    The series are read and their windows worked out once for all variants.
    """
    out, conditions = _conditions(df, [(name, params_of(name, override)) for name, override in wanted], by)
    cells = F.array(*(F.struct(F.lit(k).alias("variant"), F.coalesce(a, F.lit(False)).alias("_in"), F.coalesce(b, F.lit(False)).alias("_out")) for k, (a, b) in enumerate(conditions)))
    rows = out.select(*df.columns, F.explode(cells).alias("_c")).select(*df.columns, "_c.*")
    w = series(*by, "variant")
    return rows.withColumns({"entries": rising(F.col("_in"), w), "exits": rising(F.col("_out"), w)}).drop("_in", "_out")


def backtest(df: DataFrame, init_cash: float = 10000.0, fees: float = 0.001, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """``position, traded, equity``: all in on an entry, all out on an exit, at the row's price, with fees.

    A row with both signals, an entry while invested and an exit while not, do nothing. Closed form over
    windows, so every series of a panel runs in one pass.
    """
    w = series(*by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    signal = F.when(F.col("entries") & ~F.col("exits"), 1).when(F.col("exits") & ~F.col("entries"), 0)
    out = df.withColumn("_signal", signal).withColumn("position", F.coalesce(F.last("_signal", ignorenulls=True).over(upto), F.lit(0)))
    out = out.withColumn("_held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    out = out.withColumn("traded", F.col("position") - F.col("_held"))
    growth = F.when(F.col("_held") == 1, F.col("nav") / F.lag("nav").over(w)).otherwise(F.lit(1.0))
    growth = growth * F.when(F.col("traded") == 1, F.lit(1 / (1 + fees))).when(F.col("traded") == -1, F.lit(1 - fees)).otherwise(F.lit(1.0))
    out = out.withColumn("_growth", growth)
    return out.withColumn("equity", init_cash * F.product("_growth").over(upto)).drop("_signal", "_held", "_growth")


def trade_count(df: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Positions opened (executed trades) and entry signals per series."""
    return df.groupBy(*by).agg(F.sum((F.col("traded") == 1).cast("long")).alias("trade_count"), F.sum(F.col("entries").cast("long")).alias("entry_signals"))


def segment_trade_count(df: DataFrame, bounds: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Entry signals inside each ``segment`` of ``bounds(code, segment, start_pos, end_pos)``; ``df`` has ``pos`` from 1."""
    inside = (F.col("pos") > F.col("start_pos")) & (F.col("pos") <= F.col("end_pos"))
    met = df.select(*by, "pos", F.col("entries").cast("long").alias("_e")).join(bounds, "code").where(inside)
    return met.groupBy(*by, "segment").agg(F.sum("_e").alias("trade_count"))
