"""Windows over one run of rows: prefix sums for means, deviations and regressions, sparse tables for extremes."""

from __future__ import annotations

import numpy as np


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    """The value n rows before, NaN where there is none."""
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = x[: len(x) - n]
    return out


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    with np.errstate(all="ignore"):
        return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def relative(x: np.ndarray, n: int) -> np.ndarray:
    """Change over n rows."""
    return divided(x, shifted(x, n)) - 1


class Rolled:
    """A series whose windows of any length come from the same sums; NaN while a window lacks a value.

    Values are taken from their mean before they are summed, and windows that never change have a deviation
    of exactly 0.
    """

    def __init__(self, x: np.ndarray):
        self.x, known = x, ~np.isnan(x)
        self.middle = float(x[known].mean()) if known.any() else 0.0
        self.off = np.where(known, x - self.middle, 0.0)
        self.count, self.sums, self.squares = (self._prefix(v) for v in (known, self.off, self.off * self.off))
        self.moves = self._prefix(np.r_[False, x[1:] != x[:-1]])
        self.products: np.ndarray | None = None
        self.tables: dict[bool, list[np.ndarray]] = {}

    @staticmethod
    def _prefix(v: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(v, dtype=float)])

    def _over(self, prefix: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(self.x), np.nan)
        if n <= len(self.x):
            out[n - 1 :] = prefix[n:] - prefix[: len(prefix) - n]
        return out

    def _full(self, v: np.ndarray, n: int) -> np.ndarray:
        return np.where(self._over(self.count, n) == n, v, np.nan)

    def still(self, n: int) -> np.ndarray:
        """Windows whose values are all the same: those without a move after their first row."""
        first = np.maximum(np.arange(len(self.x)) - n + 1, 0)
        return self.moves[1:] == self.moves[first + 1]

    def mean(self, n: int) -> np.ndarray:
        return self._full(np.where(self.still(n), self.x, self.middle + self._over(self.sums, n) / n), n)

    def variation(self, n: int) -> np.ndarray:
        """Sum of squared deviations from the window's mean.

        What the sums can't tell from their own rounding is worked out from the window's values.
        """
        total = self._over(self.sums, n)
        out = self._full(np.where(self.still(n), 0.0, np.maximum(self._over(self.squares, n) - total * total / n, 0.0)), n)
        with np.errstate(invalid="ignore"):
            lost = np.flatnonzero((out <= 1e-8 * self.squares[-1]) & ~self.still(n))
        for some in np.array_split(lost, -(-len(lost) // 1024)) if len(lost) else ():
            window = np.lib.stride_tricks.sliding_window_view(self.x, n)[some - n + 1]
            out[some] = ((window - window.mean(1, keepdims=True)) ** 2).sum(1)
        return out

    def deviation(self, n: int, less: int = 0) -> np.ndarray:
        """Standard deviation, of the population or (``less`` 1) of a sample."""
        return np.sqrt(self.variation(n) / (n - less)) if n > less else np.full(len(self.x), np.nan)

    def slope(self, n: int) -> tuple[np.ndarray, float]:
        """(sum of products with the row number, sum of its squares), both from their means."""
        if self.products is None:
            self.products = self._prefix(self.off * np.arange(len(self.x)))
        middle = np.arange(len(self.x)) - (n - 1) / 2
        return self._full(self._over(self.products, n) - middle * self._over(self.sums, n), n), n * (n * n - 1) / 12

    def extreme(self, n: int, highest: bool) -> np.ndarray:
        """Highest or lowest value of the window, from two overlapping spans whose length is a power of 2."""
        pick = np.maximum if highest else np.minimum
        levels = self.tables.setdefault(highest, [self.x])
        k = n.bit_length() - 1
        while len(levels) <= k:
            last, step = levels[-1], 1 << (len(levels) - 1)
            levels.append(pick(last, shifted(last, step)))
        return pick(levels[k], shifted(levels[k], n - (1 << k)))

    def high(self, n: int) -> np.ndarray:
        return self.extreme(n, True)

    def low(self, n: int) -> np.ndarray:
        return self.extreme(n, False)

    def standard(self, n: int) -> np.ndarray:
        """Rolling z-score with population deviation; undefined values become 0."""
        return np.nan_to_num(divided(self.x - self.mean(n), self.deviation(n)), nan=0.0, posinf=0.0, neginf=0.0)


class Series:
    """A price series with the windows of its prices, returns and averages, each worked out once."""

    def __init__(self, price: np.ndarray):
        self.price = Rolled(price)
        self.returns = Rolled(relative(price, 1))

    def factor(self, name: str, n: int, lookback: int = 0) -> np.ndarray:
        """A raw factor of the pool."""
        p, r = self.price, self.returns
        x = p.x
        if name == "momentum":
            return relative(x, n)
        if name == "ma_trend_state":
            return divided(x, p.mean(n)) - 1
        if name == "ma_slope":
            return relative(p.mean(n), lookback)
        if name in ("trend_r2", "trend_tvalue", "trend_residual"):
            sxy, sxx = p.slope(n)
            syy = p.variation(n)
            if name == "trend_residual":
                fitted = p.mean(n) + (divided(sxy, np.full(len(x), sxx)) * (n - 1) / 2)
                return np.where(syy == 0, 0.0, divided(x, np.where(np.abs(fitted) > 1e-12, fitted, np.nan)) - 1)
            if name == "trend_r2":
                return np.where(syy <= 0, 0.0 * syy, np.maximum(divided(sxy * sxy, sxx * syy), 0.0)) if sxx else np.where(syy <= 0, 0.0, np.nan)
            if n < 3:
                return np.full(len(x), np.nan)
            left = np.maximum(syy - sxy * sxy / sxx, 0.0)
            error = np.sqrt(left / max(n - 2, 1) / sxx)
            t = np.nan_to_num(divided(sxy / sxx, error), nan=0.0)
            return np.where(np.isnan(syy), np.nan, np.where(left <= 1e-13 * syy, 0.0, t))
        if name == "price_position":
            low = p.low(n)
            return divided(x - low, p.high(n) - low)
        if name == "breakout_strength":
            return divided(x, shifted(p.high(n), 1)) - 1
        if name == "donchian_breakout":
            with np.errstate(invalid="ignore"):
                return (x > shifted(p.high(n), 1)).astype(float)
        if name == "volatility":
            return r.deviation(n, 1)
        if name == "drawdown":
            return divided(x, p.high(n)) - 1
        if name == "risk_adjusted_momentum":
            return divided(relative(x, n), r.deviation(n, 1))
        if name == "sharpe_like_trend":
            return divided(r.mean(n), r.deviation(n))
        raise ValueError(f"unknown factor: {name}")
