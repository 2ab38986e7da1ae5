"""Scores of many candidate subsets: each fold's values packed as arrays, target ranks worked out once.

A row holds one (series, fold, segment): the candidates' values on the segment's days, gaps as 0, and the
centred ranks of the forward returns, scaled so that the rank correlation of a score is one dot product
with the score's own ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keeping import kept

#: Asks that meet a packed fold together.
BLOCK = 256
#: Sums are rounded, so that equal scores tie in whatever order their parts were added.
DIGITS = 10


def pack(long: DataFrame, by: list[str]) -> DataFrame:
    """``by, fold_id, segment, names, matrix, target`` of ``long(by, fold_id, segment, date, candidate_label, value, fwd)``.

    Days without a forward return are left out; ``matrix`` has a list for each name. A table that is packed
    already is returned as it is.
    """
    if "matrix" in long.columns:
        return long
    keys = [*by, "fold_id", "segment"]
    rows = long.where("fwd is not null")
    cells = F.array_sort(F.collect_list(F.struct("date", F.coalesce("value", F.lit(0.0)).alias("v"), "fwd")))
    each = rows.groupBy(*keys, "candidate_label").agg(cells.alias("c"))
    each = each.select(*keys, "candidate_label", F.transform("c", lambda x: x["v"]).alias("v"), F.transform("c", lambda x: x["fwd"]).alias("y"))
    folds = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate_label", "v"))).alias("m"), F.first("y").alias("y"))
    return kept(folds.select(*keys, F.transform("m", lambda x: x["candidate_label"]).alias("names"), F.transform("m", lambda x: x["v"]).alias("matrix"), F.col("y").alias("target")))


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 0, ties sharing their mean."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    out = np.empty(len(x))
    out[order] = np.repeat(first + (size - 1) / 2, size)
    return out


def centred(x: np.ndarray) -> np.ndarray | None:
    """Ranks from their mean, of length 1; None for a constant."""
    r = ranks(x)
    r -= r.mean()
    length = float(np.sqrt(r @ r))
    return r / length if length > 1e-9 else None


class Fold:
    """A packed fold in memory."""

    def __init__(self, names: list[str], matrix: list[list[float]], target: list[float]):
        self.place = {n: k for k, n in enumerate(names)}
        self.values = np.array(matrix, float).reshape(len(names), len(target))
        self.days = len(target)
        self.target = centred(np.array(target, float)) if self.days >= 2 else None

    def score(self, labels: list[str], weights: list[float] | None = None) -> np.ndarray:
        out = np.zeros(self.days)
        for k, n in enumerate(labels):
            if n in self.place:
                out = out + self.values[self.place[n]] * (1.0 if weights is None else weights[k])
        return out

    def ic(self, score: np.ndarray) -> float | None:
        """Rank correlation with the target, None if either is constant or under two days."""
        if self.target is None:
            return None
        own = centred(np.round(score, DIGITS))
        return None if own is None else float(own @ self.target)


def _evaluate(by: list[str]):
    """Each ask: a base, and what is added to it one at a time (or nothing), or weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, ids, found, days = [], [], [], []
            for row in range(batch.num_rows):
                names, matrix, target, asks = (batch.column(c)[row].as_py() for c in ("names", "matrix", "target", "asks"))
                fold = Fold(names, matrix, target)
                for ask in asks:
                    base = fold.score(ask["labels"], ask["weights"])
                    for name, label in zip(ask["ids"], ask["added"] or [None], strict=True):
                        found.append(fold.ic(base if label is None else base + fold.values[fold.place[label]] if label in fold.place else base))
                        ids.append(name)
                        who.append(row)
                        days.append(fold.days)
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in [*by, "fold_id", "segment"]), pa.array(ids, pa.string()), pa.array(days, pa.int64()), pa.array(found, pa.float64())], names=[*by, "fold_id", "segment", "subset_id", "n", "spearman_ic"])

    return run


def evaluate(packs: DataFrame, asks: DataFrame, by: list[str], count: int) -> DataFrame:
    """``by, fold_id, segment, subset_id, n, spearman_ic`` of all ``asks(by, ids, labels, added, weights)`` over all folds.

    An ask scores ``labels`` (with ``weights``, if any), alone under its single id, or with each of ``added``
    under the id at its place. Asks meet folds in blocks of about BLOCK, spread by their hash.
    """
    blocks = max(1, -(-count // BLOCK))
    ask = F.struct("ids", "labels", "added", "weights")
    held = asks.withColumn("_block", F.expr(f"pmod(xxhash64(ids), {blocks})")).groupBy(*by, "_block").agg(F.collect_list(ask).alias("asks")).drop("_block")
    kinds = dict(packs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "fold_id", "segment"]), "subset_id string", "n long", "spearman_ic double"])
    return packs.join(held, by).select(*by, "fold_id", "segment", "names", "matrix", "target", "asks").mapInArrow(_evaluate(by), schema)


def subset_ics(packs: DataFrame, subsets: DataFrame, by: list[str], weights: bool = False, count: int | None = None) -> DataFrame:
    """ICs by fold of ``subsets(by, subset_id, labels[, weights])``."""
    none = F.lit(None)
    asks = subsets.select(*by, F.array("subset_id").alias("ids"), "labels", none.cast("array<string>").alias("added"), (F.col("weights") if weights else none.cast("array<double>")).alias("weights"))
    return evaluate(pack(packs, by), asks, by, subsets.count() if count is None else count)
