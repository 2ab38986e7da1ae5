"""Toxicity scores from a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters), matched against the
lexicon by one Aho-Corasick automaton, and the weights of the hits outside exception phrases are summed
and normalised by length. Lexicon, weights and the final logistic curve are learned from labelled rows.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.runtime import Workspace, text_slices

# Look-alike letters of other scripts, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("абвгеёзикморсптухсіјѕԁһӏαβεηικνορτυχωϲ", "a6bree3nkmopcnmyxcijsdhlaβenikvoptuxwc", strict=True)) | {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "б": "b", "з": "e", "и": "u", "п": "n", "г": "r", "β": "b", "ρ": "p", "ν": "v", "ı": "i", "ł": "l", "ⅼ": "l"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Used where there is nothing to learn from.
DEFAULT_TERMS = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "loser": 3.0, "scum": 4.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "trash": 2.0, "clown": 2.0}
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum of salt", "pond scum", "stupid question")

_SPACE = " "
_JOINED = "'’-_*."  # signs that can stand between the letters of one word
_UNSEEN = "\u200b\u200c\u200d\u00ad\ufeff"
_KEPT = {ord(c): c for c in {*SIGNS, *_JOINED, *"0123456789"}}
_JOINTS = re.compile(f"[{re.escape(_JOINED)}]+")
_RUN = re.compile(f"[0-9{re.escape(''.join(SIGNS))}]+")
_STOPS = "".join(set(SIGNS) - set("@$") - set("0123456789"))  # at a word's end these are punctuation


class _Fold(dict):
    """Character table for str.translate: letters lose case, look-alikes become Latin.

    Digits and signs that can stand for letters or between them stay for ``_token``; all else becomes a space.
    """

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            char = chr(code - 0xFEE0)
            if ord(char) in _KEPT:
                self[code] = char
                return char
        out = "".join(HOMOGLYPHS.get(c, c if c.isalpha() else _SPACE) for c in char.lower())
        self[code] = out
        return out


def _folder() -> _Fold:
    return _Fold({ord(c): "" for c in _UNSEEN} | _KEPT)


def _letters(piece: str) -> str:
    """A piece of a word with signs and digits read as the letters they stand for: between letters always, at an end up to two of them."""
    piece = piece.strip(_STOPS)
    n = sum(map(str.isalpha, piece))
    if not n:
        return "".join(filter(str.isdigit, piece))

    def read(m: re.Match) -> str:
        run = m.group()
        if 0 < m.start() and m.end() < len(piece) or len(run) <= 2 <= n:
            return "".join(SIGNS.get(c, c) for c in run)
        return f" {run} " if run.isdigit() else _SPACE

    return _RUN.sub(read, piece)


def _token(token: str) -> str:
    """Words of a run without white space; single letters with signs between them are one word."""
    if token.isalpha():
        return token
    pieces = [p for p in _JOINTS.split(token) if p]
    if len(pieces) > 2 and max(map(len, pieces)) == 1:
        pieces = ["".join(pieces)]
    return _SPACE.join(map(_letters, pieces))


def fold(text: str, table: dict | None = None) -> str:
    """Folded text, words separated by single spaces, with a space at both ends.

    Case goes (accents stay: they tell words apart), look-alike letters become Latin, digits and signs inside a word are read as
    letters ("1d!ot"), signs between single letters are dropped ("i-d-i-o-t"). Numbers stay numbers and
    punctuation around a word goes.
    """
    words = text.translate(table if table is not None else _folder()).split()
    return f" {_SPACE.join(_SPACE.join(w if w.isalpha() else _token(w) for w in words).split())} "


@dataclass
class Model:
    """Patterns start with a space (a word's start); those that also end with one match whole words only."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.5
    offset: float = -3.0
    reach: int = 50

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            p = f" {p.strip()} "
            found.add_word(p, (len(p), None))
        if len(found):
            found.make_automaton()
        return found


def intensity(folded: str, automaton: ahocorasick.Automaton, reach: int) -> float:
    """Sum of hit weights over the third root of the length (texts under ``reach`` words count as that long)."""
    if not len(automaton):
        return 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for low, high in spared:
        for start in range(low, high):
            best.pop(start, None)
    words = max(folded.count(_SPACE) - 1, reach)
    return sum(best.values()) / math.cbrt(words / reach)


def scorer(model: Model):
    """A function from lists of texts to arrays of intensities."""
    automaton, table = model.automaton(), _folder()

    def run(texts: list[str | None]) -> np.ndarray:
        return np.array([intensity(fold(t, table), automaton, model.reach) if t else 0.0 for t in texts], np.float64)

    return run


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(model.slope * x + model.offset, -60, 60)))


def _patterns(words: set[str], shortest: int, longest: int) -> set[str]:
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(f" {w} ")
        for n in range(shortest, min(len(w), longest) + 1):
            out.add(" " + w[:n])
    return out


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of a text's five-word shingles: the same for most pairs of near copies."""
    for batch in batches:
        keys = []
        for _, texts in text_slices(batch, "text"):
            for text in texts:
                words = text.lower().split()
                shingles = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
                keys.append(min(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=7).digest()) for x in shingles))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("text"), pa.array(keys, pa.int64())], names=["id", "y", "text", "copies_key"])


def _fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps; both classes weigh the same."""
    scale = max(float(np.percentile(x[y == 1], 50)), 1e-6)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -60, 60)))
        grad = design.T @ (weight * (p - y)) + penalty * theta
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_terms: int = 500, min_share: float = 0.01, min_log_odds: float = 3.5, exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS, shortest: int = 4, longest: int = 10, max_phrases: int = 200) -> Model:
    """Learn lexicon, weights, exception phrases and curve.

    A bounded sample of labelled rows is used: at most ``max_rows`` (a third of them label 1), picked by
    a hash of their id; of near copies among them (same smallest shingle hash) one is kept. Rows without a
    0/1 label, id or text are left out; an id labelled twice counts with its larger label. Without a labelled
    row of both kinds the default lexicon is returned. The size of the model is a parameter, too: patterns
    are words and beginnings of words of ``shortest`` to ``longest`` letters, of which the ``max_terms``
    strongest make the lexicon (chosen among 20 times as many); at most ``max_phrases`` exception phrases
    are learned. Documents are scored by it whole, whatever their number.
    """
    label = F.col(label_col).cast("int")
    wanted = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).alias("y"))
    picked = None
    for y, most in ((1, max_rows // 3), (0, max_rows - max_rows // 3)):
        part = wanted.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    space = Workspace(spark, "toxicity")
    picked = space.keep(picked, "picked")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    keyed = space.keep(rows.join(F.broadcast(picked), "id").select("id", "y", "text").mapInArrow(_copy_keys, "id long, y int, text string, copies_key long"), "keyed")  # at most max_rows ids
    firsts = keyed.groupBy("copies_key", "y").agg(F.min("id").alias("id")).select("id")
    sample = space.keep(keyed.drop("copies_key").join(F.broadcast(firsts), "id", "left_semi"), "sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        space.drop("picked", "keyed", "sample")
        return Model({f" {t}": w for t, w in DEFAULT_TERMS.items()}, list(exceptions))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = Counter(), _folder()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(_patterns(set(fold(text.as_py(), table).split()), shortest, longest))
        names = list(seen)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[p] for p in part], pa.int64())], names=["pattern", "n"])

    least = max(3, math.ceil(min_share * pos))

    def counts(y: int, name: str) -> DataFrame:
        part = sample.where(F.col("y") == y).select("text").mapInArrow(tally, "pattern string, n long")
        return part.groupBy("pattern").agg(F.sum("n").alias(name))

    frequent = space.keep(counts(1, "a").where(F.col("a") >= least), "frequent")
    both = frequent.join(counts(0, "b"), "pattern", "left").fillna(0, ["b"])
    odds = F.log((F.col("a") + 0.5) / (F.lit(pos) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(neg) - F.col("b") + 0.5))
    ranked = both.withColumn("w", odds).where(F.col("w") >= min_log_odds).orderBy(F.desc("w"), F.length("pattern"), "pattern").limit(20 * max_terms)
    chosen: dict[str, float] = {}
    for r in ranked.collect():  # a bounded lexicon; a pattern whose beginning weighs as much adds nothing
        p, w = r["pattern"], float(r["w"])
        if len(chosen) < max_terms and not any(p[:n] in chosen for n in range(shortest + 1, len(p))):
            chosen[p] = w
    spared = _learned_exceptions(sample, chosen, most=max_phrases)
    model = Model(chosen or {f" {t}": w for t, w in DEFAULT_TERMS.items()}, [*exceptions, *spared])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = scorer(model)
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(start, len(texts)), pa.array(run(texts))], names=["y", "x"])

    points = sample.select("y", "text").mapInArrow(measure, "y int, x double").toPandas()  # at most max_rows pairs of numbers
    x, y = points["x"].to_numpy(), points["y"].to_numpy()
    if x[y == 1].any():
        model.slope, model.offset = _fit_curve(x, y)
    space.drop("picked", "keyed", "sample", "frequent")
    return model


def _learned_exceptions(sample: DataFrame, weights: dict[str, float], most: int, least: int = 3) -> list[str]:
    """Two-word phrases with a lexicon word that stand in label-0 texts, and in none of label 1."""
    lexicon = Model(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table, seen = lexicon.automaton(), _folder(), Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folded = fold(text, table)
                if len(automaton):
                    found = set()
                    for end, (n, _) in automaton.iter(folded):
                        start = end - n + 1
                        close = folded.find(_SPACE, start + 1)
                        before = folded.rfind(_SPACE, 0, start) if start else -1
                        after = folded.find(_SPACE, close + 1)
                        if before >= 0:
                            found.add(folded[before + 1 : close])
                        if after > 0:
                            found.add(folded[start + 1 : after])
                    seen.update((p, y) for p in found)
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "y", "n"])

    rows = sample.select("y", "text").mapInArrow(phrases, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return [r["phrase"] for r in rows.where((F.col("clean") >= least) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").limit(most).collect()]


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 appended; map-only. Null and empty texts get the score of no hit.

    Every row is scored by itself, repeated or not, whatever its id. A column named as ``into`` is replaced;
    other columns pass through. An empty table gives an empty one.
    """
    if into in docs.columns:
        docs = docs.drop(into)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = scorer(model)
        gc.disable()
        for batch in batches:
            texts = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            x = [measure(part) for _, part in text_slices(texts, f"c{column}")]
            found = probability(np.concatenate(x), model) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """True for the third of ids that training never sees; false for a null id, which no label can name."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; learned from rows that are not held out.

    Null and empty texts get the score of a text without hits, repeated rows a row each, a null id stays
    null. Columns of ``docs`` beyond ``doc_id`` and ``text`` are ignored, whatever their names. An empty
    table gives an empty one.
    """
    model = fit(spark, docs, labels.where(~held_out()))
    rows = score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
