"""Benchmark passages in training documents, found by spaced seeds.

A seed is a fixed mask over a run of tokens; hashes cover the selected positions only, so a substituted
token at an ignored position does not hide a match. Hashes of all benchmark windows are joined with those
of all document windows that a bit map of the benchmark's hashes lets through; around every hit the two
token sequences are compared along the diagonal, and of all stretches that are long and similar enough the
one with most equal tokens is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace, lookup, settle_gc, text_slices, worker_memory

# Masks, 1 marking a compared position. Chosen by trial: every way to leave 12 or more equal tokens, four in
# five of the stretch, is hit by one of MASKS (all ways up to 20 tokens are tried in a test), and every way
# to leave the needed share of an item of 5 to 11 tokens by one of SHORT_MASKS.
MASKS = ("1111011", "1110100011", "10011111", "110010111")
SHORT_MASKS = ("11111", "101111", "110111", "111011", "111101", "1111001")
#: Items under SHORT tokens use SHORT_MASKS; items under LEAST tokens only match a document that equals them.
SHORT, LEAST = 12, 5
#: Bits of the map of benchmark seeds that goes to every worker, as a power of two: 8 MB at any size.
MAP_BITS = 26
#: Items compared with a document in one piece, and tokens a worker remembers from one slice to the next.
PIECE_ITEMS, CACHE_TOKENS = 64, 250_000
_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _TOKEN.findall(text.lower()) if text else []


class TokenHashes(dict):
    """XXH64 of tokens, remembered."""

    def __missing__(self, token: str) -> int:
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7)
        return h

    @classmethod
    def of_worker(cls) -> TokenHashes:
        held = worker_memory().setdefault("token hashes", cls())
        if len(held) > CACHE_TOKENS:
            held.clear()
        return held

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def best_stretch(same: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """Start, stop and equal tokens of the stretch with most equal tokens among all that hold the share ``similarity`` of them.

    Of several the shortest, then the first; it begins and ends with an equal token.
    """
    upto = np.concatenate([[0], np.cumsum(same)])
    over = upto - similarity * np.arange(len(upto))  # a stretch holds the share if this doesn't fall over it
    stops = np.flatnonzero(same) + 1
    if not len(stops):
        return 0, 0, 0
    # The earliest start for each stop: where the running minimum first comes down to the stop's value.
    starts = np.searchsorted(-np.minimum.accumulate(over), -(over[stops] + 1e-9))
    starts = stops[upto[starts]] - 1  # the first equal token from there
    equal = upto[stops] - upto[starts]
    k = int(np.lexsort((stops - starts, -equal))[0])
    return int(starts[k]), int(stops[k]), int(equal[k])


def _factors() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    return {m: rng.integers(1, 1 << 63, len(m), dtype=np.uint64) | np.uint64(1) for m in (*MASKS, *SHORT_MASKS, *("1" * n for n in range(1, LEAST)))}


_FACTORS = _factors()


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under a mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for o, f in enumerate(_FACTORS[mask]):
            if mask[o] == "1":
                out += tokens[o : o + n] * f
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= SHORT else SHORT_MASKS if n >= LEAST else ("1" * n,) if n else ()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token hashes of benchmark items, their seeds and the seeds' places."""
    encode = TokenHashes().encode
    for batch in batches:
        for start, texts in text_slices(batch, "text", 1_000_000):
            tokens = [encode(tokens_of(t)) for t in texts]
            found = [[(m, seeds(t, m)) for m in masks_of(len(t))] for t in tokens]
            keys = [np.concatenate([h for _, h in f]).view(np.int64) if f else np.zeros(0, np.int64) for f in found]
            places = [np.concatenate([np.arange(len(h), dtype=np.int32) for _, h in f]) if f else np.zeros(0, np.int32) for f in found]
            kept = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([kept.column("item_id"), pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["item_id", "words", "seeds", "places"])


def _places_in_map(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (seed >> np.uint64(64 - MAP_BITS)).astype(np.int64), (seed & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def _seed_map(seeded: DataFrame) -> np.ndarray:
    """Bytes with two bits set for each seed. At most 2 to the power of MAP_BITS - 6 rows come to the driver."""
    low = F.col("seed").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = seeded.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - MAP_BITS), low)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.astype("<i8").view(np.uint8)


def _scan(sent, masks: tuple[str, ...], whole: bool):
    """Documents that hold a seed in the map: ``doc_id``, token hashes, seeds and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle_gc()
        bits = sent.value
        for batch in batches:
            for start, texts in text_slices(batch, "text", 2_000_000):
                encode = TokenHashes.of_worker().encode
                tokens = [encode(tokens_of(t)) for t in texts]
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                begin = np.concatenate([[0], np.cumsum(sizes)])
                joined = np.concatenate(tokens)
                owner = np.repeat(np.arange(len(tokens)), sizes)
                hits = []
                for m in masks:
                    h = seeds(joined, m)
                    a, b = _places_in_map(h)
                    at = np.flatnonzero(_is_set(bits, a))
                    at = at[_is_set(bits, b[at])]
                    at = at[owner[at] == owner[at + len(m) - 1]]
                    hits.append((at, h[at]))
                if whole:  # documents of a few tokens, as a whole
                    for k in np.flatnonzero((sizes > 0) & (sizes < LEAST)).tolist():
                        hits.append((begin[k : k + 1], seeds(tokens[k], "1" * int(sizes[k]))))
                at = np.concatenate([x for x, _ in hits])
                order = np.argsort(at, kind="stable")
                at, h = at[order], np.concatenate([x for _, x in hits])[order]
                of = owner[at]
                docs, first = np.unique(of, return_index=True)
                ends = np.append(first[1:], len(of))
                for i in range(0, len(docs), 256):
                    some = list(zip(docs[i : i + 256].tolist(), first[i : i + 256].tolist(), ends[i : i + 256].tolist(), strict=True))
                    ids = batch.column("id").take(pa.array([start + k for k, _, _ in some]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([tokens[k].view(np.int64) for k, _, _ in some], pa.list_(pa.int64())),
                            pa.array([h[a:b].view(np.int64) for _, a, b in some], pa.list_(pa.int64())),
                            pa.array([(at[a:b] - begin[k]).astype(np.int32) for k, a, b in some], pa.list_(pa.int32())),
                        ],
                        names=["doc_id", "tokens", "seeds", "places"],
                    )

    return run


def _needed(n: int, least: int, similarity: float) -> int:
    """Equal tokens that an overlap with an item of n tokens needs."""
    return n if n < LEAST else min(least, max(LEAST, math.ceil(similarity * n - 1e-9)))


def _compare(least: int, similarity: float):
    """The best stretch of each document and item among the diagonals of their hits."""
    names = ["doc_id", "item_id", "doc_start", "item_start", "length", "equal_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                tokens = batch.column("tokens")[k].values.to_numpy()
                for pair in batch.column("pairs")[k]:
                    words, best = pair["words"].values.to_numpy(), (0, 0, 0, 0)
                    needed = _needed(len(words), least, similarity)
                    if len(words) < LEAST and len(words) != len(tokens):
                        continue
                    for diagonal in pair["diagonals"].as_py():
                        a, b = max(0, -diagonal), min(len(words), len(tokens) - diagonal)
                        same = tokens[a + diagonal : b + diagonal] == words[a:b]
                        if same.sum() >= needed:
                            start, stop, equal = best_stretch(same, similarity)
                            best = max(best, (equal, start - stop, -(diagonal + a + start), a + start))
                    if best[0] >= needed:
                        found.append((batch.column("doc_id")[k].as_py(), pair["item_id"].as_py(), -best[2], best[3], -best[1], best[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return run


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = 12, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, length, equal_tokens``: the best overlap of each pair that has one.

    An overlap counts if ``least`` tokens are equal (for shorter items, the share ``similarity`` of the
    item, 5 tokens at least) and ``similarity`` of its length. Items under 5 tokens overlap only with
    documents that equal them. The masks miss no such overlap at the default figures. Seeds of documents
    meet those of the benchmark in a join, so neither side's size is bounded; documents without a seed of the
    benchmark are left out before, by a bit map of fixed size. Null and blank texts overlap with nothing,
    items of a null id are left out, documents of a null id are reported with it. Repeated rows of either
    table are reported each. Empty tables give an empty result. Other columns are ignored, whatever their
    names.
    """
    space = Workspace(spark, "leaks")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    items = items.mapInArrow(_items, "item_id long, words array<long>, seeds array<long>, places array<int>")
    items = space.keep(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeded = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "item", F.col("s.places").alias("at"))
    seeded = space.keep(seeded, "seeded")
    sizes = items.select(F.size("words").alias("n")).where("n > 0").agg(F.count_if(F.col("n") >= SHORT), F.count_if(F.col("n").between(LEAST, SHORT - 1)), F.count_if(F.col("n") < LEAST)).head()
    if not any(sizes):
        return spark.createDataFrame([], "doc_id long, item_id long, doc_start long, item_start long, length long, equal_tokens long")
    sent = spark.sparkContext.broadcast(_seed_map(seeded))
    masks = (*(MASKS if sizes[0] else ()), *(SHORT_MASKS if sizes[1] else ()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    maybe = rows.mapInArrow(_scan(sent, masks, bool(sizes[2])), "doc_id long, tokens array<long>, seeds array<long>, places array<int>")
    maybe = space.keep(maybe.withColumn("row", F.monotonically_increasing_id()), "maybe")
    asked = maybe.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "row", F.col("s.places").alias("place"))
    hits = lookup(asked, seeded, ["seed"]).select("row", "item", (F.col("place") - F.col("at")).alias("diagonal"))
    # No more diagonals than tokens of both; a document that meets many items is compared in pieces.
    hits = space.keep(hits.groupBy("row", "item").agg(F.collect_set("diagonal").alias("diagonals")), "hits")
    counts = space.keep(hits.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / PIECE_ITEMS).alias("pieces")), "counts")
    pairs = lookup(lookup(hits, items.select("item", "item_id", "words"), ["item"]), counts, ["row"])
    pairs = pairs.groupBy("row", F.pmod(F.xxhash64("item"), F.col("pieces")).alias("piece")).agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("pairs"))
    pairs = space.keep(pairs.select("row", "pairs"), "pairs")
    compared = lookup(pairs, maybe.select("row", "doc_id", "tokens"), ["row"]).select("doc_id", "tokens", "pairs")
    return compared.mapInArrow(_compare(least, similarity), "doc_id long, item_id long, doc_start long, item_start long, length long, equal_tokens long")
