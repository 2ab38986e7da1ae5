"""Interleaving sources at target weights.

Every source is cut into blocks. Block j of a source with weight w is released at slot floor(j / w) and
due at slot ceil((j + 1) / w); each slot goes to the released block with the earliest deadline. So at any
slot every source is less than one block from its target. Weights are taken as exact fractions. The driver
walks all slots once (one for each block), holding a heap of the sources and where each range of slots
begins; tasks repeat the ranges side by side. When a source has no blocks left, a new schedule for the
others begins.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.runtime import BROADCAST_ROWS, Workspace, lookup, numbered

#: Slots of a range at most; a range is worked out in one piece.
RANGE_SLOTS = 1 << 14
#: What the driver holds follows the square of the number of sources, not the number of rows.
MOST_SOURCES = 2000


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in the same proportions."""
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*(p.denominator for p in parts))
    whole = [int(p * scale) for p in parts]
    least = math.gcd(*whole)
    return [x // least for x in whole]


def turns(parts: list[int], done: list[int], slot: int) -> Iterator[int]:
    """The source of each slot from ``slot`` on, earliest deadline first; ``done`` blocks of each stand before it."""
    total = sum(parts)
    waiting = [(j * total // parts[k], k, j) for k, j in enumerate(done)]  # release slot, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j))
        _, k, j = heapq.heappop(ready)
        yield k
        heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
        slot += 1


def ranges(blocks: list[int], weights: list[float]) -> Iterator[tuple]:
    """(sources, parts, blocks used by earlier phases, blocks done in this phase, slot in it, slots, first slot, source that ends) of each range.

    A phase, and with it a range, ends with the slot in which some source's last block stands.
    """
    used, at = [0] * len(blocks), 0
    while left := [s for s, n in enumerate(blocks) if used[s] < n]:
        parts, before, done, slot = exact([weights[s] for s in left]), [used[s] for s in left], [0] * len(left), 0
        order, ended = turns(parts, done, 0), False
        while not ended:
            begun, start = list(done), slot
            while slot - start < RANGE_SLOTS and not ended:
                k = next(order)
                done[k] += 1
                slot += 1
                ended = before[k] + done[k] == blocks[left[k]]
            yield left, parts, before, begun, start, slot - start, at + start, left[k] if ended else None
        for s, n in zip(left, done, strict=True):
            used[s] += n
        at += slot


def placed(left: list[int], parts: list[int], before: list[int], begun: list[int], start: int, slots: int, at: int, ended: int | None) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of each slot of a range."""
    done = [b + n for b, n in zip(before, begun, strict=True)]
    for t, k in zip(range(slots), turns(parts, begun, start), strict=False):
        yield left[k], done[k], at + t
        done[k] += 1


def schedule(blocks: Mapping[object, int], weights: Mapping[object, float]) -> list[tuple]:
    """Rows (source, first block, first slot, blocks, slots, slots within the range) of each range and source in it."""
    names = [s for s, n in blocks.items() if n > 0]
    out = []
    for one in ranges([blocks[s] for s in names], [weights[s] for s in names]):
        slots, at = one[-3:-1]
        rows: dict[int, list[tuple[int, int]]] = {}
        for k, block, slot in placed(*one):
            rows.setdefault(k, []).append((block, slot - at))
        out += [(names[k], r[0][0], at, len(r), slots, [t for _, t in r]) for k, r in rows.items()]
    return out


def _slots(space: Workspace, plan: list[tuple]) -> DataFrame:
    """``k, block, slot`` of every block, a task for each few ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("range").to_pylist():
                k, block, slot = zip(*placed(*pickle.loads(one)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], names=["k", "block", "slot"])

    parts = max(1, int(space.spark.conf.get("spark.sql.shuffle.partitions")))
    table = space.spark.createDataFrame([(n, bytearray(pickle.dumps(one))) for n, one in enumerate(plan)], "n int, range binary")
    return space.keep(table.repartition(min(parts, len(plan)), "n").select("range").mapInArrow(run, "k int, block long, slot long"), "slots")


def tempered(counts: Mapping[object, int], exponent: float) -> dict[object, float]:
    """Target weights in proportion to the counts raised to ``exponent``."""
    return {s: float(n) ** exponent for s, n in counts.items()}


def mix(spark: SparkSession, docs: DataFrame, weights: Mapping[object, float] | None = None, exponent: float = 0.7, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, source, weight, block, slot, position`` of every row.

    Within a source rows are taken in the order of a hash of their id. ``slot`` is the place of a row's
    block, ``position`` (gapless from 0) its place in the mixed sequence. Sources missing in ``weights``, or
    of weight 0 there, weigh 0.001 of the total, so every row is placed. All sources take part at their weights until they
    end; nothing is dropped or repeated. A null source is a source. Repeated rows are placed each. More than
    MOST_SOURCES sources raise ValueError: there is no schedule for them. Rows of a null id are placed like
    any other. An empty table gives an empty one. Other columns are ignored, whatever their names. The
    driver walks one slot a block, so ``block_docs`` should grow with the table.
    """
    space = Workspace(spark, "mix")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("nth"))
    base = base.withColumn("key", F.xxhash64(F.lit("mix"), "doc_id"))
    rows = numbered(space, base, ["source", "key", "doc_id", "nth"], "rows")
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not counts:
        return rows.select("doc_id", "source", F.lit(0.0).alias("weight"), *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")))
    target = dict(weights) if weights else tempered(counts, exponent)
    floor = sum(target.values()) * 0.001 or 1.0
    names = sorted(counts, key=lambda s: (s is not None, s))  # nulls first, as Spark sorts
    target = {s: w if (w := target.get(s)) and w > 0 else floor for s in names}
    blocks = [-(-counts[s] // block_docs) for s in names]
    plan = list(ranges(blocks, list(target.values())))
    begins = list(itertools.accumulate((counts[s] for s in names), initial=0))
    table = [(s, k, target[s] / sum(target.values()), begins[k]) for k, s in enumerate(names)]
    kind = T.StructType([T.StructField("of", docs.schema[source_col].dataType), T.StructField("k", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("begin", T.LongType())])
    sources = spark.createDataFrame(table, kind)  # MOST_SOURCES rows at most
    rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("place", F.col("row") - F.col("begin")).withColumn("block", F.expr(f"place div {block_docs}"))
    rows = rows.select("doc_id", "source", "weight", "k", "block", "place")
    slots = _slots(space, plan)
    if sum(blocks) > BROADCAST_ROWS:
        rows = space.keep(rows, "blocked")
    rows = lookup(rows, slots, ["k", "block"], rows=sum(blocks))
    # Only a source's last block can be short; positions after it move up.
    short = {}
    for *_, n, at, ended in plan:
        if ended is not None and (missing := blocks[ended] * block_docs - counts[names[ended]]):
            short[at + n - 1] = missing
    gaps = F.array(*(F.struct(F.lit(k).cast("long").alias("slot"), F.lit(v).cast("long").alias("n")) for k, v in sorted(short.items()))) if short else None
    moved = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + F.when(g["slot"] < F.col("slot"), g["n"]).otherwise(0)) if short else F.lit(0)
    return rows.select("doc_id", "source", "weight", "block", "slot", (F.col("slot") * block_docs + F.col("place") % block_docs - moved).cast("long").alias("position"))
