"""Contiguous shards whose largest is as small as can be.

Ordered atomic groups (rows that must stay together) are cut into at most n contiguous runs. The
smallest capacity for which a greedy pass needs no more than n runs is found by binary search; the cuts
are the greedy ones at that capacity.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace, lookup, numbered

#: Bins of running size of which the driver holds the ends; all ends in 20 times as many are never fetched.
GRID = 50_000


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the runs a greedy pass makes, or None if it needs more than ``shards``.

    ``ends`` holds the inclusive running sizes of the groups, ascending; the last is the total.
    """
    cuts, at = [], 0
    while at < ends[-1]:
        k = bisect.bisect_right(ends, at + capacity)
        if len(cuts) == shards or not k or ends[k - 1] <= at:
            return None
        at = ends[k - 1]
        cuts.append(at)
    return cuts


def smallest_capacity(ends: list[int], shards: int, low: int, high: int) -> int:
    """Least capacity in low..high at which greedy_cuts succeeds; it must at ``high``."""
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int, grid: int = GRID) -> list[int]:
    """Running sizes at which to cut ``groups(size, upto)``, ``upto`` being the inclusive running size.

    The driver first sees the groups that cross a bin border (one per bin at most, all large groups
    among them). Knowing fewer ends only makes greedy need more, so this bounds the capacity from above;
    then the ends near the possible cuts are fetched and the search is finished on them exactly.
    """
    total, largest, n = groups.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).head()
    if not n:
        return []
    low, high = max(largest, -(-total // shards)), total
    if n <= grid:
        ends = sorted(r["upto"] for r in groups.select("upto").collect())
        return greedy_cuts(ends, smallest_capacity(ends, shards, low, high), shards)
    width = -(-total // grid)
    crossing = groups.where(F.expr(f"upto div {width} > (upto - size) div {width}")).select((F.col("upto") - F.col("size")).alias("start"), "upto").collect()
    whole = {r["start"]: r["upto"] for r in crossing}
    ends = sorted({*whole, *whole.values(), total} - {0})
    high = smallest_capacity(ends, shards, low, high)
    spans, least, most = [], 0, 0
    for _ in range(shards):
        k = bisect.bisect_right(ends, least + low)
        least = max(least, ends[k - 1] if k else 0)
        most = min(total, most + high)
        k = bisect.bisect_right(ends, most)
        below = ends[k - 1] if k else 0
        most = below if whole.get(below, 0) > most else most
        spans.append((least, most))
    near = groups.where(" or ".join(f"upto between {a} and {b}" for a, b in spans))
    if near.limit(20 * grid + 1).count() <= 20 * grid:
        ends = sorted({*ends, *(r["upto"] for r in near.select("upto").collect())})
        return greedy_cuts(ends, smallest_capacity(ends, shards, low, high), shards)
    return _cuts_by_lookup(groups, total, shards, low, high)


def _cuts_by_lookup(groups: DataFrame, total: int, shards: int, low: int, high: int) -> list[int]:
    """The same search, asking the table for each cut; for group sizes that leave too many cuts possible."""

    def cuts(capacity: int) -> list[int] | None:
        found, at = [], 0
        while at < total:
            end = groups.where(F.col("upto").between(at + 1, at + capacity)).agg(F.max("upto")).head()[0]
            if len(found) == shards or end is None:
                return None
            found.append(at := end)
        return found

    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if cuts(mid) is None else (low, mid)
    return cuts(low)


def shards(spark: SparkSession, docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, with_place: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Size: UTF-8 bytes of the text plus 1. Rows with equal texts are one atomic group, placed where its
    first row stands in the order (``order``, by default the id; it need not be unique). Null and empty
    texts are one group of rows of size 1. Within a shard rows are numbered from 0. A group larger than
    an even share fills a shard of its own; then later shards can stay empty. Repeated rows keep a row
    each. Other columns are ignored, whatever their names. ``with_place`` also returns the order as ``place``.
    """
    space = Workspace(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (order if order is not None else F.col(id_col)).alias("place"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("same"), F.monotonically_increasing_id().alias("nth"))
    base = space.keep(base, "base")
    copies = space.keep(base.groupBy("same").agg(F.min(F.struct("place", "nth")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    placed = lookup(base, copies, ["same"], "left").withColumn("first", F.coalesce("first", F.struct("place", "nth"))).drop("same")
    rows = numbered(space, placed, ["first", "place", "nth"], "rows", sums={"size": "upto"})
    groups = space.keep(rows.groupBy("first").agg(F.sum("size").alias("size"), F.max("upto").alias("upto")).select("size", "upto"), "groups")
    cuts = minimax_cuts(groups, n_shards)
    shard = sum(((F.col("upto") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    rows = rows.withColumn("shard", shard)
    begins = {r["shard"]: r["row"] for r in rows.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    begin = F.coalesce(*(F.when(F.col("shard") == k, F.lit(v)) for k, v in begins.items()), F.lit(0))
    space.drop("base", "copies", "groups")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["place"] if with_place else []))
