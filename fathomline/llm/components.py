"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace, lookup


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("a", "b"))).head())


def connected(space: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its smallest node.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its smallest one,
    then its smaller neighbours (and itself) to the smallest of them. Each step is an aggregate with
    partial sums, written, and a join of two written tables, so a node with very many edges is split.
    Edges ``a, b`` are longs in any direction; loops and nulls are left out.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = space.keep(ends, "edges0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        if k > rounds:
            raise RuntimeError("components did not settle")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = space.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"large{k}")
        # Larger neighbours b of a: the edges now hold the larger end as a, so tie each end a to the smallest around b.
        tied = lookup(now, least.select(F.col("a").alias("b"), "m"), ["b"]).select("a", F.col("m").alias("b"))
        tied = space.keep(tied.where("a <> b").distinct(), f"tied{k}")
        least = space.keep(tied.groupBy("a").agg(F.min("b").alias("m")), f"small{k}")
        small = lookup(tied, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        fresh = space.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"edges{k}")
        after = _state(fresh)
        space.drop(f"edges{k - 1}", f"large{k}", f"tied{k}", f"small{k}")
        now = fresh
        if after == state:
            break
        state = after
    # Settled, every edge joins a node to the smallest of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
