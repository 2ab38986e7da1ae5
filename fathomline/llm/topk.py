"""Exact top-k search by inner product over paged metric trees.

Integer vectors become points of a metric space in which a larger inner product is a smaller distance:
each gets one more coordinate that brings all to the same length, queries get zero there. Points are
dealt into pages of bounded size; every page is an M-tree: nodes with a pivot, a covering radius and
the distances of their children to the pivot. Queries walk a page best-first by lower bound, and skip
whatever the stored distances rule out by the triangle inequality before computing a distance. The queries
of a block walk together: each goes on to its next leaves, and all that meet in a leaf are scored there by
one matrix product, which is exact: of floats where all sums fit into their whole numbers.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace

#: Vectors of a page, queries searched together in it, and entries of a tree node.
PAGE_ROWS, BLOCK_QUERIES, NODE_ENTRIES = 4096, 512, 32
#: Slack of bounds computed in floating point, in units of distance, and of the common length.
SLACK = 1e-6
#: Leaves a query goes to in its first round, and how many times as many in each further round.
FIRST_LEAVES, MORE_LEAVES = 1, 3
#: The score below all others.
LEAST = np.iinfo(np.int64).min


def whole(largest: float) -> type:
    """The kind of number whose sums of products are exact up to the largest squared norm."""
    return np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else np.int64


def place_in_run(starts: np.ndarray) -> np.ndarray:
    """The place of each row within its run of rows; ``starts`` marks the first row of each."""
    firsts = np.flatnonzero(starts)
    return np.arange(len(starts)) - np.repeat(firsts, np.diff(np.r_[firsts, len(starts)]))


class MTree:
    """A page as arrays: nodes in levels, children contiguous, each child with its distance to the node's pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, extra: np.ndarray):
        self.ids, self.vectors, self.whole = ids, vectors, None
        self.points = np.concatenate([vectors.astype(np.float64), extra[:, None]], 1)
        # Bulk load: order by distance to a first pivot, then to a second within runs, so that nodes are close-knit.
        order = self._order(np.arange(len(ids)))
        self.ids, self.vectors, self.points = ids[order], vectors[order], self.points[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # pivot, radius, first child, end
        self.parent: list[np.ndarray] = []  # distance of each child to its node's pivot
        centers, radii = self.points, np.zeros(len(ids))
        while True:
            first = np.arange(0, len(centers), NODE_ENTRIES)
            end = np.minimum(first + NODE_ENTRIES, len(centers))
            pivots = np.add.reduceat(centers, first, axis=0) / (end - first)[:, None]
            away = np.sqrt(((centers - np.repeat(pivots, end - first, axis=0)) ** 2).sum(1))
            self.parent.append(away)
            radius = np.maximum.reduceat(away + radii, first) + SLACK
            self.levels.append((pivots, radius, first, end))
            if len(first) == 1:
                break
            centers, radii = pivots, radius

    def _order(self, rows: np.ndarray) -> np.ndarray:
        """Rows split in two by nearness to two far points, again and again."""
        if len(rows) <= NODE_ENTRIES:
            return rows
        at = self.points[rows]
        far = at[((at - at[0]) ** 2).sum(1).argmax()]
        other = at[((at - far) ** 2).sum(1).argmax()]
        lean = ((at - far) ** 2).sum(1) - ((at - other) ** 2).sum(1)
        order = rows[np.argsort(lean, kind="stable")]
        half = max(NODE_ENTRIES, (len(rows) // 2) // NODE_ENTRIES * NODE_ENTRIES)
        return np.concatenate([self._order(order[:half]), self._order(order[half:])])

    def search(self, query: np.ndarray, length: float, k: int, skip: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) of one query, ties to smaller ids, and how many distances were computed."""
        _, scores, ids, computed = self.search_block(query[None, :], length, k, np.array([skip]))
        return list(zip(scores.tolist(), ids.tolist(), strict=True)), computed

    def _bounds(self, queries: np.ndarray, length: float, slack: float) -> tuple[np.ndarray, int]:
        """Lower bounds of the distance of each query to what each leaf holds, and how many distances they took."""
        asked = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], 1)
        bound, computed = np.zeros((len(queries), 1)), 0
        for level in range(len(self.levels) - 1, -1, -1):
            pivots, radius, first, end = self.levels[level]
            squares = (asked * asked).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * (asked @ pivots.T)
            away = np.sqrt(np.maximum(squares, 0.0))
            # A node holds nothing nearer than its covering radius allows, and a leaf nothing within its innermost row.
            here = away - radius if level else np.maximum(away - radius, np.minimum.reduceat(self.parent[0], first) - away)
            bound = np.maximum(bound, here - slack)
            computed += away.size
            if level:
                bound = np.repeat(bound, end - first, axis=1)
        return bound, computed

    def search_block(self, queries: np.ndarray, length: float, k: int, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(place of the query, score, id) of the k best of each query, best first, ties to smaller ids, and how many distances were computed.

        In every round a query goes on to the next of its leaves in the order of their bounds, as long as these
        lie within its k-th best distance; rows of the id in ``skips`` do not count.
        """
        slack = SLACK * (1.0 + float(np.sqrt(length * queries.shape[1])))
        base = (queries.astype(np.float64) ** 2).sum(1) + length  # distance^2 = base - 2 * score
        bound, computed = self._bounds(queries, length, slack)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        if self.whole is None or self.whole.dtype != whole(length):
            self.whole = self.vectors.astype(whole(length))
        asked = queries.astype(self.whole.dtype)
        _, _, first, end = self.levels[0]
        q, s, i = (np.empty(0, np.int64) for _ in range(3))  # the best so far, in order
        floor, limit = np.full(len(queries), LEAST), np.full(len(queries), np.inf)
        at, take = 0, FIRST_LEAVES
        while at < order.shape[1]:
            who, leaf = np.nonzero(bound[:, at : at + take] <= limit[:, None])
            if not len(who):
                break  # all further leaves lie farther
            leaf = order[who, at + leaf]
            near = np.argsort(leaf, kind="stable")
            who, leaf = who[near], leaf[near]
            cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            found = [(q, s, i)]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaf)], strict=True):
                rows, some = slice(first[leaf[a]], end[leaf[a]]), who[a:b]
                scores = asked[some] @ self.whole[rows].T
                computed += scores.size
                x, y = np.nonzero(scores >= floor[some, None].astype(scores.dtype))
                other = self.ids[rows][y] != skips[some[x]]
                x, y = x[other], y[other]
                found.append((some[x], scores[x, y].astype(np.int64), self.ids[rows][y]))
            q, s, i = (np.concatenate(c) for c in zip(*found, strict=True))
            ranked = np.lexsort((i, -s, q))
            q, s, i = q[ranked], s[ranked], i[ranked]
            place = place_in_run(np.r_[True, q[1:] != q[:-1]][: len(q)])
            floor[q[place == k - 1]] = s[place == k - 1]
            q, s, i = (c[place < k] for c in (q, s, i))
            full = floor > LEAST
            limit[full] = np.sqrt(np.maximum(base[full] - 2.0 * floor[full], 0.0)) + slack
            at, take = at + take, take * MORE_LEAVES
        return q, s, i, computed


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, *more: Column) -> DataFrame:
    """``id, v`` (and ``more``): components floor(scale * x), of rows without null or non-finite ones."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c.cast("double")))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), *more)


def _pack(kind: str):
    """Groups of rows as one row of bytes: number, ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            v = table.column("v").combine_chunks()
            data = v.values.to_numpy().astype("<i8").tobytes()
            ids = table.column("id").to_numpy().astype("<i8").tobytes()
            head = struct.pack("<qq", table.num_rows, len(v.values) // table.num_rows)
            yield pa.RecordBatch.from_arrays([table.column("part")[:1].combine_chunks(), pa.array([head + ids + data], pa.binary())], names=["part", kind])

        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
            for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
                if held and held[-1].column("part")[-1].as_py() != part[a]:
                    yield from flush()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dim = struct.unpack_from("<qq", data)
    ids = np.frombuffer(data, "<i8", n, 16)
    return ids, np.frombuffer(data, "<i8", n * dim, 16 + 8 * n).reshape(n, dim)


def top_k(spark: SparkSession, rows: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", page_rows: int = PAGE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every id divisible by ``query_every`` the k best other rows.

    Score is the inner product of the integer vectors; ties go to the smaller id. Vectors that are null,
    empty or hold a null or non-finite component take no part, and vectors only meet vectors of the same
    length. Rows that repeat an id are candidates each, but never for a query of that id. The work is
    pages times blocks of queries, one pair at a time in a task, so no side is broadcast or collected.
    """
    space = Workspace(spark, "topk")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = space.keep(integer_vectors(rows, id_col, vector_col, scale).withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)), "vectors")
    result = "query_id long, rank int, vec_id long, score long"
    dims = {r["dim"]: (r["n"], r["q"], r["length"]) for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q"), F.max("norm").alias("length")).collect()}
    found = None
    for dim, (n, n_queries, length) in sorted(dims.items()):
        if not n_queries:
            continue
        pages, blocks = -(-n // page_rows), -(-n_queries // block_queries)
        part = vectors.where(F.col("dim") == dim)
        packed = "part int, {0} binary"

        def dealt(some: DataFrame, count: int, kind: str) -> DataFrame:
            some = some.withColumn("part", F.expr(f"cast(pmod(xxhash64(id, {1 if kind == 'page' else 2}), {count}) as int)"))
            return space.keep(some.repartition(max(1, min(parts, count)), "part").sortWithinPartitions("part", "id").select("part", "id", "v").mapInArrow(_pack(kind), packed.format(kind)), f"{kind}{dim}")

        page = dealt(part, pages, "page")
        block = dealt(part.where(F.col("id") % query_every == 0), blocks, "block").drop("part")
        # Every block meets every page: an equi-join on the page number.
        # Blocks travel to the pages, which are moved once; a block is a small part of a page.
        asked = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
        tasks = max(1, min(4 * parts, pages))
        meet = page.repartition(tasks, "part").hint("merge").join(asked.repartition(tasks, "part"), "part")
        found_here = meet.select("part", "page", "block").mapInArrow(_search(k, float(length)), "query_id long, vec_id long, score long")
        found = found_here if found is None else found.unionByName(found_here)
    if found is None:
        return spark.createDataFrame([], result)
    # Of the k best of every page, the k best; each task drops what it can before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(k: int, length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        known, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column("part")[row].as_py()
                if part != known:
                    ids, vectors = _unpack(batch.column("page")[row].as_py())
                    norms = (vectors * vectors).sum(1)
                    known, tree = part, MTree(ids, vectors, np.sqrt(np.maximum(length - norms, 0.0)))
                asked, queries = _unpack(batch.column("block")[row].as_py())
                who, scores, found, _ = tree.search_block(queries, length, k, asked)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[who]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run
