"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

One more coordinate brings all vectors to the same length, which makes a larger inner product a smaller
Euclidean distance. A table hashes a point by ``k`` Gaussian projections cut into cells of equal width. A
query visits the bucket it falls into and then, in the order of their estimated success, buckets with
some cells shifted by one: the estimate is the probability that a neighbour at the usual distance, whose
projections deviate normally, falls there. What the tables bring together is ranked by the exact measure.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.runtime import Workspace

#: Rows of a page, queries of a block, hash tables, and cell width in units of the common length.
PAGE_ROWS, BLOCK_QUERIES, TABLES, WIDTH = 2048, 256, 3, 2.5
#: Bits that one hash function tells at that width, and rows a bucket should hold on average.
BITS, BUCKET_ROWS = 1.13, 4
#: Queries compared with all rows to set the number of probes, and the share of their neighbours to be found.
SAMPLE_QUERIES, TARGET = 64, 0.96
#: Where the normal distribution is tabulated.
_GRID = np.linspace(-8.0, 8.0, 4001)
_NORMAL = np.array([0.5 * (1 + math.erf(g / math.sqrt(2))) for g in _GRID])


@dataclass
class Family:
    """The hash functions of all tables: projections (table, dim + 1, k), offsets, multipliers that mix cells."""

    length: float
    k: int
    group: int
    tables: int
    seed: int
    dim: int

    def __post_init__(self):
        rng = np.random.default_rng([self.seed, self.dim, self.k, self.tables])
        self.directions = rng.normal(size=(self.tables, self.dim + 1, self.k))
        self.width = WIDTH * self.length
        self.offsets = rng.uniform(0, self.width, (self.tables, self.k))
        self.mix = rng.integers(1, 1 << 62, (self.tables, self.k), dtype=np.int64) * 2 + 1

    def points(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with their last coordinate; queries are stretched to the common length instead."""
        norm = np.sqrt((vectors * vectors).sum(1))
        if query:
            return np.concatenate([vectors * (self.length / norm)[:, None], np.zeros((len(vectors), 1))], 1)
        return np.concatenate([vectors, np.sqrt(np.maximum(self.length**2 - norm**2, 0.0))[:, None]], 1)

    def places(self, points: np.ndarray, table: int) -> np.ndarray:
        """Projections in units of the cell width."""
        return (points @ self.directions[table] + self.offsets[table]) / self.width

    def codes(self, cells: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, group of buckets) of rows of cells; a group shares its first cells."""
        with np.errstate(over="ignore"):
            mixed = cells.astype(np.int64) * self.mix[table]
            return mixed.sum(1), mixed[:, : self.group].sum(1)

    def paths(self, points: np.ndarray, table: int, count: int, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paths, their scores, cells) of the ``count`` likeliest buckets of each query, in no order.

        A path holds a digit for each cell, the first cell's first: 0, 1 or 2 where the cell is one lower, the
        query's own or one higher. The best sums over all cells extend best sums over fewer cells, so a beam
        of ``count`` finds them.
        """
        at = self.places(points, table)
        cell = np.floor(at)
        low = (cell - at)[:, :, None] + np.array([-1, 0, 1])  # distance to the lower end of each of three cells
        scale = self.width / sigma
        chance = np.interp((low + 1) * scale, _GRID, _NORMAL) - np.interp(low * scale, _GRID, _NORMAL)
        chance = np.log(np.maximum(chance, 1e-12))
        path, cost = np.zeros((1, 1), np.int64), np.zeros((len(points), 1))  # the same paths for all queries until a beam is full
        for j in range(self.k):
            cost = (cost[:, :, None] - chance[:, j, None, :]).reshape(len(points), -1)
            if cost.shape[1] <= count:
                path = (path[:, :, None] * 3 + np.arange(3)).reshape(1, -1)
            else:
                best = np.argpartition(cost, count - 1, axis=1)[:, :count]
                path = np.take_along_axis(np.broadcast_to(path, (len(points), path.shape[1])), best // 3, 1) * 3 + best % 3
                cost = np.take_along_axis(cost, best, 1)
        return np.broadcast_to(path, cost.shape), -cost, cell

    def steps(self, paths: np.ndarray, table: int, first: int, last: int) -> np.ndarray:
        """How far paths over the cells from ``first`` up to ``last`` lead from a query's own bucket."""
        out = np.zeros(paths.shape, np.int64)
        with np.errstate(over="ignore"):
            for j in range(last - 1, first - 1, -1):
                paths, digit = np.divmod(paths, 3)
                out += (digit - 1) * self.mix[table, j]
        return out

    def probes(self, points: np.ndarray, table: int, count: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, groups) of the ``count`` likeliest buckets of each query, likeliest first."""
        paths, score, cell = self.paths(points, table, count, sigma)
        bucket, group = self.codes(cell, table)
        paths = np.take_along_axis(paths, np.argsort(-score, axis=1, kind="stable"), 1)
        return bucket[:, None] + self.steps(paths, table, 0, self.k), group[:, None] + self.steps(paths // 3 ** (self.k - self.group), table, 0, self.group)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, dim``: vectors as doubles, without null, zero or non-finite ones."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c.cast("double")))
    out = rows.where(fine & F.exists(x, lambda c: c != 0))
    return out.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"), F.size(x).alias("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all hold ``dim`` doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, so that equal vectors score equally wherever they stand."""
    return (vectors * query).sum(1)


def packed(kind: str, keys: list[str], most: int):
    """Runs of sorted rows with equal ``keys`` as rows of bytes, at most ``most`` rows each.

    A row of bytes holds the other columns as an Arrow stream.
    """

    def pack(table: pa.Table) -> bytes:
        table, sink = table.drop_columns(keys).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size = None, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([*(table.column(c)[:1].combine_chunks() for c in keys), pa.array([pack(table)], pa.binary())], names=[*keys, kind])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(c[a] for c in cols)
                if held and now != key:
                    yield flush()
                    held, size = [], 0
                key = now
                while a < b:
                    take = min(b - a, most - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == most:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def unpack(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(ids, vectors as doubles, all columns) of a row of bytes."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy(), v.reshape(table.num_rows, -1).astype(np.float64), table


FOUND = "query_id long, ids array<long>, scores array<double>"


#: Pairs of a query and a row that are scored at once.
PAIRS = 65_536


class Best:
    """The k best of each query seen by a task, a line of the tables for each query."""

    def __init__(self, k: int):
        self.k, self.lines = k, {}
        self.queries = np.empty(0, np.int64)
        self.ids, self.scores = np.empty((0, k), np.int64), np.empty((0, k))

    def of(self, queries: np.ndarray) -> np.ndarray:
        """Lines of the queries; unseen ones get a new line, free places score minus infinity."""
        fresh = [q for q in queries.tolist() if q not in self.lines]
        if fresh:
            fresh = list(dict.fromkeys(fresh))
            self.lines.update((q, len(self.queries) + i) for i, q in enumerate(fresh))
            self.queries = np.concatenate([self.queries, np.array(fresh, np.int64)])
            self.ids = np.concatenate([self.ids, np.zeros((len(fresh), self.k), np.int64)])
            self.scores = np.concatenate([self.scores, np.full((len(fresh), self.k), -np.inf)])
        return np.array([self.lines[q] for q in queries.tolist()], np.int64)

    def floors(self, lines: np.ndarray) -> np.ndarray:
        """What a row must score to be among the best."""
        return self.scores[lines, -1]

    def add(self, lines: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows found, each for the query of its line; a line's equal pairs of id and score count once."""
        some = np.unique(lines)
        held = self.scores[some] > -np.inf
        lines = np.concatenate([lines, np.repeat(some, held.sum(1))])
        ids, scores = np.concatenate([ids, self.ids[some][held]]), np.concatenate([scores, self.scores[some][held]])
        order = np.lexsort((ids, -scores, lines))
        lines, ids, scores = lines[order], ids[order], scores[order]
        fresh = np.r_[True, (lines[1:] != lines[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])]
        lines, ids, scores = lines[fresh], ids[fresh], scores[fresh]
        firsts = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
        place = np.arange(len(lines)) - np.repeat(firsts, np.diff(np.r_[firsts, len(lines)]))
        top = place < self.k
        self.ids[lines[top], place[top]], self.scores[lines[top], place[top]] = ids[top], scores[top]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.queries), 4096):
            ids, scores = self.ids[i : i + 4096], self.scores[i : i + 4096]
            held = scores > -np.inf
            ends = pa.array(np.r_[0, np.cumsum(held.sum(1))].astype(np.int32))
            found = pa.RecordBatch.from_arrays([pa.array(self.queries[i : i + 4096]), pa.ListArray.from_arrays(ends, pa.array(ids[held])), pa.ListArray.from_arrays(ends, pa.array(scores[held]))], names=["query_id", "ids", "scores"])
            yield found.filter(pa.array(held.any(1)))


def _visit(k: int, hashed: bool, family: Family | None = None):
    """Pages joined to blocks of queries: the best of what the probes (or, unhashed, all rows) bring.

    Probes are buckets, or, with the ``family`` given, paths over a group's further cells from the bucket ``code``.

    One product of block and page tells which rows can still be among a query's best; of these, rows in
    the buckets it probes get their exact score. A block's queries are worked on together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        top, known, ends = Best(k), None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("page")[row].as_buffer()
                if known is None or data != known:
                    ids, vectors, page = unpack(data)
                    known, length, once = data, float(np.sqrt((vectors * vectors).sum(1).max())), len(np.unique(ids)) == len(ids)
                    if hashed:
                        codes = page.column("code").to_numpy()
                        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                        buckets, bucket = codes[firsts], np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(codes)]))
                        order = np.argsort(buckets, kind="stable")
                asked, points, block = unpack(batch.column("block")[row].as_buffer())
                lines = top.of(asked)
                rough = points @ vectors.T
                slack = 1e-9 * length * np.sqrt((points * points).sum(1))
                fine = rough >= (top.floors(lines) - slack)[:, None]
                if hashed:
                    # Which bucket of the page each query probes; a bucket that stands twice has its rows in both places.
                    probes = block.column("probes").combine_chunks()
                    who, probe = np.repeat(np.arange(len(asked)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy(zero_copy_only=False)
                    if family is not None:
                        tab = batch.column("tab")[row].as_py()
                        if tab not in ends:
                            ends[tab] = family.steps(np.arange(3 ** (family.k - family.group)), tab, family.group, family.k)
                        probe = block.column("code").to_numpy()[who] + ends[tab][probe]
                    low, high = np.searchsorted(buckets, probe, "left", order), np.searchsorted(buckets, probe, "right", order)
                    hit = np.zeros((len(asked), len(buckets)), bool)
                    while len(who):
                        there = low < high
                        who, low, high = who[there], low[there], high[there]
                        hit[who, order[low]] = True
                        low = low + 1
                    fine &= hit[:, bucket]
                q, r = np.nonzero(fine)
                if len(q) > 2 * k * len(asked) and once and len(ids) > k + 1:  # more than can count, as no id repeats (a query's own row may be one of them)
                    near = np.where(fine, rough, -np.inf)
                    least = np.partition(near, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                    q, r = np.nonzero(fine & (near >= (least - 2 * slack)[:, None]))
                other = ids[r] != asked[q]
                q, r = q[other], r[other]
                for i in range(0, len(q), PAIRS):
                    a, b = q[i : i + PAIRS], r[i : i + PAIRS]
                    top.add(lines[a], ids[b], exact_scores(vectors[b], points[a]))
        yield from top.rows()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the tasks' findings; each holds at most k a query."""
    pairs = F.flatten(F.collect_list(F.arrays_zip("ids", "scores")))
    ordered = F.array_sort(F.transform(F.array_distinct(pairs), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("i"))))
    top = found.groupBy("query_id").agg(F.slice(ordered, 1, k).alias("top"))
    out = top.select("query_id", F.posexplode("top").alias("n", "p"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), F.col("p.i").alias("vec_id"), (-F.col("p.s")).alias("score"))


def exhaustive(space: Workspace, rows: DataFrame, queries: DataFrame, k: int, n: int, n_queries: int, name: str) -> DataFrame:
    """The k best of all ``rows`` (``id, v``) for each query: blocks of queries meet every page once."""
    parts = max(1, int(space.spark.conf.get("spark.sql.shuffle.partitions")))
    pages, blocks = -(-n // PAGE_ROWS), -(-n_queries // BLOCK_QUERIES)

    def dealt(some: DataFrame, count: int, kind: str, most: int) -> DataFrame:
        some = some.select(F.expr(f"cast(pmod(xxhash64(id, {most}), {count}) as int)").alias("part"), "id", "v")
        return some.repartition(min(parts, count), "part").sortWithinPartitions("part", "id").mapInArrow(packed(kind, ["part"], most), f"part int, {kind} binary")

    page = dealt(rows, pages, "page", PAGE_ROWS)
    block = space.keep(dealt(queries, blocks, "block", BLOCK_QUERIES).drop("part"), f"{name}_blocks")
    asked = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    return page.hint("merge").join(asked, "part").select("page", "block").mapInArrow(_visit(k, False), FOUND)


def _hashed(family: Family):
    """``table, grp, code, id, v`` of every row in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), family.dim).astype(np.float64)
            points = family.points(v)
            for t in range(family.tables):
                code, group = family.codes(np.floor(family.places(points, t)), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(group), pa.array(code), batch.column("id"), batch.column("v")], names=["tab", "grp", "code", "id", "v"])

    return run


def _asking(family: Family, probes: int, sigma: float):
    """A row for each (query, table, group of buckets) to visit: a bucket of the group and paths from there to those to visit."""
    rest = 3 ** (family.k - family.group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                v, ids = matrix(part.column("v"), family.dim).astype(np.float64), part.column("id")
                points = family.points(v, query=True)
                for t in range(family.tables):
                    paths, _, cell = family.paths(points, t, probes, sigma)
                    bucket, group = family.codes(cell, t)
                    # Sorted, the paths of a query that lead to one group stand together.
                    head, tail = np.divmod(np.sort(paths, axis=1), rest)
                    firsts = np.flatnonzero(np.concatenate([np.ones((len(v), 1), bool), head[:, 1:] != head[:, :-1]], 1))
                    who, step = firsts // head.shape[1], family.steps(head.reshape(-1)[firsts], t, 0, family.group)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[firsts, head.size].astype(np.int32)), pa.array(tail.reshape(-1).astype(np.int16)))
                    columns = {"tab": pa.array(np.full(len(who), t, np.int32)), "grp": pa.array(group[who] + step), "id": ids.take(pa.array(who)), "v": part.column("v").take(pa.array(who)), "code": pa.array(bucket[who] + step), "probes": lists}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def calibrate(family: Family, sample: dict[int, np.ndarray], near: dict[int, np.ndarray], target: float) -> tuple[int, float] | None:
    """(probes a table, usual distance) with which the sample's neighbours are found, None if none suffices.

    ``sample`` holds query vectors, ``near`` the vectors of their true neighbours.
    """
    queries = [q for q in sample if len(near.get(q, ()))]
    if not queries:
        return 1, family.length
    asked = family.points(np.stack([sample[q] for q in queries]), query=True)
    truth = [family.points(near[q]) for q in queries]
    sigma = float(np.sqrt(np.mean(np.concatenate([((t - a) ** 2).sum(1) for a, t in zip(asked, truth, strict=True)]))))
    sigma = max(sigma, 1e-6 * family.length)
    count, everything = 16, 3**family.k
    while True:
        found = [np.zeros(len(t), bool) for t in truth]
        for t in range(family.tables):
            buckets, _ = family.probes(asked, t, count, sigma)
            for i, points in enumerate(truth):
                found[i] |= np.isin(family.codes(np.floor(family.places(points, t)), t)[0], buckets[i])
        if np.concatenate(found).mean() >= target:
            return count, sigma
        if count >= min(everything, 4096):
            return None
        count = min(int(count * 1.3) + 1, everything)


def nearest(spark: SparkSession, rows: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, target: float = TARGET, sample_queries: int = SAMPLE_QUERIES, seed: int = 13) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every id divisible by ``query_every`` the k nearest rows found.

    Nearness is the inner product, in double precision on the vectors as they are; ties go to the smaller id.
    Null and zero vectors and those with a null or non-finite component take no part, nor do rows without an
    id; vectors meet vectors of their own length only. A query never meets rows of its own id; rows that
    repeat an id and a score count once. An empty table gives no rows, other columns are ignored. All rows
    are indexed. The number of probes is set so that ``sample_queries`` queries, compared with all rows, find
    the share ``target`` of their neighbours. A query that finds fewer than k rows, though there are more,
    is compared with all rows. Buckets of any size are cut into pages of bounded size, which tasks visit
    with blocks of queries, so no task or group holds a large bucket.
    """
    space = Workspace(spark, "nearest")
    vectors = vectors_of(rows, id_col, vector_col)
    if isinstance(rows.select(vector_col).schema[0].dataType.elementType, T.FloatType):
        vectors = vectors.withColumn("v", F.col("v").cast("array<float>"))  # what were floats travel as floats
    vectors = space.keep(vectors, "vectors")
    asks = F.col("id") % query_every == 0
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("q"), F.max(norm).alias("m"), F.count_distinct("id").alias("ids")).collect()  # a row for each vector length
    out = None
    for r in sorted(sizes, key=lambda r: r["dim"]):
        if not r["q"]:
            continue
        part = _nearest(space, vectors.where(F.col("dim") == r["dim"]), asks, r, k, tables, target, sample_queries, seed)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(space: Workspace, rows: DataFrame, asks, size, k: int, tables: int, target: float, sample_queries: int, seed: int) -> DataFrame:
    dim, n = size["dim"], size["n"]
    queries = rows.where(asks)
    # The sample: a bounded number of queries, their exact neighbours, and those rows' vectors.
    sample = queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("id", "v").limit(sample_queries)
    sample = space.keep(sample, f"sample{dim}")
    truth = space.keep(_merged(exhaustive(space, rows, sample, k, n, sample_queries, f"sample{dim}"), k).select("query_id", F.col("vec_id").alias("id")).distinct(), f"truth{dim}")
    near: dict[int, list] = {}
    for x in rows.join(F.broadcast(truth), "id").dropDuplicates(["query_id", "id"]).select("query_id", "v").collect():  # k rows for each query of the sample
        near.setdefault(x["query_id"], []).append(x["v"])
    asked = {x["id"]: np.array(x["v"]) for x in sample.collect()}
    near = {q: np.array(v) for q, v in near.items()}
    length = math.sqrt(size["m"]) * (1 + 1e-12)
    bits = max(0, round(math.log2(max(1.0, n / BUCKET_ROWS)) / BITS))
    while True:
        group = min(bits, max(0, round(math.log2(max(1.0, n / PAGE_ROWS)) / BITS)))
        family = Family(length, bits, group, tables if bits else 1, seed, dim)
        if fitted := calibrate(family, asked, near, target):
            break
        bits = max(0, bits - 1)  # coarser buckets reach everything in the end
    probes, sigma = fitted
    # Groups are dealt without a first pass that would work out all rows twice; large ones are split once their size is known.
    vector = rows.schema["v"].dataType.simpleString()
    index = rows.select("id", "v").mapInArrow(_hashed(family), f"tab int, grp long, code long, id long, v {vector}")
    index = index.hint("rebalance", "tab", "grp").sortWithinPartitions("tab", "grp", "code", "id")
    page = index.mapInArrow(packed("page", ["tab", "grp"], PAGE_ROWS), "tab int, grp long, page binary")
    ask = queries.select("id", "v").mapInArrow(_asking(family, probes, sigma), f"tab int, grp long, id long, v {vector}, code long, probes array<short>")
    ask = ask.hint("rebalance", "tab", "grp").sortWithinPartitions("tab", "grp", "id")
    block = ask.mapInArrow(packed("block", ["tab", "grp"], BLOCK_QUERIES), "tab int, grp long, block binary")
    found = page.hint("merge").join(block, ["tab", "grp"]).select("tab", "page", "block").mapInArrow(_visit(k, True, family), FOUND)
    found = space.keep(_merged(found, k), f"found{dim}")
    # Queries that found fewer rows than there are: compared with all of them.
    ids = queries.select(F.col("id").alias("query_id")).distinct()
    enough = min(k, size["ids"] - 1)
    lacking = ids.join(found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < enough)
    lacking = space.keep(lacking.select(F.col("query_id").alias("id")), f"lacking{dim}")
    count = lacking.count()
    if not count:
        return found
    more = exhaustive(space, rows, queries.join(lacking, "id", "left_semi"), k, n, count, f"more{dim}")
    return found.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_merged(more, k))
