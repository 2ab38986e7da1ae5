"""Hard negatives by score windows: vantage-point trees over norm-augmented integer vectors.

One more coordinate brings all vectors to the same length; an anchor gets zero there. A larger inner
product is then a smaller distance, and a window of scores an annulus around the anchor. A bounded tree of
vantage points, fitted on a sample, routes every row to a leaf; leaves are cut into pages, which keep the
range of their distances to the vantage points on their way. Anchors go only to subtrees that an annulus can
meet. Within a page a second tree is walked by a block of anchors at a time: each goes down to the leaves
that its annuli meet, whose rows are scored by one matrix product, and of the rows within a window the
nearest ones come out. Products are exact: of floats where all sums fit into their whole numbers.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.neighbors import matrix
from fathomline.llm.runtime import Workspace
from fathomline.llm.topk import integer_vectors
from fathomline.llm.topk import whole as _whole

#: Rows of a page, anchors of a block, anchors that walk a page together, rows of a leaf of a page's tree.
PAGE_ROWS, BLOCK_ANCHORS, WALK_ANCHORS, LEAF_ROWS = 4096, 4096, 128, 256
#: Rows sampled for the routing tree, and its leaves at most; further rows make further pages of a leaf.
SAMPLE_ROWS, MOST_LEAVES = 20_000, 1024
#: Subtrees of the routing tree that blocks are sent to, at most, and pages of one that meet a block in one task.
MOST_SHARES, SHARE_PAGES = 64, 64
#: Slack of bounds computed in floating point, in units of the common length.
SLACK = 1e-6
#: Share of the leaves of a page from which all its rows are scored at once.
MOST_MET = 0.5
#: Labels of a page from which rows of the anchor's label are picked after scoring, and times as many anchors that walk together up to that.
MOST_LABELS, MORE_ANCHORS = 64, 8
#: Share of the pairs at or above the lowest bound from which those beyond the highest bound go before they are picked.
MANY_HITS = 0.02


def _augmented(vectors: np.ndarray, length: int) -> np.ndarray:
    """Points of equal length; ``length`` is the largest squared norm."""
    v = vectors.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(length - (vectors * vectors).sum(1), 0).astype(np.float64))[:, None]], 1)


def _asked(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors.astype(np.float64), np.zeros((len(vectors), 1))], 1)


def _away(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of all points to all centers; what rounding adds is within the slack."""
    squares = (points * points).sum(1)[:, None] + (centers * centers).sum(1) - 2.0 * (points @ centers.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _slack(length: int) -> float:
    return SLACK * (1.0 + float(np.sqrt(max(length, 0))))


def _meets(near: np.ndarray, far: np.ndarray, base: np.ndarray, lows: np.ndarray, highs: np.ndarray, length: int) -> np.ndarray:
    """Whether rows between the distances ``near`` and ``far`` (anchor, place) can hold a score of some window of the anchor."""
    slack = _slack(length)
    most = (base[:, None] - np.maximum(near - slack, 0.0) ** 2) / 2 + SLACK * slack
    least = (base[:, None] - (far + slack) ** 2) / 2 - SLACK * slack
    met = np.zeros(near.shape, bool)
    for w in range(lows.shape[1]):
        met |= (lows[:, w, None] <= most) & (highs[:, w, None] >= least)
    return met


def _stored(largest: float) -> type:
    """The smallest kind of number that holds components of vectors up to the largest squared norm."""
    return np.int16 if largest < 2.0**30 else np.int32 if largest < 2.0**62 else np.int64


def _bytes(vectors: np.ndarray, kind: type) -> pa.Array:
    """Vectors as a binary column."""
    data = np.ascontiguousarray(vectors.astype(kind))
    width = data.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _vectors(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """The vectors of a binary column."""
    column = column.cast(pa.binary(dim * np.dtype(kind).itemsize))
    data = np.frombuffer(column.buffers()[1], kind).reshape(-1, dim)
    return data[column.offset : column.offset + len(column)]


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set in a mask with few hits: eight places at a time."""
    flat = mask.reshape(-1)
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    at, place = np.nonzero(flat[:even].reshape(-1, 8)[words])
    found = np.concatenate([words[at] * 8 + place, even + np.flatnonzero(flat[even:])])
    return found // mask.shape[1], found % mask.shape[1]


class Router:
    """A balanced vantage-point tree with at most MOST_LEAVES leaves: where rows go, and which leaves an annulus meets."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, leaves)))), int(np.log2(max(1, min(MOST_LEAVES, len(sample) // 2))))))
        self.points = np.zeros(((1 << self.depth) - 1, sample.shape[1]))
        self.radii = np.zeros((1 << self.depth) - 1)
        parts = {0: sample}
        for node in range(len(self.points)):
            part = parts.pop(node)
            if len(part):
                # A vantage point far from the middle spreads distances best.
                self.points[node] = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
                away = np.sqrt(((part - self.points[node]) ** 2).sum(1))
                self.radii[node] = np.median(away)
                parts[2 * node + 1], parts[2 * node + 2] = part[away <= self.radii[node]], part[away > self.radii[node]]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = part

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances to the vantage points on the way) of each point."""
        at, away = np.zeros(len(points), np.int64), np.zeros((len(points), self.depth))
        for d in range(self.depth):
            away[:, d] = np.sqrt(((points - self.points[at]) ** 2).sum(1))
            at = 2 * at + 1 + (away[:, d] > self.radii[at])
        return at - ((1 << self.depth) - 1), away

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distances of points to every vantage point."""
        return _away(points, self.points)

    def way(self, leaf: int) -> list[int]:
        """Vantage points from the root to a leaf."""
        at, out = leaf + (1 << self.depth) - 1, []
        while at:
            at = (at - 1) // 2
            out.append(at)
        return out[::-1]


class VPTree:
    """A page: rows in the order of a balanced vantage-point tree, whose nodes keep the range of distances to their vantage point."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, length: int, largest: float):
        self.length, points = length, _augmented(vectors.astype(np.int64), length)
        self.nodes: list[tuple] = []  # (vantage point, nearest, farthest)
        self.leaves: list[tuple] = []  # (rows, nodes on the way)
        self._build(points, np.arange(len(ids)), [])
        self.centers, self.near, self.far = (np.array(x) for x in zip(*self.nodes, strict=True))
        depth = max(len(way) for _, way in self.leaves)
        self.ways = np.array([way + way[-1:] * (depth - len(way)) for _, way in self.leaves])
        self.ends = np.cumsum([0, *(len(rows) for rows, _ in self.leaves)])
        rows = np.concatenate([rows for rows, _ in self.leaves])
        self.ids, self.labels, self.vectors = ids[rows], labels[rows], vectors[rows].astype(_whole(largest))
        kinds = np.unique(self.labels)
        self.of_label = {int(x): np.flatnonzero(self.labels == x) for x in kinds} if len(kinds) <= MOST_LABELS else None

    def _build(self, points: np.ndarray, rows: np.ndarray, way: list[int]) -> None:
        at = points[rows]
        # All points are equally far from the origin, so one product gives the distances from a vantage point, or the farthest from the middle.
        center = at[(at @ at.mean(0)).argmin()] if len(rows) > LEAF_ROWS else at.mean(0)
        away = _away(at, center[None, :])[:, 0]
        way = [*way, len(self.nodes)]
        self.nodes.append((center, float(away.min()), float(away.max())))
        if len(rows) <= LEAF_ROWS:
            self.leaves.append((rows, way))
        else:
            near, half = np.argsort(away, kind="stable"), len(rows) // 2
            self._build(points, rows[near[:half]], way)
            self._build(points, rows[near[half:]], way)

    def met(self, vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """(anchor, leaf): whether every node on the way to the leaf can hold a row of some window."""
        d = _away(_asked(vectors), self.centers)
        base = (vectors.astype(np.float64) ** 2).sum(1) + self.length  # distance^2 = base - 2 * score
        node = _meets(np.maximum(d - self.far, self.near - d), d + self.far, base, lows, highs, self.length)
        leaf = node[:, self.ways[:, 0]]
        for k in range(1, self.ways.shape[1]):
            leaf &= node[:, self.ways[:, k]]
        return leaf

    def _products(self, vectors: np.ndarray, labels: np.ndarray, same: bool, met: np.ndarray) -> Iterator[tuple]:
        """(anchors, rows, their scores): every pair of the wanted labels on leaves that are met, and some besides."""
        if met.mean() < MOST_MET:
            for leaf in np.flatnonzero(met.any(0)).tolist():
                who, rows = np.flatnonzero(met[:, leaf]), np.arange(self.ends[leaf], self.ends[leaf + 1])
                yield who, rows, vectors[who] @ self.vectors[rows].T
        elif same and self.of_label is not None:
            for label in np.unique(labels).tolist():
                if (rows := self.of_label.get(label)) is not None:
                    who = np.flatnonzero(labels == label)
                    yield who, rows, vectors[who] @ self.vectors[rows].T
        else:
            yield np.arange(len(vectors)), np.arange(len(self.ids)), vectors @ self.vectors.T

    def walk(self, anchors: np.ndarray, vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray, labels: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(place of the anchor, window, score, id) of the first k rows of each window (lowest, highest score) of each anchor, nearest first.

        Rows of the anchor's own id never count. ``same`` wants the anchor's label, else all others.
        """
        parts = []
        asked, low, high = vectors.astype(self.vectors.dtype), lows.min(1), highs.max(1)
        for who, rows, scores in self._products(asked, labels, same, self.met(vectors, lows, highs)):
            inside = scores >= low[who, None].astype(scores.dtype)
            if np.count_nonzero(inside) > MANY_HITS * inside.size:
                inside &= scores <= high[who, None].astype(scores.dtype)
            i, j = _hits(inside)
            found, a, r = scores[i, j].astype(np.int64), who[i], rows[j]
            fine = ((self.labels[r] == labels[a]) == same) & (self.ids[r] != anchors[a])
            parts.append((a[fine], found[fine], self.ids[r[fine]]))
        a, s, i = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        out = []
        for w in range(lows.shape[1]):
            at = np.flatnonzero((s >= lows[a, w]) & (s <= highs[a, w]))
            at = at[np.arange(len(at)) - np.searchsorted(a[at], a[at]) < k]
            out.append((a[at], np.full(len(at), w, np.int32), s[at], i[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(kind: str, most: int):
    """Runs of sorted rows with equal ``leaf`` as one row with the Arrow bytes of at most ``most`` rows.

    Pages also get their number within the task and the range of their distances to each vantage point on the way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size, made = None, 0, count()

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            arrays, names = [pa.array([key], pa.int64())], ["leaf", kind]
            more = []
            if kind == "page":
                away = table.column("away").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                away = away.reshape(table.num_rows, len(away) // table.num_rows)
                more = [pa.array([next(made)], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (away.min(0), away.max(0)))]
                names += ["nth", "low", "high"]
                table = table.drop_columns(["away"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([sink.getvalue().to_pybytes()], pa.binary()), *more], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column("leaf").to_numpy()
            cuts = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if held and leaf[a] != key:
                    yield flush()
                    held, size = [], 0
                key = int(leaf[a])
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


def _unpack(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _routed(router: Router, length: int, dim: int, largest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), dim)
                leaf, away = router.route(_augmented(v, length))
                away = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * router.depth), pa.array(away.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _bytes(v, _stored(largest)), pa.array(leaf), away], names=["id", "label", "v", "leaf", "away"])

    return run


def _directed(router: Router, length: int, dim: int, pages: dict[int, tuple[np.ndarray, np.ndarray]], only_home: bool, shift: int = 0, largest: float = 2.0**63):
    """Anchors with windows, once for each subtree with a leaf whose distances an annulus can meet (or for their own subtree alone).

    A subtree holds ``1 << shift`` leaves. A row of the result names it as ``leaf``; vectors become bytes.
    """
    subtrees: dict[int, list[int]] = {}
    for leaf in pages:
        subtrees.setdefault(leaf >> shift, []).append(leaf)
    ways = {leaf: np.array(router.way(leaf), np.int64) for leaf in pages}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), dim)
            q = _asked(v)
            if only_home:
                home = router.route(q)[0] >> shift
                home[~np.isin(home, list(subtrees))] = next(iter(subtrees))
                sent = [(np.arange(len(v)), home)]
            else:
                d, base = router.distances(q), (v.astype(np.float64) ** 2).sum(1) + length
                lows, highs = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lows", "highs"))
                # Windows in lines of equal length; a window that holds no score fills them up.
                sizes = batch.column("lows").value_lengths().to_numpy(zero_copy_only=False)
                line, place = np.repeat(np.arange(len(v)), sizes), np.concatenate([np.arange(n) for n in sizes.tolist()])
                low, high = np.full((len(v), sizes.max()), 1 << 62), np.full((len(v), sizes.max()), -(1 << 62))
                low[line, place], high[line, place] = lows, highs
                sent = []
                for subtree, leaves in subtrees.items():
                    hit = np.zeros(len(v), bool)
                    for leaf in leaves:
                        way, (least, most) = d[:, ways[leaf]], pages[leaf]
                        near = np.maximum(way - most, least - way).max(1, initial=0.0)
                        far = (way + most).min(1, initial=np.inf)
                        hit |= _meets(near[:, None], far[:, None], base, low, high, length)[:, 0]
                        if hit.all():
                            break
                    who = np.flatnonzero(hit)
                    sent.append((who, np.full(len(who), subtree)))
            who, where = (np.concatenate(x) for x in zip(*sent, strict=True))
            if len(who):
                part = batch.set_column(batch.schema.get_field_index("v"), "v", _bytes(v, _stored(largest))).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(where, pa.int64())], names=[*part.schema.names, "leaf"])

    return run


def _windows(block: pa.Table, name: str, none: int) -> np.ndarray:
    """Bounds of windows in lines of equal length, filled up with ``none``."""
    lists = block.column(name).combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), sizes.max()), none)
    out[np.arange(sizes.max()) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(length: int, dim: int, same: bool, k: int, largest: float):
    """Walks pages for anchors: a row (anchor number, window, score, id) for each of the first k of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        known, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("page")[row].as_buffer()
                if known is None or data != known:
                    page = _unpack(data)
                    known = data
                    tree = VPTree(page.column("id").to_numpy(), page.column("label").to_numpy(), _vectors(page.column("v").combine_chunks(), dim, _stored(largest)), length, largest)
                block = _unpack(batch.column("block")[row].as_buffer())
                ids, numbers, labels = (block.column(c).to_numpy() for c in ("id", "number", "label"))
                vectors = _vectors(block.column("v").combine_chunks(), dim, _stored(largest))
                lows, highs = _windows(block, "lows", 1 << 62), _windows(block, "highs", -(1 << 62))
                together = WALK_ANCHORS * (MORE_ANCHORS if same and tree.of_label is not None else 1)
                for a in range(0, len(ids), together):
                    at = slice(a, a + together)
                    who, w, s, i = tree.walk(ids[at], vectors[at], lows[at], highs[at], labels[at], same, k)
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[at][who]), pa.array(w), pa.array(s), pa.array(i)], names=["number", "win", "score", "other"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """Of what the pages give, the first k of each window, with their place."""
    order = Window.partitionBy("number", "win").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, rows: DataFrame, positives: int = 5, k: int = 5, anchor_every: int = 100, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ``anchor_every``; their positives the ``positives`` other rows of
    their label with the highest scores, their negatives for a positive of score p the first ``k`` rows of
    other labels with ``low * p <= 100 * score <= high * p``. Higher scores come first, ties by smaller id.
    Rows without an id, label or vector, or with a null or non-finite component, take no part; vectors meet
    vectors of their own length. An anchor never meets rows of its own id; rows that repeat an id are
    candidates each, and a repeated anchor is an anchor each. No positives, or none in a window, give no
    rows; so does an empty table. Other columns are ignored.
    """
    space = Workspace(spark, "negatives")
    given = integer_vectors(rows.where(F.col(label_col).isNotNull()), id_col, vector_col, scale, F.col(label_col).cast("long").alias("label"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    given = space.keep(given.withColumn("dim", F.size("v")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    sizes = given.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % anchor_every == 0).alias("q"), F.max(norm).alias("m"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("largest")).collect()  # a row for each vector length
    out = None
    for size in sorted(sizes, key=lambda r: r["dim"]):
        if size["q"]:
            part = _mine(space, given.where(F.col("dim") == size["dim"]), size, positives, k, anchor_every, low, high)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def _mine(space: Workspace, rows: DataFrame, size, positives: int, k: int, anchor_every: int, low: int, high: int) -> DataFrame:
    spark, dim, n, length, largest = space.spark, size["dim"], size["n"], int(size["m"]), size["largest"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = rows.orderBy(F.xxhash64("id", F.lit(12)), "id").limit(SAMPLE_ROWS).select("v").toPandas()  # a bounded sample
    router = Router(_augmented(np.stack(sample["v"].to_numpy()).astype(np.int64), length), -(-n // PAGE_ROWS))
    routed = rows.select("id", "label", "v").mapInArrow(_routed(router, length, dim, largest), "id long, label long, v binary, leaf long, away array<double>")
    routed = routed.repartitionByRange(parts, "leaf", "id").sortWithinPartitions("leaf", "id")
    page = space.keep(routed.mapInArrow(_pack("page", PAGE_ROWS), "leaf long, page binary, nth long, low array<double>, high array<double>"), f"pages{dim}")
    # What the leaves' pages span: a row for each leaf, of which there are MOST_LEAVES at most.
    spans = page.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *(F.array(*(fn(F.col(c)[d]) for d in range(router.depth))).alias(c) for c, fn in (("low", F.min), ("high", F.max)))).collect()
    spans = sorted(spans, key=lambda r: r["leaf"])
    pages = {r["leaf"]: (np.array(r["low"], float), np.array(r["high"], float)) for r in spans}
    # Blocks go to subtrees rather than to leaves, so that few copies travel; the pages of a large subtree are dealt out.
    shift = max(0, router.depth - int(np.log2(MOST_SHARES)))
    held: dict[int, int] = {}
    for r in spans:
        held[r["leaf"] >> shift] = held.get(r["leaf"] >> shift, 0) + r["n"]
    deals = spark.createDataFrame([(s, -(-c // SHARE_PAGES)) for s, c in held.items()], "leaf long, deals int")  # MOST_SHARES at most
    page = page.select(F.shiftright("leaf", shift).alias("leaf"), "nth", "page").join(F.broadcast(deals), "leaf").select("leaf", F.expr("pmod(nth, deals)").cast("int").alias("deal"), "page")
    page = page.repartition(parts, "leaf", "deal")
    big = 1 << 60

    def visit(anchors: DataFrame, same: bool, most: int, only_home: bool = False) -> DataFrame:
        columns = "number long, id long, label long, v {}, lows array<long>, highs array<long>"
        sent = anchors.select(*(c.split()[0] for c in columns.split(", "))).mapInArrow(_directed(router, length, dim, pages, only_home, shift, largest), columns.format("binary") + ", leaf long")
        block = sent.repartition(parts, "leaf").sortWithinPartitions("leaf", "number").mapInArrow(_pack("block", BLOCK_ANCHORS), "leaf long, block binary")
        block = block.join(F.broadcast(deals), "leaf").select("leaf", F.explode(F.expr("sequence(0, deals - 1)")).alias("deal"), "block").repartition(parts, "leaf", "deal")
        met = page.hint("merge").join(block, ["leaf", "deal"]).select("page", "block")
        return met.mapInArrow(_search(length, dim, same, most, largest), "number long, win int, score long, other long")

    anchors = rows.where(F.col("id") % anchor_every == 0).select("number", "id", "label", "v")
    # Their own leaf first: its last positive bounds the search of the others.
    everything = anchors.withColumn("lows", F.array(F.lit(-big))).withColumn("highs", F.array(F.lit(big)))
    home = _first(visit(everything, True, positives, only_home=True), positives)
    floor = home.groupBy("number").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).otherwise(F.lit(-big)).alias("floor"))
    bounded = anchors.join(floor, "number", "left").withColumn("lows", F.array(F.coalesce("floor", F.lit(-big)))).withColumn("highs", F.array(F.lit(big)))
    bounded = space.keep(bounded.drop("floor"), f"bounded{dim}")
    found = space.keep(_first(visit(bounded, True, positives), positives), f"positives{dim}")
    lists = found.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "other"))).alias("p"))
    # Windows in whole scores: low * p <= 100 * s <= high * p.
    windows = lists.select("number", "p", F.transform("p", lambda x: F.ceil(F.lit(low) * x["score"] / F.lit(100)).cast("long")).alias("lows"), F.transform("p", lambda x: F.floor(F.lit(high) * x["score"] / F.lit(100)).cast("long")).alias("highs"))
    asked = space.keep(anchors.join(windows, "number"), f"windows{dim}")
    negatives = _first(visit(asked, False, k), k)
    pick = F.col("p")[F.col("win")]
    out = negatives.join(asked.select("number", "id", "p"), "number")
    return out.select(F.col("id").alias("anchor_id"), pick["other"].alias("positive_id"), F.col("rank"), F.col("other").alias("negative_id"), pick["score"].alias("positive_score"), F.col("score").alias("negative_score"))
