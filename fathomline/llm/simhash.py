"""Near-duplicate documents by SimHash.

A fingerprint's 64 bits fall into short segments whose bit counts are a point of a grid. Changing a bit
moves the point by one step, so the Manhattan distance of two points never exceeds the Hamming distance
of their fingerprints. The segments are dealt into GROUPS groups: points within a distance of k agree
on all but k groups, so pairs are sought among fingerprints whose counts agree on GROUPS - k groups,
compared by Manhattan distance, then bit by bit. Only a spanning forest of each cell's links is kept.

A second, optional set of fingerprints (views) covers a few sampled shingles each instead of the whole
text, and its candidates are verified on the full shingle sets. That finds pairs at a set similarity
that moves a whole-text fingerprint by more bits than any grid join can bridge.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.components import connected
from fathomline.llm.runtime import Workspace, lookup, text_slices

SEGMENT_BITS = 2
GROUPS = 5
#: Rows of a cell handled in one piece; larger cells are cut into pieces that meet pairwise.
CELL_ROWS = 256
#: Sampled-shingle fingerprints of a document, and shingles under each.
VIEWS, VIEW_SHINGLES = 10, 3

_WORDS = regex.compile("[^\x20\x09-\x0d]+")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z lower-cased."""
    if not text:
        return []
    return _WORDS.findall(text.translate(_ASCII_LOWER) if not text.isascii() else text.lower())


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included; of all words if they are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) > size:
        runs = map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    else:
        runs = [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(r.encode("utf-8", "surrogatepass"), 42) for r in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[i : i + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def view_fingerprints(hashes: np.ndarray, views: int, shingles: int) -> list[int]:
    """Fingerprints of the ``shingles`` smallest distinct hashes under each of ``views`` orders."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return []
    out = []
    for v in range(views):
        order = _mix(distinct, v + 1)
        k = min(shingles, len(order))
        low = np.argpartition(order, k - 1)[:k] if k < len(order) else np.arange(len(order))
        out.append(majority(_mix(distinct[low], 1000 + v)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the segments of each fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), -1, SEGMENT_BITS).sum(2, dtype=np.uint8)


def cell_keys(points: np.ndarray, distance: int, groups: int = GROUPS) -> np.ndarray:
    """A key for each choice of groups whose counts must agree: (rows, choices)."""
    if groups <= distance:
        raise ValueError("groups must outnumber the distance")
    parts = np.array_split(np.arange(points.shape[1]), groups)
    base = 1 + SEGMENT_BITS
    with np.errstate(over="ignore"):
        sums = [(points[:, p].astype(np.uint64) * (np.uint64(base) ** np.arange(len(p), dtype=np.uint64))).sum(1, dtype=np.uint64) for p in parts]
        out = []
        for n, choice in enumerate(itertools.combinations(range(groups), groups - distance)):
            key = np.full(len(points), n + 1, np.uint64)
            for g in choice:
                key = _mix(key ^ sums[g], g + 1)
            out.append(key)
    return np.stack(out, 1).view(np.int64)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among 0..n-1; ``near(i, js)`` tells which js i links to."""
    left, out = np.arange(n), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                out += [(int(i), int(j)) for j in found]
                stack.extend(found)
                left = left[~hit]
    return out


def cells(space: Workspace, rows: DataFrame, name: str, most: int = CELL_ROWS) -> DataFrame:
    """Rows ``cell, node, ...`` of the keys of ``key, node, ...`` that occur more than once: rows of a cell may pair.

    A cell's rows stand together in one task, by node. Rows travel once, to where those of their key are
    counted, and a key with up to ``most`` rows is a cell that stays there. Only the rows of a larger one
    travel again: it is cut by a hash of the node into pieces of about half of that, and every two pieces
    make a cell, so all its pairs still meet.
    """
    parts = max(1, int(space.spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in rows.columns if c != "key"]
    rows = space.keep(rows, f"{name}-rows")
    alike = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    often = rows.withColumn("n", F.count(F.lit(1)).over(alike)).where("n > 1")
    small = often.where(F.col("n") <= most).sortWithinPartitions("key", "node")
    large = often.where(F.col("n") > most).withColumn("pieces", F.ceil(F.col("n") * 2 / most).cast("int"))
    large = large.withColumn("piece", F.expr("cast(pmod(xxhash64(node), pieces) as int)"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    large = large.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("cell"), *others)
    return small.select(F.col("key").alias("cell"), *others).unionByName(large.repartition(parts, "cell").sortWithinPartitions("cell", "node"))


def _by_cell(link: Callable[[pa.Table], list[tuple[int, int]]], limit: int = 64_000_000):
    """Runs ``link`` on the rows of each cell of sorted batches; yields edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = link(table)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            if held and held[-1].column("cell")[-1].as_py() != cell[0]:
                yield from flush(pa.Table.from_batches(held))
                held = []
            if len(starts) == 1:
                held.append(batch)
                continue
            held.append(batch.slice(0, starts[1]))
            yield from flush(pa.Table.from_batches(held))
            held = [batch.slice(int(starts[-1]))]
            if len(starts) > 2:
                yield from flush(pa.Table.from_batches([batch.slice(int(starts[1]), int(starts[-1] - starts[1]))]))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cell = table.column("cell").to_numpy()
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return starts, np.r_[starts[1:], len(cell)]


def _link_fingerprints(distance: int):
    def link(table: pa.Table) -> list[tuple[int, int]]:
        fps = table.column("fp").to_numpy().view(np.uint64)
        nodes = table.column("node").to_numpy()
        points = popcounts(fps).astype(np.int8)
        edges: list[tuple[int, int]] = []
        starts, stops = _runs(table)
        size = stops - starts
        two = starts[size == 2]  # most cells hold a pair
        low = np.abs(points[two] - points[two + 1]).sum(1) <= distance
        two = two[low]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        edges += zip(nodes[two].tolist(), nodes[two + 1].tolist(), strict=True)
        for a, b in zip(starts[size > 2].tolist(), stops[size > 2].tolist(), strict=True):

            def near(i: int, js: np.ndarray, a: int = a) -> np.ndarray:
                hit = np.abs(points[a + js] - points[a + i]).sum(1) <= distance
                hit[hit] = np.bitwise_count(fps[a + js[hit]] ^ fps[a + i]) <= distance
                return hit

            edges += [(int(nodes[a + i]), int(nodes[a + j])) for i, j in forest(b - a, near)]
        return edges

    return link


def _link_shingles(similarity: float):
    def link(table: pa.Table) -> list[tuple[int, int]]:
        nodes = table.column("node").to_numpy()
        column = table.column("shingles").combine_chunks()
        flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        edges: list[tuple[int, int]] = []
        for a, b in zip(*_runs(table), strict=True):
            if b - a < 2:
                continue
            sizes = np.diff(offsets[a : b + 1])
            values, ids = np.unique(flat[offsets[a] : offsets[b]], return_inverse=True)
            at = offsets[a : b + 1] - offsets[a]

            def near(i: int, js: np.ndarray, ids=ids, at=at, sizes=sizes, n=len(values)) -> np.ndarray:
                close = np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i])
                hit = np.zeros(len(js), bool)
                if close.any():
                    mine = np.zeros(n + 1, np.int64)
                    mine[ids[at[i] : at[i + 1]]] = 1
                    for k in np.flatnonzero(close):
                        j = js[k]
                        both = int(mine[ids[at[j] : at[j + 1]]].sum())
                        hit[k] = both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9
                return hit

            edges += [(int(nodes[a + i]), int(nodes[a + j])) for i, j in forest(int(b - a), near)]
        return edges

    return link


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str, views: int = 0) -> DataFrame:
    """``id, fp`` of every row; with ``views`` of the set of shingles, without repeats, and also ``same`` (digest of the set) and ``views``. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            fps, same, seen = [], [], []
            for _, texts in text_slices(batch, "text"):
                for text in texts:
                    hashes = shingle_hashes(text, shingle)
                    fps.append(_signed(majority(np.unique(hashes) if views else hashes)))
                    if views:
                        same.append(xxhash.xxh3_128_digest(np.unique(hashes).tobytes()))
                        seen.append([_signed(x) for x in view_fingerprints(hashes, views, VIEW_SHINGLES)])
            columns = {"id": batch.column("id"), "fp": pa.array(fps, pa.int64())}
            if views:
                columns |= {"same": pa.array(same, pa.binary()), "views": pa.array(seen, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long" + ", same binary, views array<long>" * bool(views))


def _cell_rows(rows: DataFrame, distance: int) -> DataFrame:
    """``key, node, fp`` for every choice of agreeing groups of each row ``node, fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = batch.column("fp").to_numpy()
                keys = cell_keys(popcounts(fps.view(np.uint64)), distance)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("node").to_numpy(), n)), pa.array(np.repeat(fps, n))], names=["key", "node", "fp"])

    return rows.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def fingerprint_links(space: Workspace, rows: DataFrame, distance: int, name: str) -> DataFrame:
    """Edges ``a, b`` that connect the rows ``node, fp`` (fingerprints distinct) as links within ``distance`` do."""
    dealt = cells(space, _cell_rows(rows, distance), name)
    return dealt.select("cell", "node", "fp").mapInArrow(_by_cell(_link_fingerprints(distance)), "a long, b long")


def duplicates(spark: SparkSession, docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints link at ``distance`` or fewer differing bits; the component is the smallest id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows of the same id share
    the id's place; each row is returned. Rows of a null id link like any other; a component without an id is
    null. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    space = Workspace(spark, "simhash")
    prints = space.keep(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = space.keep(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = fingerprint_links(space, distinct.select(F.col("fp").alias("node"), "fp"), distance, "whole")
    # An id repeated with other texts ties its fingerprints together.
    again = space.keep(prints.groupBy("id").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last and id is not null").select("id", "first"), "again")
    tied = lookup(prints, again, ["id"]).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    reached = space.keep(connected(space, edges.unionByName(tied)).select(F.col("node").alias("fp"), "component"), "reached")
    of_fp = space.keep(lookup(distinct, reached, ["fp"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "of_fp")
    many = space.keep(of_fp.join(reached.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    groups = space.keep(lookup(of_fp, many, ["component"], "left").select("fp", F.coalesce("smallest", "least").alias("component_id")), "groups")
    space.drop("whole-rows", "distinct", "again", "reached", "of_fp", "smallest")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return lookup(prints, groups, ["fp"]).select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def _link_candidates(distance: int):
    """Links of a cell to be verified: within ``distance`` in a grid cell; all in a view's, each to the first."""

    def link(table: pa.Table) -> list[tuple[int, int]]:
        fps, nodes = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        viewed = table.column("viewed").to_numpy(zero_copy_only=False)
        edges: list[tuple[int, int]] = []
        for a, b in zip(*(x.tolist() for x in _runs(table)), strict=True):
            if b - a < 2:
                continue
            if viewed[a]:
                edges += [(int(nodes[a]), int(n)) for n in nodes[a + 1 : b]]
            else:
                edges += [(int(nodes[a + i]), int(nodes[a + j])) for i, j in forest(b - a, lambda i, js, a=a: np.bitwise_count(fps[a + js] ^ fps[a + i]) <= distance)]
        return edges

    return link


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", 1_000_000):
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
                kept = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("cluster"), kept.column("n"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "cluster", "n", "shingles"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 3, views: int = VIEWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of the ids that have a near duplicate, themselves included.

    Ids link at a similarity (Jaccard, sets of word shingles) of at least ``similarity``; the component is
    the smallest id reachable. Candidates are within ``distance`` bits in the fingerprint of the set of
    shingles, or agree in one of the ``views``; their groups are verified on the full shingle sets. The
    fingerprint leaves out repeats, as the similarity does. At similarity 0.8 a view of 3 shingles brings a
    pair together with probability 0.51, ten views with over 0.999. Null and blank texts are one group.
    Null ids take no part; rows that share an id are taken as one. An empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    space = Workspace(spark, "near")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = space.keep(fingerprints(docs, shingle, "id", "text", views), "prints")
    # Texts with the same set of shingles need no verification; one stands for all.
    classes = space.keep(prints.groupBy("same").agg(F.min(F.struct("id", "fp", "views")).alias("x"), F.count(F.lit(1)).alias("n")), "classes")
    copies = space.keep(classes.where("n > 1").select("same", F.col("x.id").alias("node")), "copies")
    members = space.keep(lookup(prints.select("same", "id"), copies, ["same"]).select("id", "node").distinct(), "members")
    nodes = classes.select("x.id", "x.fp", "x.views").withColumnRenamed("id", "node")
    whole = _cell_rows(nodes, distance).withColumn("viewed", F.lit(False))
    viewed = nodes.select("node", "fp", F.posexplode("views").alias("v", "x")).select(F.xxhash64(F.lit("view"), "v", "x").alias("key"), "node", "fp", F.lit(True).alias("viewed"))
    dealt = cells(space, whole.unionByName(viewed), "seek")
    sought = dealt.select("cell", "node", "fp", "viewed").mapInArrow(_by_cell(_link_candidates(distance)), "a long, b long")
    clusters = space.keep(connected(space, sought), "clusters")
    sizes = space.keep(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sized = space.keep(lookup(clusters, sizes, ["component"]).select("node", F.col("component").alias("cluster"), "n"), "sized")
    texts = lookup(docs.withColumnRenamed("id", "node"), sized, ["node"]).select("node", "cluster", "n", "text")
    sets = texts.mapInArrow(_shingle_sets(shingle), "node long, cluster long, n long, shingles array<long>")
    edges = space.keep(_verified(sets, similarity, parts), "verified")
    groups = space.keep(connected(space, edges), "groups")
    firsts = members.where("id <> node").join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("id", F.coalesce("component", "node").alias("component"))
    alone = copies.select("node").distinct().join(groups, "node", "left_anti").select(F.col("node").alias("id"), F.col("node").alias("component"))
    return groups.select(F.col("node").alias(id_col), F.col("component").alias("component_id")).unionByName(firsts.unionByName(alone).toDF(id_col, "component_id")).distinct()


def _verified(sets: DataFrame, similarity: float, parts: int, most: int = 160) -> DataFrame:
    """Edges of a spanning forest of the links in each cluster; clusters over ``most`` rows meet in pieces."""
    rows = sets.withColumn("pieces", F.when(F.col("n") > most, F.ceil(F.col("n") * 2 / most)).otherwise(1).cast("int"))
    rows = rows.withColumn("piece", F.expr("cast(pmod(xxhash64(node), pieces) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("cluster", F.least("piece", "other"), F.greatest("piece", "other")))
    return rows.select("cell", "node", "shingles").repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(_by_cell(_link_shingles(similarity)), "a long, b long")
