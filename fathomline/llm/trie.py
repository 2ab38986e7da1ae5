"""A prefix trie of conversations: every distinct start of a sequence of turns is a node.

A turn becomes a 16-byte digest of its role and text, a conversation the bytes of its turns' digests, so
that byte order brings common starts together. Conversations are sorted by ranges of these bytes. A task
sweeps its range once: the longest common prefix with the row before tells which open nodes end, a stack
holds the open ones. Nodes that may go on in the range before or after leave the task unfinished; the
stacks of neighbouring ranges are then stitched, a short list for each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace, lookup

WIDTH = 16  # bytes of a digest
EMPTY = hashlib.sha256(b"").hexdigest()
#: What a task writes: finished nodes (parent known, or the number of an unfinished one), and unfinished ones.
SWEPT = "part int, open int, path binary, size long, conv_id long, depth long, parent_conv_id long, parent_open int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, n_ends long"
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, path, sizes``: a conversation's turns in order as digests, and the UTF-8 bytes of each text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    each = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("t"), digest.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("x"))
    # Structs sort nulls first, as the order of turns wants; turns that tie are ordered by their digests.
    held = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    path = F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["d"])), ""))
    return held.select("conv_id", path.alias("path"), F.transform("x", lambda x: x["n"]).alias("sizes"))


def rebuilt(space: Workspace, convs: DataFrame, block: int, longest: int) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its block.

    The first h turns come from conversation c - c % ``block`` (as many as it has), the rest are its own from
    turn h on; h = crc32(c) % ``longest``.
    """
    convs = space.keep(convs, "convs")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest)).cast("int")
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(path, 1, {WIDTH * longest})").alias("_head"), F.slice("sizes", 1, longest).alias("_head_sizes"))
    heads = space.keep(heads, "heads")
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    both = lookup(own, heads, ["base"], "left")
    path = F.concat(F.coalesce(F.expr(f"substring(_head, 1, {WIDTH} * h)"), F.expr("X''")), F.expr(f"substring(path, {WIDTH} * h + 1, length(path))"))
    none = F.array().cast("array<long>")
    sizes = F.concat(F.coalesce(F.slice("_head_sizes", F.lit(1), F.col("h")), none), F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return both.select("conv_id", path.alias("path"), sizes.alias("sizes"))


class _Node:
    """An open node of the sweep."""

    __slots__ = ("children", "depth", "digest", "ends", "ended", "first", "leaves", "low", "n", "number", "path", "saved", "size", "waiting")

    def __init__(self, depth: int, size: int, number: int = -1, path: bytes | None = None):
        self.depth, self.size, self.number, self.path = depth, size, number, path  # a number marks nodes that may go on
        self.n = self.children = self.leaves = self.saved = self.ended = 0
        self.low, self.digest = None, None
        self.waiting: list[tuple] = []  # finished children, until this node's smallest member is known

    def member(self, conv: int) -> None:
        self.n += 1
        self.low = conv if self.low is None else min(self.low, conv)

    def end(self, conv: int) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256(str(conv).encode())
        else:
            self.digest.update(f",{conv}".encode())
        self.ended += 1


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted rows. Those of the first and the last row's paths may go on in neighbouring ranges."""
    out: list[tuple] = []
    stack: list[_Node] = []
    part, before, numbers = None, b"", 0

    def ready() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in SWEPT.split(", ")])
        out.clear()
        return made

    def finish(node: _Node, parent: _Node | None) -> None:
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        ends = node.digest.hexdigest() if node.digest else EMPTY
        out.extend((part, None, None, None, *w[:2], node.low, None, *w[2:]) for w in node.waiting)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        mine = (node.low, node.depth, node.n, node.children, leaves, saved, ends, node.ended)
        if parent.number < 0:
            parent.waiting.append(mine)
        else:
            out.append((part, None, None, None, node.low, node.depth, None, parent.number, *mine[2:]))

    def leave(node: _Node) -> None:
        """An unfinished node: its own counts and those of its finished children."""
        ends = node.digest.hexdigest() if node.digest else EMPTY
        out.extend((part, None, None, None, *w[:2], None, node.number, *w[2:]) for w in node.waiting)
        out.append((part, node.number, node.path, node.size, node.low, node.depth, None, None, node.n, node.children, node.leaves, node.saved, ends, node.ended))

    for batch in batches:
        convs, paths, sizes = (batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))
        if part is None and batch.num_rows:
            part = batch.column("part")[0].as_py()
        for conv, path, size in zip(convs, paths, sizes, strict=True):
            depth = len(path) // WIDTH
            first = not stack
            if first:
                stack.append(_Node(0, 0, 0, b""))
                numbers, same = 1, 0
            else:
                same, most = 0, min(len(stack) - 1, depth)
                if path[: WIDTH * most] == before[: WIDTH * most]:
                    same = most
                else:
                    while path[WIDTH * same : WIDTH * (same + 1)] == before[WIDTH * same : WIDTH * (same + 1)]:
                        same += 1
            while len(stack) - 1 > same:
                node = stack.pop()
                leave(node) if node.number >= 0 else finish(node, stack[-1])
            for d in range(same, depth):
                stack.append(_Node(d + 1, size[d], numbers if first else -1, path[WIDTH * d : WIDTH * (d + 1)] if first else None))
                numbers += first
            for node in stack:
                node.member(conv)
            stack[-1].end(conv)
            before = path
        if len(out) > 20_000:
            yield ready()
    # The last row's path stays open; its nodes get numbers of their own.
    for d, node in enumerate(stack):
        if node.number < 0:
            node.number, node.path = numbers, before[WIDTH * (d - 1) : WIDTH * d]
            numbers += 1
    for node in reversed(stack):
        leave(node)
    if out:
        yield ready()


def _stitch(opened: list) -> tuple[list[tuple], list[tuple], list[str]]:
    """Unfinished nodes of all ranges: (whole nodes, (range, number, smallest member) of each, those whose ends lie in several ranges).

    A range numbers the nodes on its first row's path from the root on, then what its last row's path adds.
    Nodes go by the hash of their path, which grows with it.
    """
    nodes: dict[str, dict] = {}
    names: list[tuple[int, int, str]] = []
    for part in sorted({r["part"] for r in opened}):
        way: list[tuple[str, object]] = []  # (name, hash so far) by depth, of the path that is being read
        for r in sorted((r for r in opened if r["part"] == part), key=lambda r: r["open"]):
            del way[r["depth"] :]
            grown = way[-1][1].copy() if way else hashlib.sha256()
            grown.update(bytes(r["path"]))
            name = grown.hexdigest()
            above = way[-1][0] if way else None
            way.append((name, grown))
            names.append((part, r["open"], name))
            held = nodes.setdefault(name, {"depth": r["depth"], "size": r["size"], "parent": above, "low": r["conv_id"], "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": EMPTY, "ranges": 0})
            held["low"] = min(held["low"], r["conv_id"])
            for to, c in (("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                held[to] += r[c]
            if r["n_ends"]:
                held["ranges"] += 1
                held["ends"] = r["ends_sha256"] if held["ranges"] == 1 else None  # several ranges: hashed anew
    for held in sorted(nodes.values(), key=lambda x: -x["depth"]):
        held["leaves"] = held["leaves"] if held["children"] else 1
        held["saved"] += (held["n"] - 1) * held["size"]
        if held["parent"] is not None:
            above = nodes[held["parent"]]
            above["children"] += 1
            above["leaves"] += held["leaves"]
            above["saved"] += held["saved"]
    whole = [(name, x["low"], x["depth"], None if x["parent"] is None else nodes[x["parent"]]["low"], x["n"], x["children"], x["leaves"], x["saved"], x["ends"]) for name, x in nodes.items()]
    return whole, [(part, number, nodes[name]["low"]) for part, number, name in names], [name for name, x in nodes.items() if x["ranges"] > 1]


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of equal names; ids arrive in order and are not held."""
    known, digest = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([known]), pa.array([digest.hexdigest()])], names=["name", "hashed"])

    for batch in batches:
        for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if name == known:
                digest.update(f",{conv}".encode())
                continue
            if known is not None:
                yield made()
            known, digest = name, hashlib.sha256(str(conv).encode())
    if known is not None:
        yield made()


def trie(space: Workspace, convs: DataFrame) -> DataFrame:
    """The nodes of ``convs(conv_id, path, sizes)``: NODES, one row each; no rows for an empty table."""
    spark = space.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    convs = space.keep(convs, "rebuilt")
    ordered = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("part", F.spark_partition_id())
    swept = space.keep(ordered.mapInArrow(_sweep, SWEPT), "swept")
    opened = swept.where("open is not null").collect()  # two paths for each range
    whole, lows, cut = _stitch(opened)
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    top = spark.createDataFrame(whole, f"name string, {schema}")
    if cut:
        # Ends of one node in several ranges (a path for each boundary at most): hashed in order of their ids.
        names = spark.createDataFrame([(n,) for n in cut], "name string")
        ends = convs.select(F.sha2("path", 256).alias("name"), "conv_id").join(F.broadcast(names), "name")
        ends = ends.repartition(parts, "name").sortWithinPartitions("name", "conv_id").mapInArrow(_hash_ends, "name string, hashed string")
        top = top.join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "hashed"))
    known = spark.createDataFrame(lows, "part int, parent_open int, _low long")
    rest = swept.where("open is null").join(F.broadcast(known), ["part", "parent_open"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_low"))
    return top.select(*NODES).unionByName(rest.select(*NODES))


def conversation_trie(spark: SparkSession, rows: DataFrame, block: int = 5, longest: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of rebuilt conversations, a row for each node (NODES).

    Turns are ordered by number, null first, ties by the digest of role and text; null roles and texts count as
    empty. Rows without a conversation take no part. ``conv_id`` is a node's smallest member,
    ``parent_conv_id`` its parent's. Repeated rows are turns each. ``block`` and ``longest`` as in ``rebuilt``.
    An empty table has no nodes; other columns are ignored. A conversation is held as 24 bytes a turn.
    """
    space = Workspace(spark, "trie")
    return trie(space, rebuilt(space, turns(rows, conv_col, turn_col, role_col, text_col), block, longest))
