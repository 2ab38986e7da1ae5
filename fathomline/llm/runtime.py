"""Shared plumbing: written intermediates, size-checked joins, Arrow batching."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup side up to which it is sent to every executor.
BROADCAST_ROWS = 50_000
# Whether a query's shuffle files go when it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where the session names none (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        context.setCheckpointDir(found)
    return found


def worker_memory() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_fathomline_worker", {})


def settle_gc() -> None:
    """Free what earlier tasks left, then stop scanning: large caches without cycles make scans costly."""
    gc.collect()
    gc.disable()


class Workspace:
    """Tables written under the shared folder, so that a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back; the lineage ends here, and the write's shuffle files go with it."""
        schema, before = df.schema, self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join to a side whose rows are counted first: broadcast up to BROADCAST_ROWS, else by shuffle.

    Both sides are expected to be written tables, so that the shuffle join stands directly on two
    exchanges and adaptive execution can split a hot key.
    """
    rows = right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """Runs of rows of at most ``limit`` characters together (one row at least): (first row, texts)."""
    start, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        value = text.as_py()
        n = len(value) if value is not None else 0
        if held and size + n > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(value)
        size += n
    if held:
        yield start, held


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    """The batch with columns appended."""
    names = [*batch.schema.names, *more]
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=names)


def _running(columns: list[str]):
    """Appends to sorted rows the running sum of each column within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(columns, 0)
        for batch in batches:
            more = {}
            for c in columns:
                sums = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + carry[c]
                carry[c] = int(sums[-1]) if len(sums) else carry[c]
                more[f"_upto_{c}"] = pa.array(sums, pa.int64())
            yield with_columns(batch, **more)

    return run


def numbered(space: Workspace, df: DataFrame, keys: list[str], name: str, into: str = "row", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 in the order of ``keys``, which should be unique.

    ``sums`` names non-null integer columns and the columns that get their inclusive running sums. Rows
    are dealt by ranges of the keys and written in order; only one count and sum per range goes to the
    driver, so no range has to wait for another and no single task sees all rows.
    """
    spark, sums = space.spark, sums or {}
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    if sums:
        rows = rows.mapInArrow(_running(list(sums)), T.StructType([*rows.schema.fields, *(T.StructField(f"_upto_{c}", T.LongType()) for c in sums)]))
    rows = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
    rows = space.keep(rows, name)
    held = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *(F.max(f"_upto_{c}").alias(c) for c in sums)).collect()
    starts, at = [], [0] * (1 + len(sums))
    for r in sorted(held, key=lambda r: r["_part"]):
        starts.append((r["_part"], *at))
        at = [a + b for a, b in zip(at, [r["n"], *(r[c] for c in sums)], strict=True)]
    table = spark.createDataFrame(starts, "_part int, _start long" + "".join(f", _start_{c} long" for c in sums))  # a row for each range
    out = rows.join(F.broadcast(table), "_part").withColumn(into, F.col("_start") + F.col("_nth"))
    for c, to in sums.items():
        out = out.withColumn(to, F.col(f"_start_{c}") + F.col(f"_upto_{c}"))
    return out.drop("_part", "_nth", "_start", *(f"_start_{c}" for c in sums), *(f"_upto_{c}" for c in sums))
