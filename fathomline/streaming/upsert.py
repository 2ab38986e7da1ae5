"""A price table kept current from a stream of rows, the latest of a key winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.sources.prices import keep_last, upsert


def keep_current(rows: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Upserts every micro-batch into the table at ``path``: written beside it, then exchanged for it.

    Of a key that a batch holds more than once the row with the largest ``order`` stays (by default the last
    in the batch). The old table is put aside until the new one stands in its place, so a crash loses neither.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def merge(batch: DataFrame, number: int) -> None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        aside = jvm.org.apache.hadoop.fs.Path(f"{path}.before")
        if fs.exists(aside):  # an exchange was broken off
            if fs.exists(at):
                fs.delete(aside, True)
            else:
                fs.rename(aside, at)
        numbered = batch.withColumn("_nth", F.monotonically_increasing_id())
        fresh = keep_last(numbered, keys, F.struct(order, "_nth") if order else F.col("_nth")).drop("_nth")
        merged = upsert(spark.read.parquet(path), fresh, keys) if fs.exists(at) else fresh
        beside = jvm.org.apache.hadoop.fs.Path(f"{path}.batch-{number}")
        merged.write.mode("overwrite").parquet(str(beside))
        if fs.exists(at):
            fs.rename(at, aside)
        fs.rename(beside, at)
        fs.delete(aside, True)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
