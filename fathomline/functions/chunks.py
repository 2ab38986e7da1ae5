"""Long series cut into overlapping chunks, so that one series is many tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk, and days whose rows are counted together to number a series.
CHUNK_ROWS, SPAN_DAYS = 4096, 1024


def positions(df: DataFrame, by: str | list[str] = "code", order: str = "date") -> DataFrame:
    """``df`` with ``pos``: row numbers from 1 within each series.

    Rows are numbered within spans of days, and spans start where the counts of those before them end, so
    no task sorts a whole series.
    """
    by = [by] if isinstance(by, str) else by
    span = F.coalesce(F.floor(F.unix_date(F.col(order).cast("date")) / SPAN_DAYS), F.lit(-(1 << 40)))
    rows, keys = df.withColumn("_span", span), [f"_by{i}" for i in range(len(by))]
    counts = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("_span").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(order))
    same = F.col("_span") == F.col("_at")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    rows = rows.withColumn("_nth", nth).join(starts, same)
    return rows.select(*df.columns, (F.col("_start") + F.col("_nth")).cast("int").alias("pos"))


def overlapping(df: DataFrame, halo: int) -> DataFrame:
    """Rows of ``df`` (with ``pos``) once for each ``_chunk`` that holds them or follows within ``halo`` rows."""
    at = F.col("pos") - 1
    return df.withColumn("_chunk", F.explode(F.sequence(F.floor(at / CHUNK_ROWS).cast("int"), F.floor((at + halo) / CHUNK_ROWS).cast("int"))))


def over_chunks(df: DataFrame, halo: int, columns: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outs: dict[str, str], by: str = "code") -> DataFrame:
    """``df`` (with ``pos``) and the columns ``outs`` (name: "double" or "array<double>") that ``fn`` works out.

    ``fn`` gets the ``columns`` of a chunk's rows in order, missing values as NaN, the ``halo`` rows before
    the chunk included; it returns an array (or a matrix, a row for each row) of each name, NaN for null.
    Chunks of a series are separate groups, of CHUNK_ROWS + ``halo`` rows at most.
    """
    size, rows = CHUNK_ROWS, overlapping(df, halo)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType() if kind == "double" else T.ArrayType(T.DoubleType())) for n, kind in outs.items())])
    names = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        own = int(np.searchsorted(table.column("pos").to_numpy(), table.column("_chunk")[0].as_py() * size, side="right"))
        found = fn({c: table.column(c).to_numpy().astype(float) for c in columns})
        made = []
        for n, kind in outs.items():
            x = np.ascontiguousarray(found[n][own:], float)
            flat = pa.array(x.ravel(), pa.float64(), mask=np.isnan(x.ravel()))
            made.append(flat if kind == "double" else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat))
        return pa.table([*(table.column(c).slice(own) for c in names), *made], names=schema.names)

    return rows.groupBy(by, "_chunk").applyInArrow(run, schema)
