"""Matrices of a research stage, read under the contract that its artefact states.

What can be told from names is told before reading; what rows must satisfy is checked by the scan that reads
them, so no second scan is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fathomline.plans.stages import load_stage

#: Columns of a matrix, and those a reader of scores needs.
MATRIX = ("code", "date", "pos", "nav", "fwd", "candidate_label", "raw", "value")


@dataclass
class Checked:
    """Rows under a contract; ``verify`` after an action on ``rows`` tells what only all of them can."""

    rows: DataFrame
    seen: Observation
    labels: tuple[str, ...]

    def verify(self) -> None:
        found = self.seen.get
        if not found["rows"]:
            raise ValueError("the matrix has no rows of the code")
        if missing := [x for k, x in enumerate(self.labels) if not found[f"label{k}"]]:
            raise ValueError(f"the matrix lacks {missing}")


def load_matrix(spark: SparkSession, metadata_path: str, matrix_path: str | None = None, labels: list[str] | None = None, columns: tuple[str, ...] = MATRIX, data_mode: str = "nav_price_series") -> Checked:
    """The rows of the artefact's code (of ``labels``, if given), only ``columns`` of them.

    Raises at once if the artefact names another data mode or path, if no matrix stands there or if it lacks a
    column. A row without a date or a label fails the job. ``verify`` raises for an empty matrix or a label
    without rows.
    """
    body = load_stage(metadata_path, 0)["feature_preprocess_output"]
    if body.get("data_mode") != data_mode:
        raise ValueError(f"{metadata_path} holds {body.get('data_mode')}, not {data_mode}")
    path = body.get("matrix_path")
    if not path or (matrix_path is not None and matrix_path != path):
        raise ValueError(f"{metadata_path} belongs to {path}, not to {matrix_path}")
    table = spark.read.parquet(path)
    if missing := set(columns) - set(table.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    rows = table.where(F.col("code").cast("string") == body["fund_code"])
    if labels is not None:
        rows = rows.where(F.col("candidate_label").isin(labels))
    broken = F.raise_error(F.lit(f"a row of {path} has no date or label"))
    rows = rows.select(*(F.when(F.col("date").isNull() | F.col("candidate_label").isNull(), broken.cast("string")).otherwise(F.col("code").cast("string")).alias(c) if c == "code" else F.col(c) for c in columns))
    seen, wanted = Observation(), tuple(labels or ())
    observed = rows.observe(seen, F.count("code").alias("rows"), *(F.count_if(F.col("candidate_label") == x).alias(f"label{k}") for k, x in enumerate(wanted)))
    return Checked(observed, seen, wanted)
