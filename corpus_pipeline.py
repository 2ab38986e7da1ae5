"""A corpus cleaned, mixed and sharded in five stages, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, mixing, sharding, simhash, toxicity
from fathomline.llm.runtime import Workspace, lookup

#: Documents with at least this score are rejected.
TOXIC = 0.7


def numbered_rows(space: Workspace, docs: DataFrame) -> DataFrame:
    """The rows as a struct ``doc`` with a number of their own, ``row``; written, so that the numbers stay."""
    return space.keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")


def located_rows(space: Workspace, docs: DataFrame) -> DataFrame:
    """As ``numbered_rows``, but without a copy where ``docs`` is read from files: a row's number is its file's and its place in it."""
    try:
        rows = docs.select(F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    except AnalysisException:
        return numbered_rows(space, docs)
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # one row for each file
    table = space.spark.createDataFrame(list(enumerate(files)), "number long, file string")
    return rows.join(F.broadcast(table), "file").select("doc", (F.shiftleft("number", 40) + F.col("nth")).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under TOXIC. The lexicon is learned from the labels of ``sf_dir`` that are not held out.

    Null and empty texts have no hit and stay; repeated rows are judged alike; an empty table stays empty.
    All columns pass, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.fit(spark, docs, labels)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, into=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a five-word shingle similarity of 0.8 or more: the smallest id (null last), then the first in the table.

    Every row counts for itself: rows that share an id stay if their texts differ, and one stays if they are
    copies. Null and empty texts are one group. An empty table stays empty; all columns pass.
    """
    space = Workspace(spark, "stage-near")
    rows = numbered_rows(space, docs)
    groups = space.keep(simhash.near_duplicates(spark, rows.select(F.col("row").alias("doc_id"), "doc.text")), "groups")
    members = lookup(rows.select(F.col("row").alias("doc_id"), F.col("doc.doc_id").alias("id")), groups, ["doc_id"])
    order = F.struct(F.col("id").isNull().alias("last"), "id", "doc_id")
    firsts = space.keep(members.groupBy("component_id").agg(F.min(order).getField("doc_id").alias("doc_id")).select("doc_id"), "firsts")
    gone = space.keep(lookup(groups, firsts, ["doc_id"], "left_anti").select(F.col("doc_id").alias("row")), "gone")
    return lookup(rows, gone, ["row"], "left_anti").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark; each row is judged by its own text, whatever its id.

    Null and empty texts hold none and stay. An empty table stays empty; all columns pass.
    """
    space = Workspace(spark, "stage-leaks")
    rows = numbered_rows(space, docs)
    found = decontaminate.overlaps(spark, rows.select(F.col("row").alias("doc_id"), "doc.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = space.keep(found.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return lookup(rows, leaks, ["row"], "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix: the files, by name, and the rows in them follow the schedule.

    Texts play no part; a null source is a source, rows with equal or null ids are placed each. An empty
    table stays empty; all columns pass.
    """
    space = Workspace(spark, "stage-mix")
    rows = located_rows(space, docs)
    places = space.keep(mixing.mix(spark, rows.select(F.col("row").alias("doc_id"), "doc.source")).select(F.col("doc_id").alias("row"), "position"), "places")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.join(places.hint("merge"), "row")
    return placed.repartitionByRange(parts, "position").sortWithinPartitions("position").select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with ``size, shard, slot``: eight contiguous shards of the mixed order, equal texts together.

    Null and empty texts have size 1 and are one group; repeated rows get a place each. Columns of the
    input named ``size``, ``shard`` or ``slot`` are replaced; others pass. An empty table stays empty.
    """
    space = Workspace(spark, "stage-shard")
    place = "_place"
    while place in (c.lower() for c in docs.columns):
        place += "_"

    def placed(rows: DataFrame) -> DataFrame:
        # Part numbers are compared as numbers: from 100,000 files on names no longer sort like them.
        file = F.col("_metadata.file_name")
        part = F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long")
        return rows.select("*", F.struct(part.alias("part"), file.alias("file"), F.col("_metadata.row_index").alias("nth")).alias(place))

    try:
        rows = placed(docs)
    except AnalysisException:  # not read from files
        rows = placed(space.keep(docs, "docs"))
    found = space.keep(sharding.shards(spark, rows, 8, order=F.col(place), with_place=True).select(F.col("place").alias(place), "size", "shard", "slot"), "found")
    taken = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    return rows.select(*taken, place).join(found.hint("merge"), place).select(*taken, "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("shards", shard),
]

#: Learned lexicons, shingle verification and seeds have no SQL form; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
