"""Tables written in the middle of a plan, so that its lineage ends there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup side up to which it is sent to every executor.
BROADCAST_ROWS = 100_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder the session names; a local one serves a local master only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """A written table, hinted for broadcast if it holds at most BROADCAST_ROWS rows."""
    df = kept(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
