"""Feature tables of several sources: pools with linked codes, source columns as long rows, factors of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import factors
from fathomline.functions.chunks import positions
from fathomline.sources.prices import pad_code

#: Kinds of instruments a pool may hold.
KINDS = ("fund", "etf", "index")
#: Shares of missing raw values and of zero scores beyond which a source's candidate is dropped.
RAW_NULLS, SCORE_ZEROS = 0.2, 0.8


def effective_codes(pool: DataFrame, links: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``primary, code, name[, kind]``: each primary code with the codes of the pool and those linked to it.

    ``pool(primary, code, name)``, ``links(primary, linked)``. A linked code that the pool lacks is named by
    itself, and so is a primary that isn't in its own pool. With ``kinds(code, kind)`` a code without a known
    kind fails the job.
    """
    pool = pool.select(pad_code(F.col("primary")).alias("primary"), pad_code(F.col("code")).alias("code"), "name", F.lit(0).alias("_rank"))
    links = links.select(pad_code(F.col("primary")).alias("primary"), pad_code(F.col("linked")).alias("code"))
    own = pool.select("primary").union(links.select("primary")).distinct().select("primary", F.col("primary").alias("code"))
    more = own.unionByName(links).select("primary", "code", F.col("code").alias("name"), F.lit(1).alias("_rank"))
    w = Window.partitionBy("primary", "code").orderBy("_rank", "name")
    out = pool.unionByName(more).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")
    if kinds is None:
        return out
    known = kinds.select(pad_code(F.col("code")).alias("code"), F.lower("kind").alias("kind"))
    fail = F.raise_error(F.concat(F.lit("no declared kind: "), F.col("code"))).cast("string")
    return out.join(known, "code", "left").select("primary", "code", "name", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(fail).alias("kind"))


def with_cumulative(nav: DataFrame, cumulative: DataFrame, keys: tuple[str, ...] = ("code", "date")) -> DataFrame:
    """NAV rows with ``cumulative_nav`` of the same key, null where there is none; all NAV rows stay, each once.

    Of several cumulative rows of a key the largest value counts.
    """
    one = cumulative.groupBy(*keys).agg(F.max("cumulative_nav").alias("cumulative_nav"))
    return nav.join(one, list(keys), "left")


def long_sources(df: DataFrame, columns: list[str]) -> DataFrame:
    """``code, date, source, value``: a row for each column of a wide table, gaps kept as null."""
    return df.unpivot(["code", "date"], [F.col(c).cast("double").alias(c) for c in columns], "source", "value")


def on_primary_days(sources: DataFrame, codes: DataFrame) -> DataFrame:
    """Sources of all codes of a pool on the days of its primary: ``code`` (the primary), ``date, source, value``.

    ``codes(primary, code)``. A source is named ``code__column``; days on which the primary has no value at
    all are left out, other gaps are null.
    """
    days = sources.where("value is not null").select(F.col("code").alias("primary"), "date").distinct().join(codes.select("primary").distinct(), "primary", "left_semi")
    named = sources.join(codes.select(F.col("primary").alias("_p"), F.col("code")), "code").select(F.col("_p").alias("primary"), "date", F.concat_ws("__", "code", "source").alias("source"), "value")
    asked = days.join(named.select("primary", "source").distinct(), "primary")
    return asked.join(named, ["primary", "date", "source"], "left").withColumnRenamed("primary", "code")


def source_factors(sources: DataFrame, wanted: list[tuple[str, str, dict[str, int]]], score_window: int = factors.SCORE_WINDOW, null_limit: float = RAW_NULLS, zero_limit: float = SCORE_ZEROS) -> DataFrame:
    """``code, source, date, candidate_label, raw, value`` of every source's own z-score and kept candidates.

    ``wanted`` are (label, factor, parameters). All candidates of a row are arrays until the shares of missing
    raw values and of zero scores are known, an aggregate for each source; only candidates within both limits
    become rows. The own z-score (label ``source__zscore``) always stays. Gaps of a score are 0.
    """
    rows = sources.withColumn("_series", F.struct("code", "source"))
    rows = positions(rows, "_series", "date")
    held = factors.candidate_values(rows, [(name, params) for _, name, params in wanted], score_window, price="value", by="_series", own=True)
    n = len(wanted)
    nulls, zeros = (F.array(*(F.avg(test(i)) for i in range(n))) for test in (lambda i: F.col("raws")[i].isNull().cast("double"), lambda i: (F.coalesce(F.col("scores")[i], F.lit(0.0)) == 0).cast("double")))
    shares = held.groupBy("code", "source").agg(nulls.alias("_nulls"), zeros.alias("_zeros"))
    keep = F.zip_with("_nulls", "_zeros", lambda a, b: (a <= null_limit) & (b <= zero_limit))
    shares = shares.select("code", "source", F.concat(keep, F.array(F.lit(True))).alias("_keep"))
    labels = F.array(*(F.lit(f"__{label}__zscore") for label, _, _ in wanted), F.lit("__zscore"))
    cells = F.arrays_zip(labels.alias("label"), F.col("raws").alias("raw"), F.col("scores").alias("value"))
    out = held.join(shares, ["code", "source"]).withColumn("c", F.explode(F.filter(cells, lambda x, i: F.col("_keep")[i])))
    return out.select("code", "source", "date", "pos", F.concat("source", "c.label").alias("candidate_label"), F.col("c.raw").alias("raw"), F.coalesce("c.value", F.lit(0.0)).alias("value"))


def column_sets(columns: list[str]) -> dict[str, list[str]]:
    """Columns of a feature matrix by what they are: ``raw``, ``raw_zscore`` and ``factor``."""
    named = [c for c in columns if "__" in c]
    scores = [c for c in named if c.endswith("__zscore")]
    return {"raw": [c for c in named if c not in scores], "raw_zscore": [c for c in scores if c.count("__") == 2], "factor": [c for c in scores if c.count("__") > 2]}


def target_column(columns: list[str], code: str) -> str:
    """The column a code's returns come from: its cumulative NAV, else its price; raises if it has neither."""
    for c in (f"{code}__cumulative_nav", f"{code}__price"):
        if c in columns:
            return c
    raise ValueError(f"no target column of {code}")
