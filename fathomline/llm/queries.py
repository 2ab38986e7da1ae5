"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, licenses, linedup, mixing, negatives, neighbors, sharding, simhash, tokencount, tokenfile, topk, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see ``toxicity.toxicity`` for nulls, repeated rows, empty tables and clashing columns."""
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents; edge cases as in ``licenses.scan``."""
    return licenses.scan(spark, _table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line de-duplication leaves of all documents, as counts and checksums; edge cases as in ``linedup.deduplicate_lines``."""
    return linedup.digest(spark, _table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents; edge cases as in ``simhash.duplicates``."""
    return simhash.duplicates(spark, _table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every id divisible by 100; edge cases as in ``topk.top_k``."""
    return topk.top_k(spark, _table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with the benchmark; edge cases as in ``decontaminate.overlaps``."""
    return decontaminate.overlaps(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; edge cases as in ``tokencount.token_counts``."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of all documents in the mix; edge cases as in ``mixing.mix``."""
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back; edge cases as in ``tokenfile.write_tokens``."""
    return tokenfile.token_files(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of all documents; edge cases as in ``sharding.shards``."""
    return sharding.shards(spark, _table(spark, sf_dir, "documents"), 8)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations; edge cases as in ``trie.conversation_trie``."""
    return trie.conversation_trie(spark, _table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every id divisible by 100; edge cases as in ``negatives.hard_negatives``."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark, _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every id divisible by 20; edge cases as in ``neighbors.nearest``."""
    return neighbors.nearest(spark, _table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_source_mix": op8_source_mix,
    "op9_token_files": op9_token_files,
    "op10_shards": op10_shards,
    "op11_trie": op11_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

ORACLE: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.id AS query_id, c.id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v)
            WHERE q.id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_trie": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), d AS (
            SELECT conv_id, turn, strlen(text) AS size, substring(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 1, 32) AS digest FROM t
        ), c AS (
            SELECT conv_id, list({'digest': digest, 'size': size} ORDER BY turn NULLS FIRST, digest) AS turns,
                   CAST(list_reduce(
                       range(0, 8 * length(CAST(conv_id AS VARCHAR))),
                       lambda crc, i: CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substring(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT)) ELSE crc END) % 2 = 1
                           THEN xor((CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substring(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT)) ELSE crc END) // 2, CAST(3988292384 AS BIGINT))
                           ELSE (CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substring(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT)) ELSE crc END) // 2 END,
                       CAST(4294967295 AS BIGINT)) AS BIGINT) AS rest
            FROM d GROUP BY conv_id
        ), h AS (
            SELECT conv_id, turns, xor(rest, CAST(4294967295 AS BIGINT)) % 9 AS h FROM c
        ), r AS (
            SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
            FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5
        ), p AS (
            SELECT conv_id, depth, len(turns) = depth AS ends, list_aggregate(list_transform(turns[1:depth], lambda x: x.digest), 'string_agg', '') AS path, turns[depth].size AS size
            FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r)
        ), n AS (
            SELECT coalesce(path, '') AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM p GROUP BY ALL
        ), n2 AS (
            SELECT path, depth, min(conv_id) AS conv_id, sum(n_convs) AS n_convs, any_value(size) AS size, any_value(ends_sha256) AS ends_sha256 FROM n GROUP BY path, depth
        ), k AS (
            SELECT a.path, a.depth, count(b.path) AS n_children FROM n2 a LEFT JOIN n2 b ON b.depth = a.depth + 1 AND substring(b.path, 1, 32 * a.depth) = a.path GROUP BY ALL
        ), u AS (
            SELECT substring(n2.path, 1, 32 * up) AS path, up AS depth, sum((n2.n_convs - 1) * n2.size) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
            FROM (SELECT path, depth, n_convs, size, unnest(range(0, depth + 1)) AS up FROM n2) n2 JOIN k ON k.path = n2.path AND k.depth = n2.depth GROUP BY ALL
        )
        SELECT n2.conv_id, n2.depth, q.conv_id AS parent_conv_id, CAST(n2.n_convs AS BIGINT) AS n_convs, k.n_children,
               u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n2.ends_sha256
        FROM n2 JOIN k ON k.path = n2.path AND k.depth = n2.depth JOIN u ON u.path = n2.path AND u.depth = n2.depth
        LEFT JOIN n2 q ON q.depth = n2.depth - 1 AND q.path = substring(n2.path, 1, 32 * (n2.depth - 1))
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.id AS anchor_id, c.id AS other, a.label = c.label AS same,
                   CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.id <> c.id AND len(a.v) = len(c.v)
            WHERE a.id % 100 = 0
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        ), n AS (
            SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}
