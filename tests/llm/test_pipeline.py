"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from fathomline.llm.runtime import Workspace

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    space, columns, seen = Workspace(spark, "test"), docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = space.keep(stage(spark, docs, DATA), name)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen[-1]
        assert docs.columns == columns or name == "shards"
        seen.append(set(ids))
    assert seen[3] == seen[4] == seen[5]
    assert docs.where("shard between 0 and 7").count() == len(seen[5])
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == seen[5]


ODD = "doc_id long, text string, lang string, source string, n_chars long, _place string, row long, doc string, size string, place long, _toxicity double, component_id long, position long, Shard string"


def odd_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x", 1, "d", "s", 2, 0.5, 3, 4, "y"]) for i, t, s in rows], ODD)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names the stages use themselves."""
    words = " ".join(f"word{k} and{k % 13}" for k in range(400))
    rows = [(1, None, None), (2, "", "a"), (3, words, "a"), (3, words, "a"), (3, "another text under the id of others, with words of its own", "b"), (None, "nobody's text of some eight or nine words here", None), (4, words + " end", "b"), (5, "single", "b"), (6, "x" * 200_000, None)]
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    docs = odd_rows(spark, [*rows, (7, f"before it {benchmark} after it", "c")])
    space, sizes = Workspace(spark, "odd"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = space.keep(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        if name == "shards":
            assert docs.columns == [c for c in columns if c not in ("size", "Shard")] + ["size", "shard", "slot"]
        else:
            assert docs.columns == columns
    # Null and empty texts are one group, the copies of a text another; the benchmark's passage goes.
    assert sizes == [10, 7, 6, 6, 6]
    left = docs.collect()
    assert {r.doc_id for r in left} == {1, 3, None, 5, 6} and sum(r.doc_id == 3 for r in left) == 2
    assert all(r["_place"] == "x" and r.component_id == 3 for r in left)
    for k in {r["shard"] for r in left}:
        assert sorted(r.slot for r in left if r["shard"] == k) == list(range(sum(r["shard"] == k for r in left)))


def test_stages_on_an_empty_table(spark):
    docs = odd_rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0, name
