"""What keeps the operators within their limits, and that it leaves the results as they are."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import licenses, neighbors, simhash, tokenfile, topk
from fathomline.llm.runtime import Workspace


def test_plain_words_skip_normalisation():
    """Words of small and capital letters get their ids without the steps that leave them as they are."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = ["plain Words HERE\nantidisestablishmentarianism a I " + " ".join(f"{a}{b}x" for a in "abcdefgh" for b in "qrstuv"), None, "", "  "]
    encoder.tokenizer = None
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([texts[0]], 1)]
    assert found == [[*library.encode(texts[0], add_special_tokens=False).ids, 1]]
    encoder = tokenfile.Encoder(path)
    texts += ["don't (Stop)", "naïve café Straße ΣΑΣ İx", "<|endoftext|> a<|endoftext|>b", "x1y2 ... --", "ﬁne été Kelvin"]
    for _ in range(2):  # the second time from memory
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, 1)]
        assert found == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_kept_tables_leave_no_shuffle_files(spark):
    """A written table takes its own place on disk, not that of the shuffles behind it as well."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffles()
    df.write.format("noop").mode("overwrite").save()
    held = shuffles()
    assert held - before
    out = Workspace(spark, "x").keep(df, "counts")
    for _ in range(50):  # files go in the background
        if not (left := shuffles() - held):
            break
        time.sleep(0.1)
    assert not left and sorted(r["count"] for r in out.collect()) == [100] * 10


def test_pieces_are_normalised_once(spark):
    """The plan works out a piece's words in one place."""
    plan = licenses.scan(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_strange_words_up_to_the_bound_are_found(spark):
    """Notices with so many words put in, taken out and repeated as the threshold allows, against the plain coefficient."""
    rows = []
    for text in (licenses._MIT_WARRANTY, licenses._BSD_NAMES, "Licensed under the Apache License, Version 2.0.", licenses._ISC_GRANT):
        words = text.split()
        for k in range(0, len(words), 2):
            rows += [(len(rows), " ".join([*(f"strange{i}" for i in range(k // 2)), *words])), (len(rows) + 1, " ".join([*words[k // 3 :], *(f"odd{i}" for i in range(k // 3))])), (len(rows) + 2, " ".join(words * 2 + words[:k] + ["odd"] * k))]
    templates = licenses._templates(licenses.NOTICES)
    want = set()
    for i, t in rows:
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        piece = {" ".join(x) for x in zip(w, w[1:], strict=False)}
        best = max((2 * len(piece & set(bs)) / (len(piece) + len(bs)), name) for name, bs in templates)
        if best[0] >= 0.8 - 1e-9:
            want.add((i, best[1], round(best[0], 9)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 40 < len(want) < len(rows) and {(r.doc_id, r.license, r.dice) for r in licenses.scan(spark, df).collect()} == want


def test_queries_of_a_block_are_scored_together(monkeypatch):
    """Blocks against pages as a plain search of the probed rows gives them, with repeated ids, in one scoring a page."""
    rng = np.random.default_rng(3)
    ids = np.r_[np.arange(0, 300), 7, 7, 8]
    vectors = np.round(rng.normal(size=(303, 4)), 1)
    vectors[300] = vectors[7]
    codes = rng.integers(0, 9, 303)
    asked = np.arange(0, 300, 10)
    probes = [rng.choice(12, rng.integers(0, 6), replace=False) for _ in asked]

    def pack(kind, n, table, most):
        return [b.column(kind)[0] for b in neighbors.packed(kind, ["g"], most)(iter([pa.RecordBatch.from_pydict({"g": np.zeros(n, int), **table})]))]

    calls = []
    score = neighbors.exact_scores
    monkeypatch.setattr(neighbors, "exact_scores", lambda *a: calls.append(1) or score(*a))
    for hashed, k in ((True, 5), (False, 5), (True, 400)):
        page = pack("page", 303, {"id": ids, "v": pa.array(vectors.tolist()), **({"code": codes} if hashed else {})}, 100)
        block = pack("block", 30, {"id": asked, "v": pa.array(vectors[asked].tolist()), **({"probes": pa.array([p.tolist() for p in probes], pa.list_(pa.int64()))} if hashed else {})}, 100)
        calls.clear()
        out = neighbors._visit(k, hashed)(iter([pa.RecordBatch.from_arrays([pa.array([p.as_py() for p in page], pa.binary()), pa.array([block[0].as_py()] * len(page), pa.binary())], names=["page", "block"])]))
        found = {x["query_id"]: list(zip(x["ids"], x["scores"], strict=True)) for b in out for x in b.to_pylist()}
        want = {}
        for q, p in zip(asked.tolist(), probes, strict=True):
            rows = {(i, s) for i, s, c in zip(ids.tolist(), score(vectors, vectors[q]).tolist(), codes, strict=True) if i != q and (not hashed or c in p)}
            if rows:
                want[q] = sorted(rows, key=lambda x: (-x[1], x[0]))[:k]
        assert found == want and len(calls) <= len(page)


def test_probes_travel_as_paths_and_are_worked_out_once(spark, monkeypatch):
    """Asks hold short paths that lead to the buckets of the probes, floats stay floats, and no pass over all rows only sets ranges."""
    family = neighbors.Family(1.0, 7, 2, 2, 3, 8)
    x = np.random.default_rng(4).normal(size=(30, 8)).astype(np.float32)
    (first, second) = neighbors._asking(family, 90, 0.7)(iter([pa.RecordBatch.from_pydict({"id": np.arange(30), "v": pa.array(x.tolist(), pa.list_(pa.float32()))})]))
    for t, out in enumerate((first, second)):
        buckets, groups = family.probes(family.points(x.astype(float), query=True), t, 90, 0.7)
        ends = family.steps(np.arange(3**5), t, 2, 7)
        got = sorted((r["id"], r["grp"], int(b)) for r in out.to_pylist() for b in r["code"] + ends[r["probes"]])
        assert got == sorted(zip(np.repeat(np.arange(30), 90).tolist(), groups.reshape(-1).tolist(), buckets.reshape(-1).tolist(), strict=True))
        assert len({(r["id"], r["grp"]) for r in out.to_pylist()}) == out.num_rows and set(out.column("tab").to_pylist()) == {t}
        assert out.schema.field("probes").type == pa.list_(pa.int16()) and out.schema.field("v").type == pa.list_(pa.float32())

    plans, merged = [], neighbors._merged
    monkeypatch.setattr(neighbors, "_merged", lambda found, k: plans.append(found._jdf.queryExecution().toString()) or merged(found, k))
    x = np.random.default_rng(5).normal(size=(200, 8)).astype(np.float32)
    x[50:150] = x[50]
    single = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    double = single.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    a, b = (sorted(tuple(r) for r in neighbors.nearest(spark, d).collect()) for d in (single, double))
    assert a == b and len(a) == 200 and plans and not any("rangepartitioning(" in p for p in plans)


@pytest.mark.parametrize("clusters", [1, 12])
@pytest.mark.parametrize(("scale", "kind"), [(1024, np.float32), (1 << 17, np.float64), (1 << 27, np.int64)])
def test_queries_of_a_block_walk_a_tree_together(clusters, scale, kind, monkeypatch):
    """Blocks against a page as a plain search gives them, with ties and repeated ids, in one product a leaf and round at most."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8)) if clusters == 1 else rng.normal(size=(clusters, 8))[rng.integers(0, clusters, 900)] + rng.normal(size=(900, 8)) * 0.02
    v = np.floor(scale * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    v[300:400] = v[300]
    ids, at = rng.integers(0, 700, 900), np.r_[0:900:4, 310]
    norms = (v * v).sum(1)
    assert topk.whole(float(norms.max())) is kind
    tree = topk.MTree(ids, v, np.sqrt(norms.max() - norms))
    for k in (5, 40, 2000):
        q, s, i, computed = tree.search_block(v[at], float(norms.max()), k, ids[at])
        want = []
        for n, scores in enumerate(v[at] @ v.T):
            order = [r for r in np.lexsort((ids, -scores)) if ids[r] != ids[at[n]]][:k]
            want += [(n, scores[r], ids[r]) for r in order]
        assert list(zip(q.tolist(), s.tolist(), i.tolist(), strict=True)) == want
        one, alone = tree.search(v[at[7]], float(norms.max()), k, int(ids[at[7]]))
        assert one == [(b, c) for a, b, c in want if a == 7] and alone <= computed
        assert clusters == 1 or k > 5 or computed < 0.4 * len(at) * len(v)

    walks, together = [], topk.MTree.search_block
    monkeypatch.setattr(topk.MTree, "search_block", lambda *a: walks.append(1) or together(*a))
    page, block = (next(topk._pack(kind)(iter([pa.RecordBatch.from_pydict({"part": np.zeros(len(r), np.int32), "id": ids[r], "v": pa.array(v[r].tolist())})]))).column(kind) for kind, r in (("page", np.arange(900)), ("block", at)))
    (out,) = topk._search(5, float(norms.max()))(iter([pa.RecordBatch.from_arrays([pa.array([0]), page, block], names=["part", "page", "block"])]))
    assert len(walks) == 1 and out.num_rows == 5 * len(at)


def test_rows_of_cells_travel_once(spark):
    """All rows of a key meet, in cells of bounded size; only rows of large keys are dealt a second time, and nothing is joined."""
    keys = [1] * 60 + [2] * 8 + [3] * 2 + [4] + [5] * 9
    rows = [(k, n, 7 * n) for n, k in enumerate(keys)]
    dealt = simhash.cells(Workspace(spark, "t"), spark.createDataFrame(rows, "key long, node long, fp long"), "whole", 8)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(key") == 2 and plan.count("Exchange hashpartitioning(cell") == 1
    assert plan.count("Sort [key") == 2  # each branch sorts once for the window, and the cells keep that order

    tasks = [list(t) for t in dealt.select("cell", "node", "fp").rdd.glom().collect()]
    assert dealt.columns == ["cell", "node", "fp"] and all(r.fp == 7 * r.node for t in tasks for r in t)
    cells, met = [], set()
    for t in tasks:
        assert [(r.cell, r.node) for r in t] == sorted((r.cell, r.node) for r in t)
        for cell in {r.cell for r in t}:
            cells.append(cell)
            nodes = [r.node for r in t if r.cell == cell]
            assert len(nodes) <= 30 and len({keys[n] for n in nodes}) == 1
            met |= set(itertools.combinations(nodes, 2))
    assert len(cells) == len(set(cells))  # no cell is in two tasks
    assert met == {(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if keys[a] == keys[b]}
