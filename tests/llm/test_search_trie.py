"""Conversation trie, hard negatives and nearest neighbours against plain versions, and their edge cases."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from fathomline.llm import negatives, neighbors, queries, trie
from fathomline.llm.runtime import Workspace

D = "/root/testdata/sf0.001"


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) with unique turns."""
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seqs[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        leaves = sum(not children[q] for q in below[p])
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r[c] for c in trie.NODES) for r in df.collect()), key=str)


CONVS = "conv_id long, turn long, role string, text string, path string, part int, h int, n long, base long"


@pytest.fixture(scope="module")
def talks():
    rng, rows = np.random.default_rng(4), []
    for c in [*range(-7, 60), 100, 101, 105]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t if t else None, ["user", None, "bot"][t % 3], ["", None, "yes", "é"][int(rng.integers(0, 4))]))
    # A third of all conversations is one and the same, so whole ranges hold a single path.
    for c in range(200, 700, 5):
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    rows += [(1000, t, "user", f"long {t}") for t in range(300)] + [(1005, t, "user", f"long {t}") for t in range(290)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_trie(spark, talks, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, *[None] * 5) for r in talks], CONVS)
        assert shown(trie.conversation_trie(spark, df)) == plain_trie(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_edges(spark):
    assert trie.conversation_trie(spark, spark.createDataFrame([], CONVS)).count() == 0
    # crc32("3") % 9 turns come from conversation 0, which is not there; its own single turn is within them.
    rows = [(3, 0, "user", "x"), (None, 0, "user", "nobody's")]
    assert zlib.crc32(b"3") % 9 > 0
    (only,) = shown(trie.conversation_trie(spark, spark.createDataFrame([(*r, *[None] * 5) for r in rows], CONVS)))
    assert only == (3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())
    # Repeated rows are turns each; a very long text counts its bytes.
    rows = [(0, 1, "user", "é" * 1_000_000)] * 2 + [(10, 1, "user", "é" * 1_000_000)]
    got = shown(trie.conversation_trie(spark, spark.createDataFrame([(*r, *[None] * 5) for r in rows], CONVS)))
    assert [r[:7] for r in got] == [(0, 0, None, 2, 1, 1, 2_000_000), (0, 1, 0, 2, 1, 1, 2_000_000), (0, 2, 0, 1, 0, 1, 0)]


def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{D}/conversations.parquet'")
    cols = ", ".join(trie.NODES)
    want = sorted(con.execute(f"select {cols} from ({queries.ORACLE['op11_trie']})").fetchall(), key=str)
    assert shown(queries.op11_trie(spark, D)) == want


ROWS = "vec_id long, embedding array<float>, label int, v string, id long, part int, leaf int, number long, score double, dim int"


def vectors(n, clusters, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, 8))
    x = centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, 8)) * 0.2
    return x.astype(np.float32)


def frame(spark, ids, x, labels):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], y, *[None] * 7) for i, v, y in zip(ids, x, labels, strict=True)]
    return spark.createDataFrame(rows, ROWS)


def plain_negatives(ids, x, labels, positives=5, k=5, every=100):
    v = np.floor(256 * x.astype(float)).astype(int)
    out = []
    for a in range(len(ids)):
        if ids[a] % every:
            continue
        s = v @ v[a]
        order = sorted((r for r in range(len(ids)) if ids[r] != ids[a]), key=lambda r: (-s[r], ids[r]))
        for p in [r for r in order if labels[r] == labels[a]][:positives]:
            for n, r in enumerate([r for r in order if labels[r] != labels[a] and 80 * s[p] <= 100 * s[r] <= 100 * s[p]][:k]):
                out.append((ids[a], ids[p], n + 1, ids[r], s[p], s[r]))
    return sorted(out)


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives_over_many_pages(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PAGE_ROWS", 64)
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    x = vectors(900, 12)
    x[100:400] = x[100]  # a third of all rows is one vector
    ids, labels = list(range(0, 9000, 10)), np.random.default_rng(1).integers(0, 4, 900).tolist()
    got = negatives.hard_negatives(spark, frame(spark, ids, x, labels))
    assert sorted(tuple(r[c] for c in NEGATIVE) for r in got.collect()) == plain_negatives(ids, x, labels)


def test_pages_are_skipped():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 8))[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 8)) * 0.02
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    length = int((x * x).sum(1).max())
    router = negatives.Router(negatives._augmented(x, length), 16)
    leaf, away = router.route(negatives._augmented(x, length))
    pages = {int(n): (away[leaf == n].min(0), away[leaf == n].max(0)) for n in np.unique(leaf)}
    q = x[0]
    best = np.sort(x @ q)[-20]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"number": [0], "id": [0], "label": [0], "v": [q.tolist()], "lows": [[int(best)]], "highs": [[1 << 40]]})
    (out,) = negatives._directed(router, length, 8, pages, False)(iter([batch]))
    hit = set(out.column("leaf").to_pylist())
    assert set(leaf[(x @ q) >= best].tolist()) <= hit and len(hit) < len(pages)


def test_hard_negatives_edges(spark):
    bad = float("nan")
    ids = [0, 0, 1, 2, 3, 4, 5, 6, None, 100]
    x = [[1, 0], [1, 0], [1, 0], [0.5, 0], [1, bad], [1, None], None, [], [1, 0], [1, 0, 0]]
    labels = [1, 1, 1, 2, 2, 2, 2, 2, 1, 1]
    df = frame(spark, ids, x, labels).unionByName(frame(spark, [7], [[0.9, 0]], [None]))
    got = sorted(tuple(r[c] for c in NEGATIVE) for r in negatives.hard_negatives(spark, df).collect())
    assert got == []  # the only other label scores half
    more = df.unionByName(frame(spark, [8, 8, 9], [[0.9, 0]] * 3, [2, 2, 3]))
    got = sorted(tuple(r[c] for c in NEGATIVE) for r in negatives.hard_negatives(spark, more).collect())
    score = 230 * 256
    assert got == sorted([(0, 1, 1, 8, 65536, score), (0, 1, 2, 8, 65536, score), (0, 1, 3, 9, 65536, score)] * 2)
    assert negatives.hard_negatives(spark, df.limit(0)).count() == 0


def recall(got, ids, x, k, every):
    hit = total = 0
    for a in np.flatnonzero(np.array(ids) % every == 0):
        s = (x.astype(float) * x[a].astype(float)).sum(1)
        rows = [r for r in np.lexsort((ids, -s)) if ids[r] != ids[a]][:k]
        hit += len({ids[r] for r in rows} & set(got[ids[a]]))
        total += len(rows)
    return hit / total


@pytest.mark.parametrize("clusters", [1, 30])
def test_nearest(spark, clusters):
    x = vectors(3000, clusters, 5) * np.linspace(0.5, 2, 3000, dtype=np.float32)[:, None]
    x[1000:2000] = x[1000]  # a third of all rows is one vector
    ids = list(range(3000))
    out = neighbors.nearest(spark, frame(spark, ids, x, ids)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float((x[r.vec_id].astype(float) * x[r.query_id].astype(float)).sum())) < 1e-9
    assert len(got) == 150 and all(len(v) == 20 for v in got.values())
    by = sorted(out, key=lambda r: (r.query_id, r["rank"]))
    assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(by, by[1:], strict=False) if a.query_id == b.query_id)
    assert recall_of_scores(by, x, ids) >= 0.9


def recall_of_scores(by, x, ids):
    """Of a query's 20 best scores the share reached (ties are many here)."""
    hit = total = 0
    for q in {r.query_id for r in by}:
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        s = np.sort(np.delete(s, q))[::-1][:20]
        hit += sum(r.score >= s[19] - 1e-9 for r in by if r.query_id == q)
        total += 20
    return hit / total


def test_nearest_recall_on_the_table(spark):
    pdf = spark.read.parquet(f"{D}/embeddings.parquet").toPandas()
    x, ids = np.stack(pdf.embedding), pdf.vec_id.tolist()
    got = queries.op13_nearest(spark, D).groupBy("query_id").agg({"vec_id": "collect_list"}).collect()
    assert recall({r[0]: r[1] for r in got}, ids, x, 20, 20) >= 0.9


def test_nearest_edges(spark):
    inf = float("inf")
    ids = [0, 0, 1, 2, 3, 4, 5, 6, None, 20]
    x = [[1, 0], [1, 0], [1, 1], [0, 0], [1, inf], [1, None], None, [], [1, 0], [-1, 0]]
    out = neighbors.nearest(spark, frame(spark, ids, x, [1] * 10)).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0)]
    assert neighbors.nearest(spark, frame(spark, ids, x, [1] * 10).limit(0)).count() == 0


def test_probes_come_in_the_order_of_their_estimated_success():
    family = neighbors.Family(1.0, 6, 2, 1, 3, 8)
    x = np.random.default_rng(2).normal(size=(5, 8))
    points = family.points(x / np.linalg.norm(x, axis=1)[:, None])
    everything, _ = family.probes(points, 0, 3**6, 0.7)
    some, groups = family.probes(points, 0, 40, 0.7)
    assert (some == everything[:, :40]).all() and all(len(set(r)) == 3**6 for r in everything.tolist())
    own = family.codes(np.floor(family.places(points, 0)), 0)
    assert all(own[0][i] in some[i] and own[1][i] in groups[i] for i in range(5))


def test_workspace_is_shared(spark):
    assert Workspace(spark, "x").root.startswith("file:")


@pytest.mark.parametrize(("scale", "kind"), [(256, np.float32), (1 << 17, np.float64), (1 << 27, np.int64)])
@pytest.mark.parametrize("clusters", [1, 6])
def test_blocks_walk_pages_together(scale, kind, clusters, monkeypatch):
    """Anchors of a block against a page as a plain search gives them, with repeated ids, in one product a label or leaf."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)) if clusters == 1 else rng.normal(size=(clusters, 8))[rng.integers(0, clusters, 700)] + rng.normal(size=(700, 8)) * 0.05
    v = np.floor(scale * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    v[300:350] = v[300]
    ids, labels, at = rng.integers(0, 600, 700), rng.integers(0, 4, 700), np.arange(0, 700, 7)
    largest = float((v.astype(float) ** 2).sum(1).max())
    assert negatives._whole(largest) is kind
    small = v.astype(negatives._stored(largest))
    assert (small == v).all() and (negatives._vectors(negatives._bytes(v, small.dtype), 8, small.dtype) == v).all()
    page = negatives.VPTree(ids, labels, small, int((v * v).sum(1).max()), largest)
    scores = v[at] @ v.T
    ranked = np.sort(scores, axis=1)
    lows, highs = ranked[:, [-60, -30]], ranked[:, [-20, -1]]
    calls, products = [], page._products
    monkeypatch.setattr(page, "_products", lambda *a: (calls.append(1) or p for p in products(*a)))
    for same in (True, False):
        want = []
        for n, s in enumerate(scores):
            order = [r for r in np.lexsort((ids, -s)) if (labels[r] == labels[at[n]]) == same and ids[r] != ids[at[n]]]
            want += [(n, w, s[r], ids[r]) for w in range(2) for r in [r for r in order if lows[n, w] <= s[r] <= highs[n, w]][:5]]
        calls.clear()
        got = zip(*(c.tolist() for c in page.walk(ids[at], small[at], lows, highs, labels[at], same, 5)), strict=True)
        assert sorted(got) == sorted(want) and len(calls) <= 8
    assert (page.met(small[at], lows, highs).mean() < 0.5) == (clusters > 1)


def test_anchors_are_sent_once_a_subtree():
    """An anchor whose annulus meets all leaves goes to each subtree once, not to each leaf."""
    import pyarrow as pa

    x = np.random.default_rng(3).integers(-99, 99, (2000, 8))
    length = int((x * x).sum(1).max())
    router = negatives.Router(negatives._augmented(x, length), 16)
    leaf, away = router.route(negatives._augmented(x, length))
    pages = {int(n): (away[leaf == n].min(0), away[leaf == n].max(0)) for n in np.unique(leaf)}
    batch = pa.RecordBatch.from_pydict({"number": [0, 1], "id": [0, 1], "label": [0, 0], "v": x[:2].tolist(), "lows": [[-(1 << 60)], []], "highs": [[1 << 60], []]})
    (out,) = negatives._directed(router, length, 8, pages, False, 2)(iter([batch]))
    assert sorted(out.column("leaf").to_pylist()) == sorted({n >> 2 for n in pages}) and set(out.column("number").to_pylist()) == {0}
