"""Each operator against a plain version of itself on a small fixture."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fathomline.llm import components, decontaminate, licenses, mixing, sharding, simhash, tokencount, tokenfile, topk, toxicity
from fathomline.llm.runtime import Workspace

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_folding_undoes_disguises():
    assert toxicity.fold("1D10T, ѕtupіd; l0ser?") == " idiot stupid loser "
    model = toxicity.Model({" idiot": 4.0}, ["idiot proof"])
    automaton = model.automaton()
    assert toxicity.intensity(toxicity.fold("an id1ot here"), automaton, 50) == 4.0
    assert toxicity.intensity(toxicity.fold("this is idiot proof"), automaton, 50) == 0.0
    assert toxicity.intensity(toxicity.fold("idiot " + "word " * 400), automaton, 50) < 4.0


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    found = toxicity.toxicity(spark, spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97


def test_simhash_components(spark, docs, texts):
    def plain(text):
        words = simhash.words_of(text)
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = [sum(xxhash.xxh64_intdigest(r.encode(), 42) >> b & 1 for r in runs) for b in range(64)]
        return sum(1 << b for b in range(64) if counts[b] * 2 > len(runs))

    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    roots = union(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = {i: (f"{fps[k]:016x}", ids[roots[k]]) for k, i in enumerate(ids)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.duplicates(spark, docs).collect()} == want


def test_grid_cells_miss_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for i in range(300):
        for b in rng.choice(64, 3, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (simhash.cell_keys(simhash.popcounts(x), 3) for x in (base, near))
    assert (a == b).any(1).all()
    assert (np.abs(simhash.popcounts(base).astype(int) - simhash.popcounts(near)).sum(1) <= 3).all()


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = []
    for g in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        rows.append(words)
        edited = list(words)
        for i in rng.sample(range(120), g % 4):
            edited[i] = f"x{rng.randint(0, 10**6)}"
        rows.append(edited)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    roots = union(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, df).collect()}
    assert got == {i: r for i, r in enumerate(roots) if roots.count(r) > 1}


def test_forest_equals_all_pairs_on_a_large_cell():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    links = [(a, b) for a, b in itertools.combinations(range(200), 2) if np.linalg.norm(x[a] - x[b]) < 0.2]
    edges = simhash.forest(200, lambda i, js: np.linalg.norm(x[js] - x[i], axis=1) < 0.2)
    assert union(200, links) == union(200, edges) and len(edges) < 200


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 540)] + [(700, i) for i in range(701, 790)]
    want = union(800, links)
    out = components.connected(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {n: want[n] for a, b in links if a != b for n in (a, b)} and len(out) == len({r.node for r in out})


def test_topk(spark):
    d = spark.read.parquet(f"{DATA}/embeddings.parquet")
    pdf = d.toPandas()
    v = np.floor(1024 * np.stack(pdf.embedding).astype(float)).astype(int)
    want = set()
    for q in pdf.vec_id[pdf.vec_id % 100 == 0]:
        s = v @ v[pdf.vec_id == q][0]
        order = [i for i in np.lexsort((pdf.vec_id, -s)) if pdf.vec_id[i] != q][:10]
        want |= {(q, n + 1, pdf.vec_id[i], s[i]) for n, i in enumerate(order)}
    assert {tuple(r) for r in topk.top_k(spark, d, page_rows=64, block_queries=2).collect()} == want


def test_tree_skips_distances():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c * 300, 20, (400, 8)) for c in range(10)]).astype(np.int64)
    norms = (v * v).sum(1)
    tree = topk.MTree(np.arange(len(v)), v, np.sqrt(norms.max() - norms))
    found, computed = tree.search(v[-1], float(norms.max()), 5, -1)
    s = v @ v[-1]
    assert found == [(s[i], i) for i in np.lexsort((np.arange(len(v)), -s))[:5]] and computed < len(v) / 2


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: f"t{rng.randint(0, 3000)}"
    items = [(k, [word() for _ in range(rng.randint(15, 50))]) for k in range(20)]
    rows, want = [], set()
    for i in range(60):
        body = [word() for _ in range(100)]
        if i % 3 == 0:
            k, words = items[i // 3]
            words = list(words)
            for p in rng.sample(range(len(words)), len(words) // 12):
                words[p] = "changed"
            body[40:40] = words
            want.add((i, k))
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in items], "item_id long, text string")
    out = decontaminate.overlaps(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_token_counts_match_the_library(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab é\n\t '1.日s") + rng.choice(["", "<|endoftext|>"]) * (rng.random() < 0.1) for _ in range(40)) for _ in range(500)] + ["a" * 3000, "ab" * 2000]
    counter = tokencount.TokenCounter(path)
    assert counter.count(odd) == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_mix_keeps_to_its_weights(spark):
    weights = {"a": 5.0, "b": 3.0, "c": 2.0}
    blocks = {"a": 500, "b": 300, "c": 900}
    rows = mixing.schedule(blocks, weights)
    slots = {}
    for s in weights:
        own = [r for r in rows if r[0] == s]
        for k, (_, first, slot, per, period, places) in enumerate(own):
            for b in range(first, own[k + 1][1] if k + 1 < len(own) else blocks[s]):
                slots[slot + (b - first) // per * period + places[(b - first) % per]] = s
    assert sorted(slots) == list(range(1700))
    seen = dict.fromkeys(weights, 0)
    for t in range(900):  # while all last
        seen[slots[t]] += 1
        assert all(abs(seen[s] - weights[s] / 10 * (t + 1)) < 1 for s in weights)


def test_token_files(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    space = Workspace(spark, "files")
    files = tokenfile.write_tokens(spark, docs, path, space.path("x"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}
    out = sorted(tokenfile.read_tokens(spark, files).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in out] == [(i, len(want[i]) // 4, zlib.crc32(want[i])) for i in sorted(want)]
    reader = tokenfile.Reader(files[0][0])
    one = int(reader.ids[3])
    assert [reader.at(k) for k in reader.find(one)] == [want[one]] and reader.find(-5) == []
    frame = bytearray(reader.file.read_at(int(reader.table[3, 0]), int(reader.starts[3])))
    frame[-1] ^= 255
    with pytest.raises(Exception):
        reader.at(3, bytes(frame))


def test_shards_are_minimax(spark, docs, texts):
    groups = {}
    for i in sorted(texts):
        groups.setdefault(texts[i], []).append(i)
    sizes = [len(g) * (len(t.encode()) + 1) for t, g in sorted(groups.items(), key=lambda x: x[1][0])]
    ends = list(itertools.accumulate(sizes))
    least = next(c for c in range(max(sizes), ends[-1] + 1) if sharding.greedy_cuts(ends, c, 8) is not None)
    out = sharding.shards(spark, docs, 8).toPandas()
    assert out.groupby("shard")["size"].sum().max() == least
    table = spark.createDataFrame(list(zip(sizes, ends, strict=True)), "size long, upto long")
    assert all(sharding.minimax_cuts(table, 8, grid) == sharding.greedy_cuts(ends, least, 8) for grid in (5, 20, 1000))


def test_licenses_against_plain_dice(spark, docs, texts):
    """Whole rows as a multiset, over the table and over licenses in full, alone, in longer texts and repeated."""
    import re
    from collections import Counter

    templates = licenses._templates(licenses.NOTICES)
    full = {name: max(texts_, key=len) for name, texts_ in licenses.NOTICES.items()}
    paragraphs = {"BSD-2-Clause": [licenses._BSD_GRANT, licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_WARRANTY], "BSD-3-Clause": [licenses._BSD_GRANT, licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_NAMES, licenses._BSD_WARRANTY], "0BSD": [licenses._0BSD_GRANT, licenses._ISC_WARRANTY], "ISC": [licenses._ISC_GRANT, licenses._ISC_WARRANTY], "MIT": [licenses._MIT_GRANT, licenses._MIT_NOTICE, licenses._MIT_WARRANTY]}
    more = [(1000 + k, t) for k, t in enumerate(full.values())] + [(2000 + k, "\n\n".join(p)) for k, p in enumerate(paragraphs.values())]
    more += [(3000, "\n\n".join([*p, "and some other words of this file"] * 2)) for p in paragraphs.values()] + [(None, "Released under the MIT License.")] * 2
    rows = [*texts.items(), *more]

    def pieces(text):
        for p in {*text.split("\n"), *re.split("\n[ \t\r]*\n", text), text}:
            words = "".join(c if c.isalnum() else " " for c in p.lower()).split()
            if words:
                yield tuple({" ".join(x) for x in zip(words, words[1:], strict=False)} or set(words))

    want = Counter()
    for i, t in rows:
        found = {}
        for p in pieces(t):
            dice, name = max(((2 * len(set(p) & set(b)) / (len(p) + len(b)), name) for name, b in templates), default=(0, ""))
            if dice >= 0.8:
                found.setdefault(name, []).append(round(dice, 9))
        for family, members in licenses.FAMILIES.items():
            if set(members) & set(found):
                found.pop(family, None)
        want.update((i, name, max(d), len(d)) for name, d in found.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.license, r.dice, r.pieces) for r in licenses.scan(spark, df).collect()) == want
    names = {}
    for i, name, _, _ in want:
        names.setdefault(i, set()).add(name)
    assert [names[2000 + k] for k in range(len(paragraphs))] == [{name} for name in paragraphs]
