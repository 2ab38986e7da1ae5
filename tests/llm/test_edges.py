"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import uuid

import numpy as np
import public_tokenizers
import pytest

from fathomline.llm import decontaminate, licenses, linedup, mixing, sharding, simhash, tokencount, tokenfile, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, key long, cell long, size long, shard int, score double, fp long, place long, nth long, same string, words string, part int, n int, first long"
LONG = "the quick brown fox number {} jumps over it. " * 3
ROWS = [
    (1, None, "s1"),
    (2, "", "s1"),
    (3, "   \n\t ", None),
    (4, " ".join(f"word{i} other{i % 7}" for i in range(15_000)), "s2"),
    (5, "you are a pathetic loser and an idiot", "s2"),
    (5, "you are a pathetic loser and an idiot", "s2"),
    (6, "you are a pathetic loser and an idiot", "s3"),
    (None, "nobody wrote this line of text here", "s3"),
    (7, "Licensed under CC BY-NC 4.0.\nsecond line of this short text\nsecond line of this short text", "s3"),
    (8, "single", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), *[None] * 15) for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (4, 1, 0), (8, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, empty, labels):
    out = toxicity.toxicity(spark, docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(spark, empty, labels).count() == 0
    model = toxicity.fit(spark, docs, labels.limit(0))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scored[5] > scored[1] == scored[2] and "key" in toxicity.score(docs, model).columns


def test_fold():
    same = {"you clown!": "you clown", "a clown fish!": "a clown fish", "i-d-i-o-t, 1d10t": "idiot idiot", "2015 was": "2015 was", "sh!t for $100": "shit for 100", "trash-can": "trash can", "na\u00efve \uff29\uff24\uff29\uff2f\uff34": "na\u00efve idiot", "\u0456d\u0456\u043et id\u200biot": "idiot idiot", "...": "", "": ""}
    assert {t: toxicity.fold(t).strip() for t in same} == same
    found = toxicity.scorer(toxicity.Model({" clown ": 3.0, " idiot": 4.0}, ["clown fish"]))
    assert found(["you clown!", "you clown", "a clown fish!", "clown fish clown", None]).tolist() == [3.0, 3.0, 0.0, 3.0, 0.0]


def test_toxicity_of_odd_rows(spark, labels):
    rows = [(None, "an idiot"), (None, None), (9, "x" * 3_000_000), (9, "idiot " * 400_000), (9, "idiot " * 400_000)]
    out = toxicity.toxicity(spark, spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double"), labels).collect()
    assert len(out) == 5 and all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in out)
    assert sorted(r.predicted for r in out)[-2:] == [1, 1]


def test_licenses(spark, docs, empty):
    assert [(r.doc_id, r.license, r.dice) for r in licenses.scan(spark, docs).collect()] == [(7, "CC-BY-NC-4.0", 1.0)]
    assert licenses.scan(spark, empty).count() == 0


def test_lines(spark, docs, empty):
    rows = linedup.deduplicate_lines(spark, docs).collect()
    out = {r.doc_id: r for r in rows}
    assert out[7].text == "Licensed under CC BY-NC 4.0.\nsecond line of this short text" and out[7].lines_dropped == 1
    assert out[1].text is None and out[2].text == "" and out[6].text == ""
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["", ROWS[4][1]] and out[None].text == ROWS[7][1]
    assert linedup.deduplicate_lines(spark, empty).count() == 0


def test_simhash(spark, docs, empty):
    out = simhash.duplicates(spark, docs).collect()
    assert len(out) == len(ROWS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1) and got[6][1] == 5
    assert simhash.duplicates(spark, empty).count() == 0
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, docs).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, []), (6, [0.25, 0.25]), (None, [1.0, 1.0]), (6, [0.25, 0.25]), (7, [-1.0, 0.0])]
    out = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(1, 1, 1024 * 1024 + 512 * 512), (2, 6, 1024 * 256 + 512 * 256), (3, 6, 1024 * 256 + 512 * 256)]
    assert topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "you are a pathetic loser and an idiot"), (2, None), (3, ""), (None, "x"), (4, "single")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.equal_tokens) for r in decontaminate.overlaps(spark, docs, bench).collect()) == [(5, 1, 8), (5, 1, 8), (6, 1, 8), (8, 4, 1)]  # an item of few tokens is found where it is the whole text
    assert decontaminate.overlaps(spark, empty, bench).count() == 0 and decontaminate.overlaps(spark, docs, bench.limit(0)).count() == 0


def test_token_counts(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = {r.doc_id: r for r in tokencount.token_counts(docs, path).collect()}
    assert out[1].n_tokens == out[1].n_bytes == out[2].n_tokens == 0 and out[4].over_limit and len(out) == 9
    assert tokencount.token_counts(empty, path).count() == 0


def test_mix(spark, docs, empty):
    out = mixing.mix(spark, docs, block_docs=2).collect()
    assert sorted(r.position for r in out) == list(range(len(ROWS)))
    assert mixing.mix(spark, empty).count() == 0


def test_token_caches_smaller_than_a_text(spark, monkeypatch):
    """Texts of more distinct words than the caches hold give what the library gives."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "CACHE_CHUNKS", 100)
    monkeypatch.setattr(tokenfile, "CACHE_CHUNKS", 100)
    texts = [" ".join(f"word{k}x{k * k} and{k}" for k in range(10_000)), None, "a few more words", " ".join(f"word{k}" for k in range(0, 20_000, 3))]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    counter = tokencount.TokenCounter(path)
    assert counter.count(texts) == want and [counter.count([t])[0] for t in texts] == want
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    encoder = tokenfile.Encoder(path)
    assert list(encoder.encode(texts, 1)) == want and [b for t in texts for b in encoder.encode([t], 1)] == want


def test_token_files_of_null_and_shared_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate([None, -1, None, *[7] * 40, -5, 1 << 60])], "doc_id long, text string")
    out = sorted(tokenfile.token_files(spark, docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, None, -5, -1, *[7] * 40, 1 << 60]
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    files = tokenfile.write_tokens(spark, docs, path, "file:///tmp/" + uuid.uuid4().hex)
    assert len(files) > 2  # the id that most rows share stands in several files
    first = tokenfile.Reader(files[0][0])
    assert first.nulls == 2 and first.find(-5) and not first.find(0)


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = sorted(tokenfile.token_files(spark, docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))] and out[1].n_tokens == 1
    assert tokenfile.token_files(spark, empty, path).count() == 0


def test_shards(spark, docs, empty):
    out = sharding.shards(spark, docs, 3).collect()
    assert len(out) == len(ROWS)
    by_text = {}
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert sharding.shards(spark, empty, 3).count() == 0
