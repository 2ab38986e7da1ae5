"""Cases in which an operator once did less than the whole job."""

import itertools
from fractions import Fraction

import numpy as np
from conftest import DATA

from fathomline.llm import decontaminate, licenses, mixing, simhash


def test_decontamination_finds_every_stretch_of_a_diagonal(spark):
    rng = np.random.default_rng(3)
    cases = [np.r_[np.ones(15), np.zeros(8), np.ones(15)], np.r_[np.ones(20), np.zeros(11), np.ones(20)]]
    cases += [np.r_[np.ones(25), rng.random(100) >= 0.3] for _ in range(40)] + [rng.random(rng.integers(1, 60)) < rng.uniform(0, 1) for _ in range(200)]
    for same in (c.astype(bool) for c in cases):
        upto = np.concatenate([[0], np.cumsum(same)])
        good = [(int(upto[j] - upto[i]), i - j) for j in range(len(upto)) for i in range(j) if upto[j] - upto[i] >= 0.8 * (j - i) - 1e-9]
        start, stop, equal = decontaminate.best_stretch(same, 0.8)
        assert (equal, start - stop) == max(good, default=(0, 0))
        assert equal == same[start:stop].sum()
    items = [(k, [f"i{k}t{n}" for n in range(len(c))]) for k, c in enumerate(cases[:6])]
    texts = [(k, " ".join(w if kept else f"other{n}" for n, (w, kept) in enumerate(zip(words, cases[k], strict=True)))) for k, words in items]
    bench = spark.createDataFrame([(k, " ".join(words)) for k, words in items], "item_id long, text string")
    out = decontaminate.overlaps(spark, spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(k, k) for k, _ in items}
    assert all(r.equal_tokens >= 12 and r.equal_tokens >= 0.8 * r.length for r in out)


def test_masks_hit_all_that_counts():
    """Every way to leave 12 equal tokens, four in five, of up to 20, and the share an item of 5 to 11 tokens needs."""
    for masks, lengths, needed in ((decontaminate.MASKS, range(12, 21), lambda n: max(12, -(-n * 4 // 5))), (decontaminate.SHORT_MASKS, range(5, 12), lambda n: max(5, -(-n * 4 // 5)))):
        bits = [(sum(1 << k for k, c in enumerate(m) if c == "1"), len(m)) for m in masks]
        for n in lengths:
            for gone in itertools.combinations(range(n), n - needed(n)):
                same = (1 << n) - 1 - sum(1 << k for k in gone)
                assert any((same >> p) & b == b for b, span in bits for p in range(n - span + 1)), (n, gone)


def test_decontamination_equals_all_diagonals(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    short = [(9001, "one two three four five"), (9002, "some words of seven that stand here"), (9003, "two words")]
    rng = np.random.default_rng(9)
    made = [(9100, "x one two three four five y"), (9101, "some words of seven that stood here"), (9102, "two words"), (9103, "two words more")]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()
    long = decontaminate.tokens_of(bench[0].text)
    made += [(9200 + k, " ".join(w if x else f"q{k}" for w, x in zip(long, rng.random(len(long)) < 0.82, strict=True))) for k in range(30)]
    rows = [tuple(r) for r in docs.collect()] + made + [(9300, None), (9301, "")]
    items = [tuple(r) for r in bench] + short
    words = {w: n for n, w in enumerate({w for _, t in rows + items for w in decontaminate.tokens_of(t)})}
    code = lambda t: np.array([words[w] for w in decontaminate.tokens_of(t)], int)
    texts, wanted = [(i, code(t)) for i, t in rows], set()
    for item, w in ((i, code(t)) for i, t in items):
        needed = decontaminate._needed(len(w), 12, 0.8)
        for doc, t in texts:
            if len(np.intersect1d(w, t)) < min(needed, 3) or (len(w) < 5 and len(w) != len(t)):
                continue
            best = 0
            for d in range(-len(w) + 1, len(t)):
                a, b = max(0, -d), min(len(w), len(t) - d)
                same = t[a + d : b + d] == w[a:b]
                if same.sum() >= needed:
                    best = max(best, decontaminate.best_stretch(same, 0.8)[2])
            if best >= needed:
                wanted.add((doc, item, best))
    out = decontaminate.overlaps(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.equal_tokens) for r in out.collect()} == wanted
    assert {(d, i) for d, i, _ in wanted if i > 9000} == {(9100, 9001), (9101, 9002), (9102, 9003)} and len(wanted) > 20


def test_mix_keeps_to_weights_that_no_period_holds(spark):
    names = [f"s{k:02}" for k in range(20)]
    weights = {s: 0.333 if k == 0 else (1.0 + k) ** 0.7 * 0.01 for k, s in enumerate(names)} | {"s19": 0.0001}
    total = sum(map(Fraction, weights.values()))
    blocks = {s: int(60_000 * Fraction(w) / total) + 2 for s, w in weights.items()}
    slots = {}
    rows = mixing.schedule(blocks, weights)
    for s in names:
        own = [r for r in rows if r[0] == s]
        for k, (_, first, slot, per, period, places) in enumerate(own):
            for b in range(first, own[k + 1][1] if k + 1 < len(own) else blocks[s]):
                slots[slot + (b - first) // per * period + places[(b - first) % per]] = (s, b)
    assert sorted(slots) == list(range(sum(blocks.values())))
    share = [(s, float(Fraction(w) / total)) for s, w in weights.items()]
    seen = dict.fromkeys(names, 0)
    for t in range(60_000):  # while all last
        s, block = slots[t]
        assert block == seen[s]
        seen[s] += 1
        if t % 17 == 0:
            assert all(abs(seen[s] - w * (t + 1)) < 1 for s, w in share)


def test_mix_places_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SLOTS", 50)
    counts = {"a": 333, "b": 701, None: 95, "None": 58}
    names = [s for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id long, source string")
    for most in (10, 50_000):  # joined by shuffle, then broadcast
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        monkeypatch.setattr("fathomline.llm.runtime.BROADCAST_ROWS", most)
        out = sorted(mixing.mix(spark, docs, block_docs=4).collect(), key=lambda r: r.position)
        assert [r.position for r in out] == list(range(len(names))) and {r.doc_id for r in out} == set(range(len(names)))
        assert all((a.slot, a.source) == (b.slot, b.source) or a.slot < b.slot for a, b in zip(out, out[1:], strict=False))
        rows = mixing.schedule({s: -(-n // 4) for s, n in sorted(counts.items(), key=lambda x: (x[0] is not None, x[0]))}, mixing.tempered(dict(sorted(counts.items(), key=lambda x: (x[0] is not None, x[0]))), 0.7))
        assert {(r.source, r.block, r.slot) for r in out} == {(s, first + n, slot + p) for s, first, slot, _, _, places in rows for n, p in enumerate(places)}


def test_near_copies_that_differ_in_how_often_a_line_repeats(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        words, line = [f"w{x}" for x in rng.integers(0, 10**6, 150)], " ".join(f"l{x}" for x in rng.integers(0, 10**6, 8))
        other = list(words)
        other[int(rng.integers(5, 145))] = "changed"
        rows += [(2 * g, " ".join(words) + "\n" + "\n".join([line] * 20)), (2 * g + 1, " ".join(other) + "\n" + line)]
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        x, y = ({int(h) for h in simhash.shingle_hashes(t, 5)} for _, t in (a, b))
        assert len(x & y) >= 0.8 * len(x | y)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_licenses_in_a_line_that_repeats_its_notice(spark):
    docs = spark.createDataFrame([(1, " ".join(["Released under the MIT License."] * 30)), (2, " ".join(f"w{k}" for k in range(300)))], "doc_id long, text string")
    assert [(r.doc_id, r.license, round(r.dice, 3)) for r in licenses.scan(spark, docs).collect()] == [(1, "MIT", 0.889)]


def test_licenses_named_by_their_own_header_or_tag(spark):
    head = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = {"GPL-2.0": head.format("General", "2"), "GPL-3.0": head.format("General", "3"), "LGPL-2.1": head.format("Lesser General", "2.1"), "LGPL-3.0": head.format("Lesser General", "3"), "AGPL-3.0": head.format("Affero General", "3"), "MIT": "# SPDX-License-Identifier: MIT"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id string, text string")
    assert {r.doc_id: r.license for r in licenses.scan(spark, docs).collect()} == {name: name for name in rows}
