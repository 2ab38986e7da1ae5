"""Token counts of whole texts under a byte-level BPE vocabulary.

Texts are cut into chunks at single spaces, chunks into pre-tokens by the vocabulary's pattern. Unseen
pre-tokens are merged together as one ragged array of symbols: in every round each sequence finds its
lowest-rank adjacent pair and replaces all its occurrences at once, until no sequence has a mergeable
pair left. What survives is the count.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.runtime import text_slices

#: The split pattern of byte-level BPE vocabularies (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and pre-tokens kept from one slice of texts to the next; beyond, the cache starts anew.
CACHE_CHUNKS = 1_000_000
#: Symbols merged in one ragged array (a single longer pre-token is merged alone).
BATCH_SYMBOLS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class ByteMerges:
    """Merge table of a vocabulary: sorted pair keys with rank (their order) and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for char, b in byte_alphabet().items():
            self.first[b] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or a number above all ranks."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], len(self.key))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word, all words merged rank-synchronously."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out = sizes.copy()
        none = len(self.key)
        rank = np.full(len(symbols), none, np.int64)
        if len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            alive = np.repeat(lowest < none, lengths)
            done = lowest >= none
            out[owner[starts[done]]] = lengths[done]
            symbols, owner, rank = symbols[alive], owner[alive], rank[alive]
            if not len(symbols):
                break
            best = np.repeat(lowest[~done], lengths[~done])
            hit = rank == best
            # Of overlapping occurrences (aaa), the first, third, ... of each run are merged.
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            symbols[at] = self.merged[best[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            stale = np.zeros(len(symbols), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            symbols, owner, rank, stale = symbols[~gone], owner[~gone], rank[~gone], stale[~gone]
            # A merged-away neighbour moves staleness to the symbol before it.
            fix = np.flatnonzero(stale)
            last = fix == len(symbols) - 1
            inner = fix[~last]
            rank[fix] = none
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        return out


class TokenCounter:
    """Counts tokens of texts; holds the chunk cache of one worker."""

    def __init__(self, path: str):
        self.merges = ByteMerges(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        # A space after a non-space always opens a token, so chunks can be counted apart.
        self.cut = regex.compile(r"(?<=\S)(?= )")
        self.odd = regex.compile(r"\s ")
        self.known: dict[str, int] = {}

    def _split(self, text: str) -> list[str]:
        if self.odd.search(text):
            return self.cut.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def _learn(self, unseen: set[str]) -> None:
        # A chunk of letters only, with or without its space, is one pre-token; so both share the cache.
        whole = [c for c in unseen if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) or len(c) == 1]
        found = {chunk: self.pattern.findall(chunk) for chunk in unseen.difference(whole)}
        fresh = list({w for words in found.values() for w in words}.union(whole) - self.known.keys())
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        start = size = 0
        for i, w in enumerate(raw):
            size += len(w)
            if size >= BATCH_SYMBOLS or i == len(raw) - 1:
                self.known.update(zip(fresh[start : i + 1], self.merges.count(raw[start : i + 1]).tolist(), strict=True))
                start, size = i + 1, 0
        get = self.known.__getitem__
        self.known.update([(c, sum(map(get, words))) for c, words in found.items()])

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null text counts as empty."""
        cut: list[tuple[int, list[str]]] = []
        for text in texts:
            extra, parts = 0, [text or ""]
            if self.special and self.special.search(parts[0]):
                parts = self.special.split(parts[0])
                extra = len(parts) - 1
            cut.append((extra, [c for p in parts if p for c in self._split(p)]))
        needed = {c for _, chunks in cut for c in chunks}
        if len(self.known) > CACHE_CHUNKS:  # emptied between slices only, so all that a slice needs is there
            self.known.clear()
        self._learn(needed - self.known.keys())
        get = self.known.__getitem__
        return [extra + sum(map(get, chunks)) for extra, chunks in cut]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row; map-only, no shuffle.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows give repeated results. ``vocabulary``
    is a path that every executor can read. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                counter = TokenCounter(vocabulary)
                gc.disable()  # the caches hold no cycles, and scanning them costs more than the merging
            tokens: list[int] = []
            for _, texts in text_slices(batch, "text"):
                tokens += counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
