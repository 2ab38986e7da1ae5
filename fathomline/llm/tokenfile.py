"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, one for each document (its ids as little-endian
unsigned 32-bit integers), a skippable frame with the document ids (first how many of them are null; those
come first), and a trailing skippable frame with the seek table: compressed size, plain size and checksum (low half of XXH64) of every frame before it,
then their number, a descriptor and a magic number. Readers find a document in the table and decompress
its frame alone.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.runtime import Workspace, settle_gc, text_slices, worker_memory

# Fixed values of the seekable format.
TABLE_MAGIC, FOOTER_MAGIC, IDS_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80
#: Chunks of text whose ids a worker remembers from one slice of texts to the next; beyond, it starts anew.
CACHE_CHUNKS = 800_000
#: Signs that make one piece before or behind a word (an apostrophe can open a piece with the letters behind it).
_SIGNS = string.punctuation.replace("'", "")


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _is_word(chunk: str) -> bool:
    """Letters only, and still so after the vocabulary's normalisation."""
    return chunk.isalpha() and (chunk.isascii() or (chunk.lower().isalpha() and unicodedata.is_normalized("NFC", chunk)))


class Encoder:
    """Ids of texts as bytes. Chunks between single spaces or line ends are encoded by the library once.

    The vocabulary lower-cases, drops white space and starts a new piece wherever a run of letters or of signs
    ends, so chunks, and a word and the signs around it, can be encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that its normalisation leaves as they are and its cuts leave whole, the same merges without these steps.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The worker's encoder, kept from task to task."""
        held = worker_memory()
        if ("encoder", path) not in held:
            held["encoder", path] = cls(path)
        return held["encoder", path]

    def _words(self, words: list[str], tokenizer) -> None:
        """Words of letters only: one piece each, whose last token is marked as a word's end."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):
                self._others(part)
                continue
            data = ids.tobytes()
            self.known.update(zip(part, [data[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _others(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 2000):
            part = chunks[i : i + 2000]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, unseen: set[str]) -> None:
        words, others, made, cased = set(), set(), [], []
        for chunk in unseen:
            if chunk.isalpha() and chunk.isascii():  # most chunks
                if chunk.islower():
                    words.add(chunk)
                else:
                    cased.append(chunk)
                continue
            front = chunk.rstrip(_SIGNS)
            word = front.lstrip(_SIGNS)
            if not _is_word(word):
                others.add(chunk)
                continue
            head, tail = chunk[: len(front) - len(word)], chunk[len(front) :]
            if head and any(s in chunk for s in self.special):
                others.add(chunk)
                continue
            word = word.lower() if word.isascii() else word
            words.add(word)
            if word != chunk:
                others.update((head, tail))
                made.append((chunk, head, word, tail))
        lowered = [c.lower() for c in cased]
        words.update(lowered)
        fresh = words.difference(self.known)
        plain = [w for w in fresh if w.isascii()]
        self._words(plain, self.plain)
        if len(plain) < len(fresh):
            self._words([w for w in fresh if not w.isascii()], self.tokenizer)
        self._others([c for c in others if c not in self.known])
        get = self.known.__getitem__
        self.known.update(zip(cased, map(get, lowered), strict=True))
        self.known.update([(chunk, get(head) + get(word) + get(tail)) for chunk, head, word, tail in made])

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[bytes]:
        end = struct.pack("<I", end_id)
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_CHUNKS:  # emptied between slices only, so all that a slice needs is there
            self.known.clear()
        found = [list(map(self.known.get, chunks)) for chunks in cut]
        gaps = [[i for i, data in enumerate(parts) if data is None] for parts in found]
        if unseen := {chunks[i] for chunks, gap in zip(cut, gaps, strict=True) for i in gap}:
            self._learn(unseen)
        for chunks, parts, gap in zip(cut, found, gaps, strict=True):
            for i in gap:
                parts[i] = self.known[chunks[i]]
            yield b"".join(parts) + end


class Writer:
    """Appends frames to an open stream and closes it with the table."""

    def __init__(self, stream):
        self.stream, self.entries, self.ids = stream, [], []
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(data), _checksum(data)))
        self.ids.append(doc_id)

    def close(self) -> None:
        nulls = self.ids.count(None)
        ids = np.array([nulls, *(0 for _ in range(nulls)), *self.ids[nulls:]], "<i8").tobytes()
        self.stream.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        self.entries.append(struct.pack("<III", 8 + len(ids), 0, _checksum(b"")))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to a file by place or document id."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        begin = size - 9 - 12 * count
        head, length = struct.unpack("<II", self.file.read_at(8, begin - 8))
        if head != TABLE_MAGIC or length != 12 * count + 9:
            raise ValueError(f"{uri} has a damaged seek table")
        table = np.frombuffer(self.file.read_at(12 * count, begin), "<u4").reshape(-1, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.table, self.starts = table[:-1], starts
        ids = np.frombuffer(self.file.read_at(int(table[-1, 0]) - 8, int(starts[-2]) + 8), "<i8")
        self.nulls, self.ids = int(ids[0]), ids[1:]
        self.plain = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def at(self, k: int, frame: bytes | None = None) -> bytes:
        """The ids of the k-th document as bytes; raises if they don't match their checksum."""
        frame = self.file.read_at(int(self.table[k, 0]), int(self.starts[k])) if frame is None else frame
        data = self.plain.decompress(frame, max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or _checksum(data) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int) -> list[int]:
        """Places of a document (ids ascend)."""
        known = self.ids[self.nulls :]
        return list(range(self.nulls + int(np.searchsorted(known, doc_id, "left")), self.nulls + int(np.searchsorted(known, doc_id, "right"))))

    def scan(self, most: int = 8_000_000) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read in runs of about ``most`` bytes."""
        k = 0
        while k < len(self):
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, "right")) - 1)
            stop = min(stop, len(self))
            run = self.file.read_at(int(self.starts[stop] - self.starts[k]), int(self.starts[k]))
            for i in range(k, stop):
                low = int(self.starts[i] - self.starts[k])
                yield None if i < self.nulls else int(self.ids[i]), self.at(i, run[low : low + int(self.table[i, 0])])
            k = stop

    def close(self) -> None:
        self.file.close()


def write_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Write files of ascending id ranges; returns (file, documents, ids) of each, in order.

    Null and empty texts hold the end id alone. Rows with a null id come first, rows that share an id in the
    order of the table; each row is written. A task that is run again writes a file of another name, and
    only the files named in the result count. An empty table gives no file. Other columns are ignored,
    whatever their names.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encoder, n_ids, name = None, None, 0, ""
        for batch in batches:
            if out is None:
                settle_gc()
                encoder = Encoder.of_worker(vocabulary)
                name = f"{folder}/tokens-{uuid.uuid4().hex}.zst"
                fs, path = pyarrow.fs.FileSystem.from_uri(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                stream = fs.open_output_stream(path, compression=None)
                out = Writer(stream)
            ids = batch.column("id").to_pylist()
            for start, texts in text_slices(batch, "text", 1_000_000):
                for i, data in zip(ids[start : start + len(texts)], encoder.encode(texts, end_id), strict=True):
                    out.add(i, data)
                    n_ids += len(data) // 4
        if out is not None:
            out.close()
            stream.close()
            if out.ids:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(out.ids)], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("n_ids", pa.int64())]))

    # Ranges over the id and the row's number, so that an id that many rows share is cut, too.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("nth"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "id", "nth").sortWithinPartitions("id", "nth")
    files = rows.select("id", "text").mapInArrow(run, "part int, file string, docs long, n_ids long")
    return [(r["file"], r["docs"], r["n_ids"]) for r in sorted(files.collect(), key=lambda r: r["part"])]  # a row for each file


def read_tokens(spark: SparkSession, files: Iterable[tuple[str, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, each frame checked."""
    rows, at = [], 0
    for name, _, n in files:
        rows.append((name, at))
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, held = Reader(name), []
                for doc_id, data in reader.scan():
                    held.append((doc_id, start, len(data) // 4, zlib.crc32(data)))
                    start += len(data) // 4
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)
                        held = []
                reader.close()
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)

    table = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents and read them back."""
    space = Workspace(spark, "tokens")
    return read_tokens(spark, write_tokens(spark, docs, vocabulary, space.path("files")))
