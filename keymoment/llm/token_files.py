"""Operator 9: token ids in files of patched frame-of-reference blocks.

Documents are dealt to tasks by ranges of doc_id and sorted, so the files in order of their first doc_id hold all ids
in ascending doc_id order. A file is a stream of blocks of BLOCK ids: the block's minimum is subtracted, the
differences are packed at the width that holds the PERCENTILE-th of them, and the larger ones (outliers) keep their
place and high bits in an exception list. Block starts and the documents' lengths are indexed at the file's end,
so a document is read by one index lookup and the blocks it covers.

File: blocks | uint64 block starts (blocks + 1) | int64 doc_ids | uint8 validity | uint32 lengths | footer of 40 bytes
(magic, ids, blocks, documents, place of the index). Block: uint32 minimum, uint8 width, uint8 0, uint16 exceptions,
packed words (uint64), uint16 places, uint32 high bits.

Ids come from the tokenizers library, which encodes each distinct word of a worker's texts once; texts in which
word by word encoding might differ from the library's (letters beyond Latin-1, special tokens' strings) go to it whole.

Defined cases: null or empty text is its end id alone; a null doc_id comes first; rows that repeat a doc_id are
neighbours, in order of their text; extra columns are ignored. A task writes under a new name and reports it in a
table that Spark commits, so a repeated or lost task leaves at most an unused file.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .store import new_path, open_fs, written

BLOCK, PERCENTILE, END_ID = 1024, 90, 1
WORDS_KEPT = 1_200_000
_MAGIC = b"PFORIDS1"

#: Fixed by the tokenizer's definition; only for texts without _ODD characters, for which NFC changes nothing.
#: Letters come first, being most frequent; no two alternatives but the last two begin alike.
_WORDS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\t-\\r \x85\xa00-9a-zªµºß-öø-ÿ]+")
_ODD = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]|<\|")


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy with room for n values; room doubles, so growing by small steps copies each value a few times only."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class WordEncoder:
    """The library's ids of texts, with the ids of words kept between texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # of ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n_words = self.n_ids = 0

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of words: the library gets them as one text, in which each ends with an id that ends a word."""
        parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([" ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)], add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            ids = np.array([i for x in found for i in x], np.uint32)
            ends = np.cumsum([len(x) for x in found])
        n, m = self.n_words + len(ends), self.n_ids + len(ids)
        self.start, self.size, self.ids = _room(self.start, n), _room(self.size, n), _room(self.ids, m)
        self.size[self.n_words : n] = np.diff(ends, prepend=0)
        self.start[self.n_words : n] = self.n_ids + ends - self.size[self.n_words : n]
        self.ids[self.n_ids : m] = ids
        self.n_words, self.n_ids = n, m

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids end to end)."""
        if len(self.index) > WORDS_KEPT:
            self._forget()
        index, own, whole, new = self.index, [], {}, []
        for k, x in enumerate(texts):
            if _ODD.search(x):
                whole[k] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32)
                own.append(np.zeros(0, np.int64))
                continue
            words = _WORDS.findall(x.lower())
            at = list(map(index.get, words))
            if None in at:
                for i, a in enumerate(at):
                    if a is None:
                        w = words[i]
                        if w not in index:
                            index[w] = len(index)
                            new.append(w)
                        at[i] = index[w]
            own.append(np.array(at, np.int64))
        if new:
            self._learn(new)
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        n = self.size[flat]
        ends = np.cumsum(n)
        at = np.repeat(self.start[flat] - (ends - n), n)
        at += np.arange(len(at))
        ids = self.ids[at]
        counts = np.diff(np.concatenate([[0], ends])[np.cumsum([0, *map(len, own)])])
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in whole.items():
                parts[k], counts[k] = x, len(x)
            ids = np.concatenate(parts)
        return counts, ids


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack_blocks(ids: np.ndarray, size: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of ids (uint32); the last may be short and is padded with its minimum."""
    if not len(ids):
        return []
    n = -(-len(ids) // size)
    v = np.empty(n * size, np.uint32)
    v[: len(ids)] = ids
    v[len(ids) :] = ids[(n - 1) * size :].min()
    v = v.reshape(n, size)
    low = v.min(1)
    v = v - low[:, None]
    cut = np.partition(v, size * percentile // 100, axis=1)[:, size * percentile // 100]
    width = np.ceil(np.log2(cut.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for b in np.unique(width).tolist():
        rows = np.flatnonzero(width == b)
        own = v[rows]
        over = (own >> np.uint32(b)) if b < 32 else np.zeros_like(own)
        words = np.zeros((len(rows), size // 64, b), np.uint64)
        small = (own & np.uint32((1 << b) - 1)).astype(np.uint64).reshape(len(rows), size // 64, 64)
        for i in range(64 if b else 0):
            k, s = divmod(i * b, 64)
            words[:, :, k] |= small[:, :, i] << np.uint64(s)
            if s + b > 64:
                words[:, :, k + 1] |= small[:, :, i] >> np.uint64(64 - s)
        r, c = np.nonzero(over)
        high = over[r, c].astype("<u4")
        cuts = np.searchsorted(r, np.arange(len(rows) + 1))
        c = c.astype("<u2")
        for j, row in enumerate(rows.tolist()):
            a, e = cuts[j], cuts[j + 1]
            out[row] = struct.pack("<IBBH", low[row], b, 0, e - a) + words[j].tobytes() + c[a:e].tobytes() + high[a:e].tobytes()
    return out


def unpack_blocks(data: bytes | memoryview, starts: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The ids (uint32) of the blocks that begin at starts[:-1] in data; starts has the end as well."""
    n = len(starts) - 1
    raw = np.frombuffer(data, np.uint8)
    out = np.empty((n, size), np.uint32)
    heads = [struct.unpack_from("<IBBH", data, s) for s in starts[:-1].tolist()]
    width = np.array([h[1] for h in heads])
    for b in np.unique(width).tolist():
        rows = np.flatnonzero(width == b)
        nbytes = size // 8 * b
        own = np.zeros((len(rows), size // 64, 64), np.uint64)
        if b:
            at = starts[rows].astype(np.int64)[:, None] + 8 + np.arange(nbytes)
            words = np.ascontiguousarray(raw[at]).view("<u8").reshape(len(rows), size // 64, b)
            mask = np.uint64((1 << b) - 1)
            for i in range(64):
                k, s = divmod(i * b, 64)
                x = words[:, :, k] >> np.uint64(s)
                if s + b > 64:
                    x = x | words[:, :, k + 1] << np.uint64(64 - s)
                own[:, :, i] = x & mask
        out[rows] = own.reshape(len(rows), size)
    for j, (low, b, _, e) in enumerate(heads):
        if e:
            a = int(starts[j]) + 8 + size // 8 * b
            places = np.frombuffer(data, "<u2", e, a)
            out[j, places] |= np.frombuffer(data, "<u4", e, a + 2 * e) << np.uint32(b)
        out[j] += np.uint32(low)
    return out.reshape(-1)


class Writer:
    """Writes one file; ids of any number of documents are added in order."""

    def __init__(self, stream, block: int = BLOCK):
        self.f, self.block = stream, block
        self.held, self.n_held, self.at, self.total = [], 0, 0, 0
        self.starts, self.doc_ids, self.lengths = [0], [], []

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.extend(doc_ids)
        self.lengths.append(counts.astype("<u4"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= 64 * self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            self._blocks(ids[:whole])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        for x in pack_blocks(ids, self.block):
            self.f.write(x)
            self.at += len(x)
            self.starts.append(self.at)

    def close(self) -> None:
        if self.n_held:
            self._blocks(np.concatenate(self.held))
        ok = np.array([d is not None for d in self.doc_ids], np.uint8)
        self.f.write(np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + ok.tobytes() + (np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<u4")).tobytes())
        self.f.write(_MAGIC + struct.pack("<QQQQ", self.total, len(self.starts) - 1, len(self.doc_ids), self.at))


class Reader:
    """Reads a file of Writer's through its index."""

    def __init__(self, file, block: int = BLOCK):
        self.f, self.block = file, block
        size = file.size()
        foot = file.read_at(40, size - 40)
        if foot[:8] != _MAGIC:
            raise ValueError("not a file of token ids")
        self.total, blocks, docs, at = struct.unpack("<QQQQ", foot[8:])
        index = file.read_at(size - 40 - at, at)
        self.starts = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        ok = np.frombuffer(index, "<u1", docs, at + 8 * docs)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(index, "<i8", docs, at).tolist(), ok.tolist(), strict=True)]
        self.lengths = np.frombuffer(index, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.ends = np.cumsum(self.lengths)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file."""
        if b <= a:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        starts = self.starts[i : j + 1]
        data = self.f.read_at(int(starts[-1] - starts[0]), int(starts[0]))
        return unpack_blocks(data, starts - starts[0], self.block)[a - i * self.block : b - i * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end, ids) of groups of documents with about so many ids."""
        i, n = 0, len(self.lengths)
        while i < n:
            base = int(self.ends[i] - self.lengths[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + most, "right")))
            yield i, j, self.ids(base, int(self.ends[j - 1]))
            i = j


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of docs(doc_id, text) and returns the committed table of files: file, first, first_text, documents, ids."""
    folder = folder or new_path(docs.sparkSession, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, first = word_encoder(path), None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(a, 256).to_pylist(), batch.column(1).slice(a, 256).to_pylist()
                if out is None:
                    fs, where = open_fs(folder)
                    fs.create_dir(where, recursive=True)
                    name = f"ids-{uuid.uuid4().hex}.pfor"
                    stream = fs.open_output_stream(f"{where}/{name}")
                    out, first = Writer(stream), ids[0]
                counts, flat = encoder.encode([x or "" for x in texts])
                places = np.cumsum(counts)
                flat = np.insert(flat, places, np.uint32(end_id))
                out.add(ids, counts + 1, flat)
        if out:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([len(out.doc_ids)], pa.int64()), pa.array([out.total], pa.int64())], names=["file", "first", "documents", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(lean(run), "file string, first long, documents long, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = files.sparkSession
    at, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: (r["first"] is not None, r["first"] or 0)):  # a row for each file, not for documents
        rows.append((r["file"], at))
        at += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = open_fs(uri)
                with fs.open_input_file(where) as f:
                    r = Reader(f)
                    for i, j, ids in r.documents():
                        n = r.lengths[i:j]
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
                        crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[i:j], pa.int64()), pa.array(base + r.ends[i:j] - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "file string, base long")
    if len(rows) > 1:
        table = table.repartitionByRange(len(rows), "base")
    return table.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
