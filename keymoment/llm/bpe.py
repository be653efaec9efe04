"""Operator 3: byte-level BPE by a minimal acyclic transducer over frequent words.

Words of the whole corpus are counted; the most frequent LEXICON of them are compiled, with their token ids, into
a deterministic acyclic automaton whose equal suffixes are shared (incremental minimisation of sorted words). Arcs
carry additive outputs, so a word's path sums to its number, which indexes its token ids. The arrays lie in one file
in the shared folder that each worker maps into memory; its size is bounded by LEXICON, not by the corpus. Words that the automaton
doesn't accept are merged exactly, many at a time, by rank. LEXICON changes speed only, never a result.

The vocabulary is a tokenizers JSON file with the GPT-2 style ByteLevel pre-tokenizer, named by a path.

Defined cases: a null text counts as empty and gives no ids; strings of special tokens in a text become their ids, as
the library does by default; texts of any length are taken in pieces of PIECE characters' worth of documents (one long
document is one piece); repeated rows are encoded as they stand; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_count, runs, unpack
from .lean import lean
from .store import drop, new_path, open_fs, written
from .words import text_buffers

LEXICON = 200_000
PIECE = 2_000_000

#: Fixed by the pre-tokenizer's definition; the first form covers _PLAIN texts only, for which both agree.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_FAST = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\t-\\r \x85\xa00-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + k)] = b
    return out


class Vocabulary:
    """Merge ranks and byte strings of a tokenizers JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = regex.compile(_FULL)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.text = [b""] * size
        for t, i in vocab.items():
            self.text[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in self.special.items():
            self.text[i] = t.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, np.uint64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        keys = (left << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.new = keys[order], order.astype(np.int32), new.astype(np.uint32)
        self.pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def words(self, text: str) -> list[str]:
        return self.full.findall(text) if _NOT_PLAIN.search(text) else _FAST.findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_NONE = np.int32(2**31 - 1)
_PAD = np.uint32(0xFFFFFFFF)
_LONG = 48


def _merge_long(v: Vocabulary, word: bytes) -> list[int]:
    ids = v.of_byte[np.frombuffer(word, np.uint8)].tolist()
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < len(ids) and (r := v.pair.get((ids[i] << 32) | ids[j])) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        push(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j] = int(v.new[r]), False
        after[i] = after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tokens, token ids end to end) of words merged by rank, the leftmost lowest pair first."""
    size = np.array([len(w) for w in words], np.int64)
    out: list[np.ndarray | None] = [None] * len(words)
    counts = np.zeros(len(words), np.int64)
    flat, chunks = [], []
    order = np.argsort(size, kind="stable")
    short = order[: np.searchsorted(size[order], _LONG, "right")]
    for a in range(0, len(short), 20_000):
        rows = short[a : a + 20_000]
        chunks.append((rows, *_merge_matrix(v, [words[i] for i in rows.tolist()])))
    for i in order[len(short) :].tolist():
        out[i] = np.array(_merge_long(v, words[i]), np.uint32)
    for rows, n, ids in chunks:
        counts[rows] = n
        flat.append((rows, n, ids))
    for i in order[len(short) :].tolist():
        counts[i] = len(out[i])
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.uint32)
    for rows, n, own in flat:
        ids[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
    for i in order[len(short) :].tolist():
        ids[starts[i] : starts[i] + counts[i]] = out[i]
    return counts, ids


def _merge_matrix(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words])
    width = max(2, int(n.max()))
    column = np.arange(width)
    s = np.full((len(words), width), _PAD, np.uint32)
    s[column < n[:, None]] = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    r = v.rank(s[:, :-1], s[:, 1:])
    done, live = np.full_like(s, _PAD), np.arange(len(words))
    while len(live):
        j = r.argmin(1)
        low = r[np.arange(len(live)), j]
        ended = low == _NONE
        if ended.any():
            done[live[ended], : s.shape[1]] = s[ended]
            live, s, r, j, low = live[~ended], s[~ended], r[~ended], j[~ended], low[~ended]
            if not len(live):
                break
        rows = np.arange(len(live))
        tail = np.arange(s.shape[1] - 1)
        s[rows, j] = v.new[low]
        moved = s[:, 1:].copy()
        np.copyto(s[:, :-1], moved, where=tail > j[:, None])
        s[:, -1] = np.where(j < s.shape[1] - 1, _PAD, s[:, -1])
        if r.shape[1] > 1:
            later = r[:, 1:].copy()
            np.copyto(r[:, :-1], later, where=tail[:-1] >= j[:, None])
        r[:, -1] = _NONE
        for at in (j - 1, j):
            ok = (at >= 0) & (at < r.shape[1])
            r[rows[ok], at[ok]] = v.rank(s[rows[ok], at[ok]], s[rows[ok], at[ok] + 1])
    kept = done != _PAD
    return kept.sum(1), done[kept]


class Transducer:
    """Minimal acyclic automaton of byte strings; a string's outputs sum to its place in their order."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.target, self.output, self.final, self.root = keys, target, output, final, root

    @classmethod
    def of(cls, words: list[bytes]) -> Transducer:
        """words: sorted and distinct."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        final: list[bool] = []

        def frozen(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                final.append(key[0])
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        for w in words:
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            for i in range(len(last), k, -1):
                node = path.pop()
                path[-1][1].append((last[i - 1], frozen(node)))
            path.extend([False, []] for _ in range(len(w) - k))
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            node = path.pop()
            path[-1][1].append((last[i - 1], frozen(node)))
        root = frozen(path.pop())
        below = [0] * len(arcs)  # accepted strings from each state; states follow those they lead to
        keys, target, output = [], [], []
        for q, own in enumerate(arcs):
            n = int(final[q])
            for b, t in own:
                keys.append(q << 8 | b)
                target.append(t)
                output.append(n)
                n += below[t]
            below[q] = n
        return cls(np.array(keys, np.uint32), np.array(target, np.uint32), np.array(output, np.uint32), np.array(final, np.uint8), root)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, -1 for those that it doesn't accept."""
        n = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        sizes = n[order]
        state, total = np.full(len(words), self.root, np.uint32), np.zeros(len(words), np.int64)
        rows, k = order[sizes > 0], 0
        while len(rows):
            key = (state[rows] << np.uint32(8)) | data[start[rows] + k]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            rows, at = rows[ok], at[ok]
            state[rows] = self.target[at]
            total[rows] += self.output[at]
            k += 1
            ended = n[rows] == k
            last = rows[ended]
            last = last[self.final[state[last]] == 1]
            out[last] = total[last]
            rows = rows[~ended]
        return out


_PARTS = (("keys", "<u4"), ("target", "<u4"), ("output", "<u4"), ("final", "<u1"), ("starts", "<i8"), ("ids", "<u4"))


class Lexicon:
    """A transducer with the token ids of its words."""

    def __init__(self, machine: Transducer, starts: np.ndarray, ids: np.ndarray):
        self.machine, self.starts, self.ids = machine, starts, ids

    @classmethod
    def of(cls, v: Vocabulary, words: list[str]) -> Lexicon:
        raw = sorted({w.encode() for w in words if w})
        counts, ids = merge_words(v, raw)
        return cls(Transducer.of(raw), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), ids)

    def save(self, uri: str) -> None:
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = [getattr(self.machine, k, None) if hasattr(self.machine, k) else getattr(self, k) for k, _ in _PARTS]
        head = json.dumps({"root": self.machine.root, "sizes": [len(x) for x in own]}).encode().ljust(256)
        with fs.open_output_stream(path) as f:
            f.write(head)
            for x, (_, kind) in zip(own, _PARTS, strict=True):
                raw = np.ascontiguousarray(x, kind).tobytes()
                f.write(raw + b"\0" * (-len(raw) % 64))

    @classmethod
    def load(cls, uri: str) -> Lexicon:
        fs, path = open_fs(uri)
        from pyarrow.fs import LocalFileSystem

        data = pa.memory_map(path).read_buffer() if isinstance(fs, LocalFileSystem) else fs.open_input_file(path).read_buffer()
        head, at, own = json.loads(data[:256].to_pybytes()), 256, []
        for n, (_, kind) in zip(head["sizes"], _PARTS, strict=True):
            own.append(np.frombuffer(data, kind, n, at))
            size = n * np.dtype(kind).itemsize
            at += size + -size % 64
        return cls(Transducer(*own[:4], head["root"]), *own[4:])


@functools.lru_cache(maxsize=2)
def lexicon(uri: str) -> Lexicon:
    return Lexicon.load(uri)


def _pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    offsets, _ = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each pre-token occurs in docs(text)."""
    buckets = bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        v, found = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            groups: dict[int, list] = {}
            for w, n in found.items():
                raw = w.encode()
                groups.setdefault(zlib.crc32(raw) % buckets, []).append((raw, n))
            return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*((b"".join(r for r, _ in g), np.array([len(r) for r, _ in g], "<u4").tobytes(), np.array([n for _, n in g], "<u8").tobytes()) for g in groups.values()), strict=True))], names=["bucket", "words", "sizes", "counts"])

        for batch in batches:
            for x in batch.column(0):
                for part in v.split.split(x.as_py()) if v.split else [x.as_py()]:
                    if part not in v.special:
                        found.update(v.words(part))
                if len(found) > 400_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            total: Counter = Counter()
            for r in rows:
                raw, sizes = unpack([r], "words", "<u1").tobytes(), unpack([r], "sizes", "<u4")
                ends = np.cumsum(sizes).tolist()
                for a, b, n in zip([0, *ends[:-1]], ends, unpack([r], "counts", "<u8").tolist(), strict=True):
                    total[raw[a:b]] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    packed = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(lean(count), "bucket int, words binary, sizes binary, counts binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(add), "word string, n long")


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON) -> str:
    """The place of the compiled lexicon of docs' most frequent words: all words from a level of frequency on, as low as words allows."""
    counts = written(word_counts(docs, path).withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    least, total = 1 << 30, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundreds of levels
        total += r["count"]
        if total > words:
            break
        least = r["level"]
    top = counts.where(F.col("level") >= least).select("word").toPandas()["word"].tolist()
    drop(counts)
    uri = new_path(docs.sparkSession, "lexicon") + "/transducer.bin"
    Lexicon.of(vocabulary(path), top).save(uri)
    return uri


def encode_texts(v: Vocabulary, lex: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tokens, ids end to end) of texts."""
    index, own = _Numbers(), []
    get = index.__getitem__
    special: dict[int, int] = {}
    for x in texts:
        if v.split and v.split.search(x):
            at: list[int] = []
            for part in v.split.split(x):
                if part in v.special:
                    k = get("\0special" + part)
                    special[k] = v.special[part]
                    at.append(k)
                else:
                    at.extend(map(get, v.words(part)))
            own.append(np.array(at, np.int64))
        else:
            w = v.words(x)
            own.append(np.fromiter(map(get, w), np.int64, len(w)))
    words = [w.encode() for w in index]
    number = lex.machine.numbers(words)
    if special:
        number[list(special)] = -1
    size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    known = number >= 0
    start[known] = lex.starts[number[known]]
    size[known] = lex.starts[number[known] + 1] - start[known]
    rest = [i for i in np.flatnonzero(~known).tolist() if i not in special]
    counts, ids = merge_words(v, [words[i] for i in rest])
    size[rest], start[rest] = counts, len(lex.ids) + np.cumsum(counts) - counts
    for k, (i, token) in enumerate(special.items()):
        size[i], start[i] = 1, len(lex.ids) + len(ids) + k
    pool = np.concatenate([lex.ids, ids, np.array(list(special.values()), np.uint32)])
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    n = size[flat]
    ends = np.cumsum(n)
    at = np.repeat(start[flat] - (ends - n), n)
    at += np.arange(len(at))
    word_ends = np.cumsum([len(x) for x in own])
    ends = np.concatenate([[0], ends])[word_ends] if len(own) else np.zeros(0, np.int64)
    return np.diff(ends, prepend=0), pool[at]


def _binary(counts: np.ndarray, raw: bytes, width: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, lexicon_uri: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): ids are little-endian unsigned 32-bit integers in a binary column."""
    uri = lexicon_uri or build_lexicon(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lex = vocabulary(path), lexicon(uri)
        for batch in batches:
            texts = batch.column(1)
            for i, j in _pieces(texts):
                counts, ids = encode_texts(v, lex, [x or "" for x in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(counts, ids.astype("<u4").tobytes(), 4)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, ids binary")


class Decoder:
    """Bytes of ids by table lookups."""

    def __init__(self, v: Vocabulary):
        self.size = np.array([len(x) for x in v.text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(v.text), np.uint8)

    def __call__(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of rows with so many ids each; bytes that aren't UTF-8 become U+FFFD."""
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[ids] - ends[:-1], n)
        at += np.arange(len(at))
        raw = self.blob[at].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        try:
            raw.decode()
            text = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).cast(pa.string())
            text.validate(full=True)
            return text
        except (UnicodeDecodeError, pa.ArrowInvalid):
            return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of encoded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(path))
        for batch in batches:
            column = batch.column(1)
            for i, j in _pieces(column, PIECE * 2):
                offsets, data = text_buffers(column.slice(i, j - i))
                ids = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column.slice(i, j - i), decoder(np.diff(offsets) // 4, ids)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids binary, decoded string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)) in one task, so that ids pass between processes once and in small pieces."""
    uri = build_lexicon(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lex = vocabulary(path), lexicon(uri)
        decoder = Decoder(v)
        for batch in batches:
            texts = batch.column(1)
            for i, j in _pieces(texts):
                counts, ids = encode_texts(v, lex, [x or "" for x in texts.slice(i, j - i).to_pylist()])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(counts, raw, 4), decoder(counts, np.frombuffer(raw, "<u4"))], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    both = encode_decode(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
