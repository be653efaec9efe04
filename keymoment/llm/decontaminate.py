"""Operator 1: benchmark decontamination by templates.

Texts become sequences of canonical tokens: numbers (digits or number words), names (capitalised words but those in OPENERS) and
units after a number are typed placeholders; neighbouring parts of a number, and names of one sentence with nothing but a blank or hyphen
between them, are one; other words stand for themselves in lower case. Windows of WINDOW tokens with MIN_LITERALS words
or more are hashed; documents' windows meet the benchmark's in a hash join, and matches on a diagonal (document place minus item place)
are put together. On a diagonal, an item's slot values and the document's must map one to one (a changed question changes a number
everywhere, and different numbers to different ones); diagonals that don't are left out. What of an item lies in no window with
MIN_LITERALS words is compared word by word instead, names and numbers included: windows of WINDOW words there are matched as they
stand, so verbatim copies of items dense in numbers or capitals are found, changed ones aren't.
A document leaks an item if COVER of the item's tokens (of its words, if some are compared word by word) are matched by what remains.

The benchmark's windows are a table in the shared folder, whatever its size; a sieve made of it (at most MOST_BITS bits, in
a file beside it) tells document windows that can match from those that can't, and only the former leave a task. So documents
are read once, nothing of the benchmark is held by the driver, and the join's strategy is Spark's choice by the table's size, with
hot windows split by adaptive execution where it sorts. Matches of a document and an item are put together in one row.

Defined cases: null or empty document or item texts match nothing; an item with fewer than MIN_LITERALS words can't be
told from chance and is left out; one shorter than WINDOW is a window of its own length; items that repeat an item_id are all compared, and
the row of the largest coverage counts (ties: the earliest place); a null item_id is no item; repeated documents are judged each, so their rows repeat in the result;
a null doc_id is judged and stays null; a text of any length is read whole, in pieces of words.PIECE bytes for its words;
extra columns are ignored or, by drop_leaks(), kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Packer, runs, unpack
from .lean import lean
from .store import fresh, new_path, open_fs, written
from .words import NOT_ALNUM, mix, powers, text_buffers, words_of

WINDOW, MIN_LITERALS, COVER = 8, 4, 0.5
#: The sieve has so many bits a window, up to MOST_BITS in all (more windows pass more in vain, the join stays exact), in PIECES parts.
BITS, MOST_BITS, PIECES = 64, 1 << 30, 64
#: Words that are units when a number stands before them.
UNITS = "% c cent cents centimeter centimeters cm day days degree degrees dollar dollars euro euros f feet foot ft g gallon gallons gb gram grams h hour hours hr inch inches j joule joules k kb kg kilogram kilograms kilometer kilometers km kmh kph kw l lb lbs liter liters litre litres m mb meter meters metre metres mg mile miles min minute minutes ml mm mole moles month months mph ms newton newtons ohm ohms ounce ounces oz pa percent pound pounds rad s sec second seconds ton tons v volt volts w watt watts week weeks yard yards yd year years".split()
#: Words that are numbers.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
#: Words that often open a sentence and are no names.
OPENERS = "a after all also an and another any as at because before both but by calculate can compute consider could determine did do does during each every evaluate explain express find first for from give given had has have he her his how i if in into is it its let many more most my no not of on once one or our out over prove select she should show simplify since so solve some state such suppose than that the their then there these they this those though to under until up use using was we were what when where whether which while who whom whose why will with without would write you your".split()
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # newline ! . : ?


def _hashes(words: list[str]) -> np.ndarray:
    offsets, data = text_buffers(pa.array([" ".join(words)]))
    return np.sort(next(words_of(offsets, data, breaks=NOT_ALNUM))[5])


def _among(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    return words[at] == h


_UNIT_WORDS, _NUMBER_WORDS, _OPENERS = _hashes([u for u in UNITS if u != "%"]), _hashes(NUMBERS), _hashes(OPENERS)


class Words(NamedTuple):
    """Words before they become tokens: offsets by row, hashes, starts, ends, and the first word of each token."""

    at: np.ndarray
    h: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keep: np.ndarray


def tokens_of(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]]:
    """(first row, end row, tokens' offsets by row, canonical tokens, values, starts, ends, words) of groups of rows; value is 0 for a literal."""
    if not len(data):
        data = np.zeros(1, np.uint8)
    for i, j, at, starts, ends, h in words_of(offsets, data, breaks=NOT_ALNUM):
        n = len(h)
        if not n:
            yield i, j, np.zeros(j - i + 1, np.int64), h, h, starts, ends, Words(at, h, starts, ends, np.zeros(0, np.int64))
            continue
        first = np.zeros(n + 1, bool)
        first[at[:-1]] = True
        first = first[:n]
        b = data[starts]
        digits, spelt = _DIGIT[b], _among(h, _NUMBER_WORDS)
        number = digits | spelt
        b2 = data[np.minimum(starts + 1, len(data) - 1)]
        capital = ((b >= 65) & (b <= 90)) | ((b == 0xC3) & (b2 >= 0x80) & (b2 <= 0x9E))
        a = int(offsets[i])
        stops = np.concatenate([[0], np.cumsum(_STOP[data[a : int(offsets[j])]])])
        before = np.concatenate([[0], ends[:-1]])
        begins = first | (stops[starts - a] > stops[np.maximum(before, a) - a])
        name = capital & ~spelt & ~_among(h, _OPENERS)
        after_number = np.concatenate([[False], number[:-1]]) & ~first
        unit = _among(h, _UNIT_WORDS) & after_number & ~number
        token = h.copy()
        token[number], token[name], token[unit] = _NUM, _NAME, _UNIT
        gap = starts - before
        sep = data[np.maximum(starts - 1, 0)]
        point, blank = (gap == 1) & ((sep == 46) | (sep == 44)), (gap == 1) & ((sep == 32) | (sep == 45))
        digits_before, spelt_before, name_before = (np.concatenate([[False], x[:-1]]) for x in (digits, spelt, name))
        joined = ((digits & digits_before & point) | (spelt & spelt_before & blank) | (name & name_before & blank & ~begins)) & ~first
        keep = np.flatnonzero(~joined)
        slot = (number | name | unit)[keep]
        part = np.arange(n) - keep[np.cumsum(~joined) - 1]  # place in its slot
        total = np.cumsum(np.where(part > 0, h * mix(part.astype(np.uint64)), h))  # of the parts of a joined slot
        last = np.concatenate([keep[1:], [n]]) - 1
        value = np.where(slot, mix(total[last] - total[keep] + h[keep]) | np.uint64(1), np.uint64(0))
        new_at = np.searchsorted(keep, at)
        yield i, j, new_at, token[keep], value, starts[keep], ends[last], Words(at, h, starts, ends, keep)


def windows(token: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-token windows, which of them have enough literals)."""
    m = len(token) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers(len(token) + 1)
    sums = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token) * up[: len(token)], out=sums[1:])
    literal = np.concatenate([[0], np.cumsum(value == 0)])
    h = mix((sums[n:] - sums[:m]) * down[:m] ^ np.uint64(n))
    return h, literal[n:] - literal[:m] >= min(MIN_LITERALS, n)


def _word_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, apart from those of tokens."""
    return mix(windows(h, np.zeros(len(h), np.uint64), n)[0] ^ np.uint64(0x6A09E667F3BCC909))


_INDEX = "h long, size int, kind int, place int, item_id long, t long"
_INDEX_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
_ITEMS = "item_id long, t long, data binary, parts binary, by_word boolean"


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, t, data, parts, by_word, windows) of items: the values of an item's tokens, their numbers of words, whether some are compared
    word by word, and its windows as an array of (h, size, kind, place); t tells texts of one item_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets, data = text_buffers(batch.column(2))
            for i, j, at, token, value, _, _, words in tokens_of(offsets, data):
                out = []
                for r in range(i, j):
                    a, b, c, d = at[r - i], at[r - i + 1], words.at[r - i], words.at[r - i + 1]
                    if d - c < MIN_LITERALS:
                        continue
                    parts = np.diff(np.concatenate([words.keep[a:b], [d]]))  # words of each token
                    seen, found = np.zeros(b - a, bool), []
                    if b - a >= MIN_LITERALS:
                        n = min(WINDOW, int(b - a))
                        x, ok = windows(token[a:b], value[a:b], n)
                        found.append((x[ok], n, 0, np.flatnonzero(ok)))
                        for p in np.flatnonzero(ok):
                            seen[p : p + n] = True
                    if not seen.all():
                        n = min(WINDOW, int(d - c))
                        left = np.concatenate([[0], np.cumsum(~np.repeat(seen, parts))])
                        ok = left[n:] > left[:-n]
                        found.append((_word_windows(words.h[c:d], n)[ok], n, 1, np.flatnonzero(ok)))
                    w = [{"h": h, "size": n, "kind": kind, "place": p} for x, n, kind, places in found for h, p in zip(x.view(np.int64).tolist(), places.tolist(), strict=True)]
                    out.append({"item_id": ids[r], "t": keys[r], "data": value[a:b].tobytes(), "parts": parts.astype("<i4").tobytes(), "by_word": not bool(seen.all()), "windows": w})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    window = pa.struct([("h", pa.int64()), ("size", pa.int32()), ("kind", pa.int32()), ("place", pa.int32())])
    kinds = pa.schema([("item_id", pa.int64()), ("t", pa.int64()), ("data", pa.binary()), ("parts", pa.binary()), ("by_word", pa.bool_()), ("windows", pa.list_(window))])
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("t"), "text").distinct()
    return rows.mapInArrow(lean(run), f"{_ITEMS}, windows array<struct<h:long,size:int,kind:int,place:int>>")


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bits of each window in its piece of the sieve, which has so many."""
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        yield ((h * np.uint64(k)) >> np.uint64(33)) % np.uint64(bits)


class Sieve:
    """Bits of windows, PIECES files of one folder; a window that has not all of its bits set is in no item."""

    def __init__(self, path: str, bits: int):
        fs, where = open_fs(path)
        self.bits = bits
        self.data = np.zeros((PIECES, bits // 8), np.uint8)
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        for f in fs.get_file_info(FileSelector(where)):
            if f.base_name.endswith(".parquet"):
                t = pq.read_table(f.path, filesystem=fs)
                for k, x in zip(t["bucket"].to_pylist(), t["bits"], strict=True):
                    self.data[k] = np.frombuffer(x.as_buffer(), np.uint8)
        self.data = self.data.reshape(-1)

    def passes(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the windows that may be in an item."""
        left = np.arange(len(h))
        for k in range(3):
            own = h[left]
            at = [*_probes(own, self.bits)][k] + (own >> np.uint64(20)) % np.uint64(PIECES) * np.uint64(self.bits)
            left = left[(self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left


def sieve_of(index: DataFrame, n: int) -> tuple[str, int]:
    """(folder, bits of a piece) of the sieve of a table of n windows."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS * max(n, 1) - 1).bit_length())) // PIECES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(["h"], PIECES)
        for batch in batches:
            yield from pack.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from pack.flush()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in runs(batches, "bucket"):
            held = np.zeros(bits, bool)
            for row in rows:
                for at in _probes(unpack([row], "h", "<u8"), bits):
                    held[at.astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    path = new_path(index.sparkSession, "sieve")
    rows = index.select("h").mapInArrow(lean(deal), "bucket int, h binary").repartition("bucket").sortWithinPartitions("bucket")
    rows.mapInArrow(lean(mark), "bucket int, bits binary").write.parquet(path)
    return path, bits


def _matched(own: np.ndarray, parts: np.ndarray, by_word: bool, hits: list[dict]) -> tuple[float, int, bool, int, int] | None:
    """(coverage, slots, changed, start of the first match, end of the last) of an item that leaks, from its windows in a document."""
    size, words = len(own), int(parts.sum())
    diagonals: dict[int, tuple[np.ndarray, np.ndarray, list[int], list[int]]] = {}
    verbatim: dict[int, tuple[np.ndarray, list[int], list[int]]] = {}
    for x in hits:
        p, n, d = x["place"], x["size"], x["at"] - x["place"]
        if x["kind"]:
            mask, low, high = verbatim.setdefault(d, (np.zeros(words, bool), [], []))
        else:
            mask, theirs, low, high = diagonals.setdefault(d, (np.zeros(size, bool), np.zeros(size, np.uint64), [], []))
            theirs[p : p + n] = np.frombuffer(x["held"], "<u8")
        mask[p : p + n] = True
        low.append(x["low"])
        high.append(x["high"])
    covered, slots, changed, lows, highs = np.zeros(size, bool), 0, False, [], []
    for mask, theirs, low, high in diagonals.values():
        s = mask & (own != 0)
        pairs = set(zip(own[s].tolist(), theirs[s].tolist(), strict=True))
        if len(pairs) > min(len({x for x, _ in pairs}), len({y for _, y in pairs})):
            continue  # values don't map one to one
        covered |= mask
        slots += int(s.sum())
        changed |= any(x != y for x, y in pairs)
        lows.append(min(low))
        highs.append(max(high))
    share = np.repeat(covered, parts) if by_word else covered
    for mask, low, high in verbatim.values():
        new = np.logical_and.reduceat(mask, np.cumsum(parts) - parts) & ~covered
        covered |= new
        slots += int((new & (own != 0)).sum())
        share = share | mask
        lows.append(min(low))
        highs.append(max(high))
    if not lows or share.mean() < COVER:
        return None
    return float(share.mean()), slots, changed, min(lows), max(highs)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed, start, end): documents that hold an item, with the bytes from the first matched token to the last.

    key is an expression of type long that stands for doc_id.
    """
    items = written(items_of(benchmark), "items")
    index = written(items.select(F.explode("windows").alias("w"), "item_id", "t").select("w.*", "item_id", "t"), "item-windows")
    sizes = [(r["kind"], r["size"], r["n"]) for r in index.groupBy("kind", "size").agg(F.count("*").alias("n")).orderBy("kind", "size").collect()]  # WINDOW sizes at most of each kind
    path, bits = sieve_of(index, sum(n for *_, n in sizes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(path, bits)
        for batch in batches:
            rows, docs_of = batch.column(0).to_numpy(), batch.column(1)
            offsets, data = text_buffers(batch.column(2))
            for i, _, at, token, value, starts, ends, words in tokens_of(offsets, data):
                for kind, n, _ in sizes:
                    own, s, e = (words.at, words.starts, words.ends) if kind else (at, starts, ends)
                    h, ok = (_word_windows(words.h, n), None) if kind else windows(token, value, n)
                    hit = sieve.passes(h)
                    hit = hit if ok is None else hit[ok[hit]]
                    row = np.searchsorted(own, hit, "right") - 1
                    inside = hit + n <= own[row + 1]
                    hit, row = hit[inside], row[inside]
                    if not len(hit):
                        continue
                    base = offsets[i + row]
                    held = [b""] * len(hit) if kind else [value[p : p + n].tobytes() for p in hit.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[i + row]), docs_of.take(pa.array(i + row)), pa.array(h[hit].view(np.int64)), pa.array((hit - own[row]).astype(np.int64)), pa.array(held, pa.binary()), pa.array(s[hit] - base), pa.array(e[hit + n - 1] - base)],
                        names=["row", "doc_id", "h", "at", "held", "low", "high"],
                    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("slots", pa.int32()), ("changed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for doc, item, data, parts, by_word, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _matched(np.frombuffer(data, "<u8"), np.frombuffer(parts, "<i4"), by_word, hits)
                if x:
                    out.append({"doc_id": doc, "item_id": item, "coverage": round(x[0], 6), "slots": x[1], "changed": x[2], "start": x[3], "end": x[4]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    rows = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), F.expr(key).cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(lean(find), "row long, doc_id long, h long, at long, held binary, low long, high long")
    pairs = found.join(index, "h").groupBy("row", "doc_id", "item_id", "t").agg(F.collect_list(F.struct("kind", "size", "place", "at", "held", "low", "high")).alias("hits"))
    both = pairs.join(items.drop("windows"), ["item_id", "t"]).select("doc_id", "item_id", "data", "parts", "by_word", "hits")
    return both.mapInArrow(lean(judge), "doc_id long, item_id long, coverage double, slots int, changed boolean, start long, end long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; columns stay. Each row is judged by its own text, which a hash of 64 bits stands for."""
    own = fresh(docs, "leak")
    gone = written(leaks(docs, benchmark, "xxhash64(text)").select(F.col("doc_id").alias(own)).distinct(), "leaks")
    return docs.join(gone, F.xxhash64(docs["text"]) == gone[own], "left_anti")
