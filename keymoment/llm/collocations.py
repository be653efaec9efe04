"""Operator 13: phrases of 2 to 4 words from vertical positional inverted lists.

Blocks of about BLOCK bytes of one language's texts become inverted lists: each distinct word with its ascending positions, where a position is left out between
pieces, so neighbours in a list's positions are neighbours in a piece. The lists of all blocks are a table, written once. A phrase's list comes from a shorter
one's by a merge join of its positions, moved on by its length, with the positions of the words that may follow; its length is the phrase's frequency in the block.

Level by level, blocks give (hash, frequency) of their phrases, packed; hashes that add up to LEAST over all blocks are a superset of the
frequent phrases and go in a sieve (a file of at most MOST_BITS bits, whatever their number), and only phrases whose first and last words pass it are
extended. So hashes and sieve save work and decide nothing: at the end blocks give the texts and exact frequencies of what passed, packed by bucket too, which are added up by text.
Scores join phrases with their parts, two shorter phrases each; single words enter with the pairs only.

Memory: a task holds a block's lists, about 40 bytes a word, and the sieves; a text longer than a block is cut where a piece ends, so only a
single piece can make a block longer. The last ranking is by language in two steps, so no task ranks all of one.

Defined cases: a null text is empty, a null language `und` (one with a real `und`); repeated rows and doc_ids count each; doc_id isn't used; a language without a
candidate has no rows; ties of score and frequency go by the phrase's bytes, of cuts to the first; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buckets import bucket_count, runs, unpack
from .lean import lean
from .sieve import Sieve, sieve_of
from .store import drop, drop_path, written
from .words import mix, text_buffers, words_of

LONGEST, LEAST, COVER, BEST = 4, 30, 80, 2000
BLOCK = 1 << 23
#: Words of the corpus for a bucket of hashes; a bucket has a hash or so for each pair of words at most.
BUCKET = 1 << 22
#: Parts of a language's ranking before the last.
PARTS = 64

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAKS = _SEPARATORS.copy()
_BREAKS[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size] of all rows, one after another."""
    ends = np.cumsum(sizes)
    kind = np.int32 if len(data) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    return data[np.arange(ends[-1] if len(ends) else 0, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)]


def _equal(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether words a and b are the same bytes, each."""
    if (sizes[a] != sizes[b]).any():
        return False
    step = 1 << 17
    return all(np.array_equal(slices(data, starts[a[i : i + step]], sizes[a[i : i + step]]), slices(data, starts[b[i : i + step]], sizes[b[i : i + step]])) for i in range(0, len(a), step))


def _cut_long(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """offsets with more cuts, where pieces end, in texts longer than a block."""
    out = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > BLOCK):
        a, b = int(offsets[i]), int(offsets[i + 1])
        while b - a > BLOCK:
            ends = np.flatnonzero(_SEPARATORS[data[a + BLOCK : b]])  # a text this long is one row in memory anyway
            if not len(ends):
                break
            a += BLOCK + int(ends[0]) + 1
            out.append(np.array([a]))
    return np.sort(np.concatenate(out)) if len(out) > 1 else offsets


class _Block:
    """Words of one language, collected up to a block: bytes, starts, sizes, hashes, positions."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.at = 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, gaps: np.ndarray) -> None:
        position = np.arange(len(h)) + np.cumsum(gaps) + self.at
        sizes = ends - starts
        self.parts.append((slices(data, starts, sizes), sizes, h, position))
        self.size += int(sizes.sum())
        self.at = int(position[-1]) + 2

    def lists(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words, lengths of their lists, the lists one after another)."""
        data, sizes, h, position = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        data, starts = _LOWER[data], np.cumsum(sizes) - sizes
        self.parts = []
        order = np.argsort(h, kind="stable")
        own = h[order]
        new = np.r_[True, own[1:] != own[:-1]]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        if not _equal(data, starts, sizes, order, first):  # two words of one hash: by their bytes
            texts = np.array([data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)], dtype=object)
            order = np.array(sorted(range(len(h)), key=lambda i: (h[i], texts[i], i)))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (texts[order][1:] != texts[order][:-1])]
        cuts = np.flatnonzero(new)
        one = order[cuts]
        offsets = np.r_[0, np.cumsum(sizes[one])].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(one), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(slices(data, starts[one], sizes[one]).tobytes())])
        return words, np.diff(np.r_[cuts, len(order)]), position[order]


def inverted_lists(docs: DataFrame) -> DataFrame:
    """(lang, words, sizes, positions): a block's distinct words, their lists' lengths, and the lists packed as 32-bit integers."""

    def out(lang: str, block: _Block) -> pa.RecordBatch:
        words, sizes, positions = block.lists()
        rows = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()).cast(pa.string()))
        counts = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(sizes.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([lang]), rows, counts, pa.array([positions.astype("<u4").tobytes()], pa.binary())], names=["lang", "words", "sizes", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in langs.unique().to_pylist():
                offsets, data = text_buffers(texts.filter(pc.equal(langs, lang)))
                block = blocks.setdefault(lang, _Block())
                for i, j, at, starts, ends, h in words_of(_cut_long(offsets, data), data, breaks=_BREAKS):
                    if not len(h):
                        continue
                    a = int(starts[0])
                    stops = np.cumsum(_SEPARATORS[data[a : int(ends[-1])]])
                    gaps = np.zeros(len(h), np.int64)
                    gaps[1:] = stops[starts[1:] - a] > stops[ends[:-1] - 1 - a]
                    row = at[:-1][(at[:-1] > 0) & (at[:-1] < len(h))]
                    gaps[row] = 1
                    block.add(data, starts, ends, h, gaps)
                    if block.size >= BLOCK:
                        yield out(lang, block)
                        block = blocks[lang] = _Block()
            if sum(b.size for b in blocks.values()) >= 2 * BLOCK:
                yield from (out(k, b) for k, b in blocks.items() if b.size)
                blocks = {}
        yield from (out(k, b) for k, b in blocks.items() if b.size)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(lean(run), "lang string, words array<string>, sizes array<int>, positions binary")


class Lists:
    """A block's lists of frequent words, and what merge joins make of them."""

    def __init__(self, row: dict[str, pa.Scalar], sieve: Sieve):
        sizes, word_keys = row["sizes"].values.to_numpy(), row["keys"].values.to_numpy().view(np.uint64)
        positions = np.frombuffer(row["positions"].as_buffer(), "<u4")
        keep = sieve.passes(word_keys >> np.uint64(16))
        entry = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(positions, kind="stable")
        order = order[keep[entry[order]]]
        #: Postings of all frequent words in order of position.
        self.position, self.entry = positions[order].astype(np.int64), entry[order]
        self.key = word_keys[self.entry]
        #: Lists of the phrases of this length: places of their first words in the postings, and a hash of each phrase.
        self.at, self.phrase, self.length = np.arange(len(order)), self.key, 1

    def extend(self) -> None:
        """Phrases of one word more: a phrase's positions, moved on by its length, that a following word's list holds."""
        wanted = self.position[self.at] + self.length
        found = np.searchsorted(self.position, wanted)
        hit = found < len(self.position)
        hit[hit] = self.position[found[hit]] == wanted[hit]
        self.at, found = self.at[hit], found[hit]
        with np.errstate(over="ignore"):
            self.phrase = mix(self.phrase[hit] * np.uint64(0x9E3779B97F4A7C15) + self.key[found])
        self.length += 1

    def prune(self, sieve: Sieve) -> None:
        """Leaves the phrases that may be frequent."""
        keep = sieve.passes(self.phrase >> np.uint64(16))
        self.at, self.phrase = self.at[keep], self.phrase[keep]

    def join_ends(self) -> None:
        """Of phrases with a word more, those whose last words, without the first, are in the lists too."""
        held = np.zeros(len(self.position) + 1, bool)
        held[self.at] = True
        self.extend()
        keep = held[self.at + 1] if self.length > 2 else slice(None)  # the word after the first begins a phrase of the length before
        self.at, self.phrase = self.at[keep], self.phrase[keep]

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of first words, frequencies, hashes in order) of distinct phrases: their lists' first entries and lengths."""
        order = np.argsort(self.phrase, kind="stable")
        own, at = self.phrase[order], self.at[order]
        new = np.r_[True, own[1:] != own[:-1]][: len(own)]
        for k in range(self.length):  # phrases of one hash that differ
            e = self.entry[at + k]
            first = e[np.flatnonzero(new)][np.cumsum(new) - 1]
            if (e != first).any():
                rows = np.stack([self.entry[at + x] for x in range(self.length)], axis=1)
                _, one, n = np.unique(np.column_stack([np.cumsum(new), rows]), axis=0, return_index=True, return_counts=True)
                return at[one], n, own[one]
        cuts = np.flatnonzero(new)
        return at[cuts], np.diff(np.r_[cuts, len(own)]), own[cuts]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i] for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _grown(row: dict[str, pa.Scalar], sieves: list[Sieve], length: int) -> Lists:
    out = Lists(row, sieves[0])
    for k in range(2, length + 1):
        out.join_ends()
        if k - 1 < len(sieves):
            out.prune(sieves[k - 1])
    return out


def frequent_hashes(lists: DataFrame, sieves: list[tuple[str, int]], length: int, buckets: int) -> DataFrame:
    """Hashes (column h) of phrases of a length whose frequencies in all blocks add up to LEAST: the frequent ones, and the few that share a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Sieve.of(*s) for s in sieves]
        for row in _blocks(batches):
            h = np.sort(_grown(row, own, length).phrase)
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            if not len(cuts):
                continue
            # A hash's upper 48 bits, in order, and its frequency as far as it matters.
            n, h = np.minimum(np.diff(np.r_[cuts, len(h)]), 255).astype(np.uint8), h[cuts] >> np.uint64(16)
            bucket = ((h >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in full], pa.int32()), *(pa.array([x[a:b].tobytes() for _, a, b in full], pa.binary()) for x in ((h >> np.uint64(16)).astype("<u4"), (h & np.uint64(0xFFFF)).astype("<u2"), n)),
            ], names=["bucket", "high", "low", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            h = unpack(rows, "high", "<u4").astype(np.uint64) << np.uint64(16) | unpack(rows, "low", "<u2").astype(np.uint64)
            n = unpack(rows, "n", "u1")
            order = np.argsort(h)
            h = h[order]
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            total = np.add.reduceat(n[order].astype(np.int64), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(h[cuts][total >= LEAST].view(np.int64))], names=["h"])

    packed = lists.select("sizes", "positions", "keys").mapInArrow(lean(count), "bucket int, high binary, low binary, n binary")
    return packed.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(add), "h long")


def _texts(lists: DataFrame, sieves: list[tuple[str, int]], buckets: int) -> DataFrame:
    """(lang, phrase, a) of the phrases that have LEAST occurrences in all blocks; blocks' texts and counts are packed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Sieve.of(*s) for s in sieves]
        for row in _blocks(batches):
            words = row["words"].values
            grown = Lists(row, own[0])
            for k in range(2, LONGEST + 1):
                grown.join_ends()
                grown.prune(own[k - 1])
                at, n, h = grown.groups()
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    part = slice(int(ends[i]), int(ends[i + 1]))
                    phrases = pc.binary_join_element_wise(*(words.take(pa.array(grown.entry[at[part] + j])) for j in range(k)), " ")
                    offsets, data = text_buffers(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([row["lang"].as_py()]), pa.array([data[offsets[0] : offsets[-1]].tobytes()], pa.binary()), pa.array([np.diff(offsets).astype("<u4").tobytes()], pa.binary()), pa.array([n[part].astype("<u4").tobytes()], pa.binary())],
                        names=["bucket", "lang", "data", "sizes", "n"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            for lang in dict.fromkeys(x for r in rows for x in r.column(1).to_pylist()):
                own = [r.filter(pc.equal(r.column(1), lang)) for r in rows]
                data, sizes, n = unpack(own, "data", "u1"), unpack(own, "sizes", "<u4"), unpack(own, "n", "<u4")
                offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                table = pa.table({"phrase": phrases, "a": n.astype(np.int64)}).group_by("phrase").aggregate([("a", "sum")])
                table = table.filter(pc.greater_equal(table["a_sum"], LEAST)).combine_chunks()
                for batch in table.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * batch.num_rows, pa.string()), batch.column("phrase").cast(pa.binary()).cast(pa.string()), batch.column("a_sum")], names=["lang", "phrase", "a"])

    packed = lists.mapInArrow(lean(count), "bucket int, lang string, data binary, sizes binary, n binary")
    return packed.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(add), "lang string, phrase string, a long")


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): tables of exact frequencies of LEAST or more, by (lang, phrase), and of all words' number by language."""
    blocks = written(inverted_lists(docs), "lists")
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "sizes")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.sizes").alias("a"))
    words = written(each.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST), "words")
    totals = written(blocks.groupBy("lang").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    keyed = blocks.withColumn("keys", F.transform("words", lambda w: F.xxhash64(w)))
    buckets = max(bucket_count(blocks), int(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET + 1)
    sieves = [sieve_of(words.select(F.shiftrightunsigned(F.xxhash64("phrase"), 16).alias("h")), words.count())]
    for length in range(2, LONGEST + 1):
        hashes = written(frequent_hashes(keyed, sieves, length, buckets), "hashes")
        sieves.append(sieve_of(hashes, hashes.count()))
        drop(hashes)
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    phrases = written(_texts(keyed, sieves, buckets).select("lang", "phrase", size.alias("size"), "a"), "phrases")
    for path, _ in sieves:
        drop_path(blocks.sparkSession, path)
    drop(blocks)
    return words, phrases, totals


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases with head and tail (all words but the last, but the first) and their lowest-scoring cut: l, r and score.

    pre and suf hold the frequencies of a phrase's first and last 1, 2, ... words; a phrase has them from its head and tail.
    """
    none = F.array().cast("array<long>")
    shorter, out = words.select("lang", "phrase", "a", none.alias("pre"), none.alias("suf")), []
    for size in range(2, LONGEST + 1):
        rows = phrases.where(F.col("size") == size).withColumns({"head": F.substring_index("phrase", " ", size - 1), "tail": F.substring_index("phrase", " ", 1 - size)})
        head = shorter.select("lang", F.col("phrase").alias("head"), F.concat("pre", F.array("a")).alias("pre"))
        tail = shorter.select("lang", F.col("phrase").alias("tail"), F.concat("suf", F.array("a")).alias("suf"))
        rows = rows.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
        cut = F.expr("""transform(sequence(1, size - 1), k -> struct(
            cast((cast(a as decimal(20)) * 2000000) div (cast(pre[k - 1] as decimal(20)) + cast(suf[size - k - 1] as decimal(20))) as long) as score, k, pre[k - 1] as l, suf[size - k - 1] as r))""")
        out.append(written(rows.withColumn("cut", F.array_min(cut)).select("lang", "phrase", "size", "a", "head", "tail", "pre", "suf", "cut.score", "cut.l", "cut.r"), "scored"))
        shorter = out[-1]
    return reduce(DataFrame.unionByName, out).drop("pre", "suf")


def collocations(docs: DataFrame) -> DataFrame:
    """Each language's BEST phrases: lang, rank, phrase, a, l, r, n, score."""
    words, phrases, totals = frequent_phrases(docs)
    rows = scored(words, phrases)
    # A longer phrase that covers a shorter one does so by one of the phrases with a single word more, which is at least as frequent.
    longer = rows.where("size > 2").select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.col("longer").cast("decimal(20)") * 100 >= F.col("a").cast("decimal(20)") * COVER
    rows = rows.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= BEST)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= BEST)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
