"""Operator 10: substring dedup by paragraphs.

Paragraphs come in two forms. Lines of MIN_WORDS words or more are compared by MinHash banding over their 5-word
shingles: bands are tuned for RECALL at a Jaccard similarity of 0.8, colliding lines form candidate blocks, blocks are
joined by exact Jaccard, and links are clustered by components. As passages are also pasted into the middle of lines,
where line ends don't frame them, windows of MIN_RUN words of a document are winnowed: of every REACH windows in a row the one with the
smallest hash, the rightmost of equal ones, is a mark. Marks depend on the words of those REACH windows only, so a passage of
MIN_RUN + REACH - 1 words or more has at least one of its own wherever it stands, whatever its words, and all from the first
to the last of its own are the same. Marks match if they are equal (edit distance 0); what overlaps is put together. So a repeat
of MIN_RUN + REACH - 1 words or more is always found, a shorter one of MIN_RUN words may be; at most REACH - 1 words at each
edge of a repeat stay. In a run of one word or of a short cycle neighbouring marks are equal and count as one.

Of each class of equal marks or lines and each cluster of similar lines the occurrences in the smallest doc_id stay and those in other
documents go. Repeats within a document alone are left. Map tasks settle what they can, SETTLE occurrences at a time: of a class, only
those in the smallest doc_id among them are shuffled, the others are known repeats already, so a passage of any frequency leaves
a task once for each SETTLE. What a task holds and gives out at once is bounded by SETTLE and PACK, not by the batches it gets.
Offsets are of bytes in UTF-8.

Defined cases: null or empty text has no paragraphs; a null doc_id is neither compared nor cut; rows that repeat a doc_id are
one document (they don't repeat each other, and spans of either are cut from both); ties don't arise, as ids that are equal are one
document; a text of any length is read whole, in pieces of words.PIECE bytes; an empty table gives an empty one; extra columns are ignored by
repeated_passages() and kept by remove_passages(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Packer, bucket_count, by_bucket, runs, unpack
from .graph import components, spanning
from .jaccard_join import linked
from .lean import lean
from .store import drop, fresh, written
from .words import SHINGLE, mix, powers, shingles, text_buffers, words_of

MIN_WORDS, MIN_RUN, REACH = 20, 20, 7
THRESHOLD, RECALL, ROWS = 0.8, 0.99, 3
SETTLE, PACK = 1 << 19, 1 << 18
_NEWLINE = 10


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that catch a pair at the threshold with the probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def marks(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, ends, names) of the winnowed windows of documents' words; row has the document of each word."""
    m = len(h) - MIN_RUN - REACH + 2
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(m + REACH - 1)
    names = _window_names(h, at, at + MIN_RUN)
    low, best = names[:m], at[:m]
    for k in range(1, REACH):
        less = names[k : k + m] <= low
        low, best = np.where(less, names[k : k + m], low), np.where(less, at[k : k + m], best)
    best = best[row[:m] == row[MIN_RUN + REACH - 2 :]]  # all windows in one document
    best = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    if not len(best):
        return best, best, names[:0]
    fresh = np.concatenate([[True], (names[best[1:]] != names[best[:-1]]) | (row[best[1:]] != row[best[:-1]])])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(best)]]) - 1
    return best[first], best[last] + MIN_RUN, names[best[first]]


class _Group:
    """Words of some documents of a batch: row and place of each, and the starts of lines among them."""

    def __init__(self, first: int, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, offsets: np.ndarray, data: np.ndarray, ids: np.ndarray):
        self.h, self.at, self.first = h, at, first
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.id_of_row = ids[first : first + len(at) - 1]
        base = offsets[first : first + len(at) - 1][self.row]
        self.starts, self.ends = starts - base, ends - base
        a, b = int(offsets[first]), int(offsets[first + len(at) - 1])
        lines = np.flatnonzero(data[a:b] == _NEWLINE) + a
        cuts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], np.searchsorted(starts, lines)]))
        self.lines = cuts[cuts < len(h)]  # the first word of each line

    @property
    def ids(self) -> np.ndarray:
        return self.id_of_row[self.row]

    def long_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, ends) of the lines of MIN_WORDS words or more."""
        ends = np.concatenate([self.lines[1:], [len(self.h)]]) if len(self.lines) else self.lines
        long = ends - self.lines >= MIN_WORDS
        return self.lines[long], ends[long]

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return marks(self.h, self.row)

    def place(self, a: np.ndarray) -> np.ndarray:
        """The number of words in its document."""
        return a - self.at[self.row[a]]


def _groups(batch: pa.RecordBatch) -> Iterator[_Group]:
    """Of a batch with doc_id (no nulls) and text."""
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets, data = text_buffers(batch.column(batch.schema.get_field_index("text")))
    for i, _, at, starts, ends, h in words_of(offsets, data):
        if len(h):
            yield _Group(i, at, starts, ends, h, offsets, data, ids)


def _settle(cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the occurrences in their class's smallest document, numbers of the repeats, that document for each repeat)."""
    order = np.lexsort((doc, cls))
    if not len(order):
        return order, order, doc
    cls, doc = cls[order], doc[order]
    first = np.concatenate([[True], cls[1:] != cls[:-1]])
    low = doc[first][np.cumsum(first) - 1]
    stay = doc == low
    return order[stay], order[~stay], low[~stay]


#: place is the number of the first word in its document; a text has less than 2 GB, so places and offsets fit in 32 bits.
_FIELDS = (("cls", "<u8"), ("doc", "<i8"), ("place", "<u4"), ("start", "<u4"), ("size", "<u4"), ("words", "<u4"), ("low", "<i8"))
_NAMES = [n for n, _ in _FIELDS]
_SCHEMA = "bucket int, " + ", ".join(f"{n} binary" for n in _NAMES)
_OWN, _KNOWN = _NAMES[:-1], ["key", *_NAMES[1:]]  # packed columns of occurrences in the smallest document, whose low is their doc, and of repeats


def _packed(pack: Packer, columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packs the rows at of columns step by step, so that no batch has many more than PACK."""
    for i in range(0, len(at), step := PACK // 4):
        yield from pack.add(*(c[at[i : i + step]] for c in columns))


def _repeats(pack: Packer, spans: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packs spans (doc, place, start, size, words, low) by document."""
    yield from _packed(pack, [mix(spans[0].view(np.uint64)), *spans], np.arange(len(spans[0])))


def _rows(batch: pa.RecordBatch, kind: int | None = None) -> pa.RecordBatch:
    """A packed batch with the columns of _SCHEMA, empty where it has none, and its kind before them if one is given."""
    none = pa.array([b""] * batch.num_rows, pa.binary())
    columns = {"bucket": batch.column("bucket")} | {n: batch.column(n) if n in batch.schema.names else none for n in _NAMES}
    if kind is not None:
        columns = {"kind": pa.array(np.full(batch.num_rows, kind, np.int32))} | columns
    return pa.RecordBatch.from_pydict(columns)


def _joined(doc: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Spans of documents with those that overlap put together, in order; low is that of the first part."""
    order = np.lexsort((low, start, doc))
    doc, place, start, low = doc[order], place[order], start[order], low[order]
    end, stop = start + size[order].astype(np.int64), place + words[order].astype(np.int64)
    if not len(doc):
        return [doc, place, start, end.astype(np.uint32), stop.astype(np.uint32), low]
    other = doc[1:] != doc[:-1]
    shift = np.concatenate([[0], np.cumsum(other)]) * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + shift) - shift
    i = np.flatnonzero(np.concatenate([[True], other | (start[1:] > so_far[:-1])]))
    at = np.minimum.reduceat(place, i)
    return [doc[i], at, start[i], (np.maximum.reduceat(end, i) - start[i]).astype(np.uint32), (np.maximum.reduceat(stop, i) - at).astype(np.uint32), low[i]]


def exact_repeats(docs: DataFrame) -> DataFrame:
    """Packed rows of the occurrences of marks and lines outside the smallest document of their class, bucketed by document."""
    buckets = bucket_count(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = Packer(_OWN, buckets, PACK), Packer(_KNOWN, buckets, PACK)
        held: list[list[np.ndarray]] = [[] for _ in _OWN]
        n = 0

        def settle() -> Iterator[pa.RecordBatch]:
            columns = []
            for parts in held:
                columns.append(np.concatenate(parts))
                parts.clear()
            stay, gone, low = _settle(*columns[:2])
            yield from (_rows(x, 0) for x in _packed(out, columns, stay))
            if len(gone):
                spans = _joined(*(c[gone] for c in columns[1:]), low)
                del columns, stay, gone, low
                yield from (_rows(x, 1) for x in _repeats(known, spans))

        for batch in batches:
            for g in _groups(batch):
                a, b = g.long_lines()
                for a, b, names in (g.marks(), (a, b, _window_names(g.h, a, b) ^ np.uint64(0x5851F42D4C957F2D))):
                    for parts, x, (_, kind) in zip(held, (names, g.ids[a], g.place(a), g.starts[a], g.ends[b - 1] - g.starts[a], b - a), _FIELDS[:-1], strict=True):
                        parts.append(x.astype(kind))
                    n += len(a)
                if n >= SETTLE:
                    yield from settle()
                    n = 0
        if n:
            yield from settle()
        for kind, pack in ((0, out), (1, known)):
            yield from (_rows(x, kind) for x in pack.flush())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Packer(_KNOWN, buckets, PACK)
        for _, rows in runs(batches, "bucket"):
            mine = [r for r in (r.filter(pc.equal(r.column(0), 0)) for r in rows) if r.num_rows]
            for r in rows:
                yield r.filter(pc.equal(r.column(0), 1)).drop_columns("kind")
            if mine:
                _, gone, low = _settle(unpack(mine, "cls", "<u8"), unpack(mine, "doc", "<i8"))
                if len(gone):
                    yield from (_rows(x) for x in _repeats(known, _joined(*(unpack(mine, n, t)[gone] for n, t in _FIELDS[1:-1]), low)))
        yield from (_rows(x) for x in known.flush())

    packed = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(lean(cut), f"kind int, {_SCHEMA}")
    return by_bucket(packed).mapInArrow(lean(meet), _SCHEMA)


def _window_names(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word sequence h[a:b]."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64))


def similar_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place, start, size, words, low): lines whose cluster, found by banding and exact Jaccard, has a smaller document, low."""
    buckets, b = bucket_count(docs), bands()
    salts = mix(np.arange(1, b * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)  # odd: each product permutes the hashes
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(["sig", "id", "doc"], buckets)
        for batch in batches:
            for g in _groups(batch):
                a, e = g.long_lines()
                if not len(a):
                    continue
                name, first = np.unique(_window_names(g.h, a, e), return_index=True)
                a, e = a[first], e[first]
                n = e - a - SHINGLE + 1
                cuts = np.cumsum(n) - n
                s = shingles(g.h)[np.repeat(a - cuts, n) + np.arange(int(n.sum()))]
                doc = g.ids[a]
                for k in range(b):
                    sig = np.full(len(a), k * 0xE7037ED1A0B428DB % (1 << 64), np.uint64)
                    for r in range(ROWS):
                        sig = mix(sig ^ np.minimum.reduceat(s * salts[k * ROWS + r], cuts))
                    yield from pack.add(sig, name, doc)
        yield from pack.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            sig, name, doc = unpack(rows, "sig", "<u8"), unpack(rows, "id", "<u8"), unpack(rows, "doc", "<i8")
            order = np.lexsort((doc, name, sig))
            sig, name, doc = sig[order], name[order], doc[order]
            first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])]) if len(sig) else np.zeros(0, bool)
            sig, name, doc = sig[first], name[first], doc[first]
            same = sig[1:] == sig[:-1]
            if same.any():
                low = dict(zip(name[::-1].tolist(), doc[::-1].tolist(), strict=True))
                for k, d in zip(name.tolist(), doc.tolist(), strict=True):
                    low[k] = min(low[k], d)
                u, v = spanning(name[:-1][same], name[1:][same])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (u.view(np.int64), v.view(np.int64), np.array([low[k] for k in u.tolist()], np.int64), np.array([low[k] for k in v.tolist()], np.int64)))], names=["u", "v", "ud", "vd"])

    edges = written(by_bucket(docs.mapInArrow(lean(sign), "bucket int, sig binary, id binary, doc binary")).mapInArrow(lean(meet), "u long, v long, ud long, vd long"), "line-edges")
    blocks = components(edges)
    where = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("ud").alias("doc")), F.struct(F.col("v").alias("node"), F.col("vd").alias("doc")))).alias("e")).groupBy("e.node").agg(F.min("e.doc").alias("doc"))
    wanted = where.join(blocks, "node").groupBy("doc").agg(F.collect_set("node").alias("names"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [set(x) for x in batch.column(batch.schema.get_field_index("names")).to_pylist()]
            out: list[tuple] = []
            done: set[tuple[int, int]] = set()
            for g in _groups(batch):
                a, e = g.long_lines()
                own = _window_names(g.h, a, e).view(np.int64).tolist()
                for k, x, y in zip(own, a.tolist(), e.tolist(), strict=True):
                    row = g.first + int(g.row[x])
                    if k in names[row]:
                        d = int(g.id_of_row[g.row[x]])
                        out.append((k, d, x - int(g.at[g.row[x]]), int(g.starts[x]), int(g.ends[y - 1] - g.starts[x]), y - x, np.unique(shingles(g.h[x:y])).tobytes() if (k, d) not in done else b""))
                        done.add((k, d))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "doc_id", "place", "start", "size", "words", "held"])

    found = written(docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["doc"]).select("doc_id", "text", "names").mapInArrow(lean(find), "id long, doc_id long, place long, start long, size long, words long, held binary"), "lines")
    reps = found.where("octet_length(held) > 0").join(blocks, F.col("id") == F.col("node")).select("id", "component", (F.octet_length("held") / 8).cast("int").alias("size"))
    sets = found.where("octet_length(held) > 0").select("id", "held")
    clusters = linked(reps, lambda members: sets.join(members, "id").select("id", "held", F.explode("blocks").alias("block")))
    drop(edges)
    drop(blocks)
    of = found.join(clusters, F.col("id") == F.col("node")).select("doc_id", "place", "start", "size", "words", "component")
    low = of.groupBy("component").agg(F.min("doc_id").alias("low"))
    return of.join(low, "component").where("doc_id > low").select("doc_id", "place", "start", "size", "words", "low")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, also_in) of the passages that go: a row for each span of bytes, spans of a document apart. also_in is
    a document with a smaller id that holds the passage, or its first part if it was put together from several."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = bucket_count(docs)

    def pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(_KNOWN, buckets, PACK)
        for batch in batches:
            spans = [batch.column(k).to_numpy().astype(t) for k, (_, t) in enumerate(_FIELDS[1:])]
            yield from (_rows(x) for x in _repeats(pack, spans))
        yield from (_rows(x) for x in pack.flush())

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            d, _, start, size, words, low = _joined(*(unpack(rows, n, t) for n, t in _FIELDS[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (d, start, start + size, words, low)], names=["doc_id", "start", "end", "words", "also_in"])

    lines = similar_lines(docs).mapInArrow(lean(pack_lines), _SCHEMA)
    return by_bucket(exact_repeats(docs).unionAll(lines)).mapInArrow(lean(spans), "doc_id long, start long, end long, words long, also_in long")


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with the passages cut out of text and n_chars, where it is there, counted anew; documents left without a word go.

    White space that meets where a passage was becomes one space or line end. Documents without repeats stay as they are.
    """
    own, spans = fresh(docs, "cut_id"), fresh(docs, "cuts")
    cuts = repeated_passages(docs).groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    columns = docs.columns
    rows = docs.join(cuts.hint("merge"), docs["doc_id"] == cuts[own], "left").select(*(docs[c] for c in columns), cuts[spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            cut = batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False)).tolist()
            batch = batch.select(columns)
            if not hit:
                yield batch
                continue
            texts = batch.column(k).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for r in hit:
                raw, out, at = (texts[r] or "").encode(), [], 0
                for c in cut[r].as_py():
                    a, e = c["start"], min(c["end"], len(raw))
                    if e <= at:
                        continue
                    out.append(raw[at:a])
                    while e < len(raw) and raw[e] in b" \t" and (not out[-1] or out[-1][-1:] in (b" ", b"\n")):
                        e += 1
                    at = e
                texts[r] = (b"".join(out) + raw[at:]).decode(errors="ignore")
                keep[r] = bool(texts[r].strip())
            arrays = [pa.array(texts, batch.column(k).type) if i == k else c for i, c in enumerate(batch.columns)]
            if "n_chars" in columns:
                i = columns.index("n_chars")
                n = batch.column(i).to_pylist()
                for r in hit:
                    n[r] = len(texts[r])
                arrays[i] = pa.array(n, batch.column(i).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))

    return rows.mapInArrow(lean(run), docs.schema)
