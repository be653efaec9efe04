"""Operator 5: language identification by hyperdimensional profiles.

Each letter has a random vector of +-1, drawn from its code point alone. A trigram's vector binds its letters'
vectors, permuted by place (rotations by 2, 1 and 0), by multiplication; a document bundles (adds) the vectors of
its trigrams, a language those of its training documents, each of length one in all. A document gets the language
whose prototype has the largest cosine with it (ties: the name that comes first), and that cosine, cut to 0..1, as its score.

Trigrams are taken from lower-cased letters with a mark at each end of a word; other characters break words.
Counts of the documents in a piece are bundled with matrix products. Prototypes are sums over all training rows
(grouped aggregation of partial sums of DIM numbers a language), so what the driver gets follows languages and DIM, not documents.

A piece has TEXTS texts and CHARS letters at most; a longer text is bundled section by section, which adds up to the
same vector. Products take COLUMNS trigrams at a time and the vectors of SLOTS trigrams at most are kept, so a worker's
memory depends on these four bounds and on the number of distinct letters, not on how many or how long texts are.

keep_identified() drops what it can't identify: a text whose best cosine is not above CHANCE standard deviations of the
cosine of unrelated vectors (1 / sqrt(DIM)). Of sf0.1's 10,000 documents that drops one, of a single letter.

Defined cases: null text and text without a letter get `und` and score 0; with no training row every document
does, but keep_identified() then keeps every text with a letter; rows with a null lang or doc_id aren't learned from; a null doc_id is
judged by its text and stays null; repeated rows count each time; extra columns are ignored or, by keep_identified(), kept whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .split import held_out, learnable

DIM, SEED, UNKNOWN, CHANCE = 1024, 20_240_131, "und", 2.0
TEXTS, CHARS, COLUMNS, SLOTS = 256, 250_000, 4_096, 16_384
_LETTERS = 128  # letters whose trigrams may be kept


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Of each code point: its lower-case letter, or 32."""
    fold = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            fold[c] = ord(x.lower()[0])
    return fold


class Part:
    """A text or a section of one, with the letters beside the section, which are no centres of its trigrams."""

    def __init__(self, row: int, text: str, a: int, b: int):
        self.row, self.left, self.right = row, a > 0, b < len(text)
        self.text = text if not self.left and not self.right else text[a - self.left : b + self.right]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, list[Part]]]:
    """(first row, end row, parts) of TEXTS rows and CHARS letters at most; rows of a longer text come once a section."""
    held: list[Part] = []
    n = first = 0
    for i, x in enumerate(texts):
        x = x.as_py() or ""
        if held and (i - first >= TEXTS or n + len(x) > CHARS):
            yield first, i, held
            held, n, first = [], 0, i
        if len(x) > CHARS:
            for a in range(0, len(x), CHARS):
                yield i, i + 1, [Part(i, x, a, min(a + CHARS, len(x)))]
            first = i + 1
            continue
        held.append(Part(i, x, 0, len(x)))
        n += len(x)
    if held:
        yield first, first + len(held), held


class Encoder:
    """Bundles of texts. Letters and trigrams get numbers as they come; vectors depend on code points only."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.fold = _fold()
        self.number = np.zeros(0x110000, np.int32)  # 0: break or not yet numbered
        self.letters, self.known = np.zeros((256, dim), np.int8), 1
        self.letters[0] = self._drawn(32)
        self.slot = np.full(_LETTERS**3, -1, np.int32)
        self.vectors, self.n = np.zeros((1024, dim), np.float32), 0

    def _drawn(self, code: int) -> np.ndarray:
        return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.float32), self.dim).astype(np.int8)

    def _letter(self, code: int) -> None:
        if self.known == len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.known] = self._drawn(code)
        self.number[code] = self.known
        self.known += 1

    def bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Vectors of the trigrams of the letters numbered a, b, c."""
        return (np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c]).astype(np.float32)

    def _keep(self, keys: np.ndarray) -> None:
        """Keeps the vectors of trigrams, as long as there is room."""
        keys = keys[: SLOTS - self.n]
        while self.n + len(keys) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for i in range(0, len(keys), COLUMNS):
            k = keys[i : i + COLUMNS]
            self.vectors[self.n : self.n + len(k)] = self.bound(k // _LETTERS**2, k // _LETTERS % _LETTERS, k % _LETTERS)
            self.slot[k] = np.arange(self.n, self.n + len(k))
            self.n += len(k)

    def trigrams(self, parts: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, letter before, letter, letter after) of each trigram."""
        size = np.array([len(p.text) + 2 for p in parts])
        ends = np.cumsum(size)
        codes = self.fold[np.frombuffer(("  ".join(p.text for p in parts) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")]
        number = self.number[codes]
        new = np.unique(codes[(number == 0) & (codes != 32)])
        if len(new):
            for c in new.tolist():
                self._letter(c)
            number = self.number[codes]
        centre = number > 0
        for p, a, b in zip(parts, ends - size, ends, strict=True):
            if p.left:
                centre[a] = False
            if p.right:
                centre[b - 3] = False
        at = np.flatnonzero(centre)
        left = np.where(at > 0, number[at - 1], 0).astype(np.int64)
        return np.searchsorted(ends, at, "right"), left, number[at].astype(np.int64), number[at + 1].astype(np.int64)

    def sums(self, parts: list[Part], target: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n vectors, trigrams of each part): each trigram of part i is added to vector target[i] weight[i] times, over its part's number if weight[i] < 0."""
        part, left, mid, right = self.trigrams(parts)
        number = np.bincount(part, minlength=len(parts))
        weight = np.where(weight < 0, -weight / np.maximum(number, 1), weight)
        small = (left < _LETTERS) & (mid < _LETTERS) & (right < _LETTERS)
        key = np.where(small, (left * _LETTERS + mid) * _LETTERS + right, 0)
        column = np.where(small, self.slot[key], -1)
        new = np.unique(key[small & (column < 0)])
        if len(new):
            self._keep(new)
            column = np.where(small, self.slot[key], -1)
        rest = column < 0
        names, back = np.unique(left[rest] << 42 | mid[rest] << 21 | right[rest], return_inverse=True)
        column[rest] = self.n + back
        used = np.zeros(self.n + len(names), bool)
        used[column] = True
        used = np.flatnonzero(used)
        renumbered = np.zeros(self.n + len(names), np.int64)
        renumbered[used] = np.arange(len(used))
        column, row, amount = renumbered[column], target[part], weight[part]
        out = np.zeros((n, self.dim))
        for i in range(0, len(used), COLUMNS):
            own = used[i : i + COLUMNS]
            k = names[own[own >= self.n] - self.n]
            v = np.concatenate([self.vectors[own[own < self.n]], self.bound(k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF)])
            here = slice(None) if len(used) <= COLUMNS else (column >= i) & (column < i + COLUMNS)
            counts = np.bincount(row[here] * len(own) + column[here] - i, amount[here], n * len(own)).reshape(n, len(own))
            out += counts.astype(np.float32) @ v
        return out, number

    def bundles(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vectors, which texts have a trigram) of groups of texts, in order."""
        total, some, last = np.zeros((1, self.dim)), np.zeros(1, bool), -1
        for first, end, parts in pieces(texts):
            n = end - first
            v, number = self.sums(parts, np.arange(n), np.ones(n), n)
            if n == 1 and first == last:  # a further section
                total, some = total + v, some | (number > 0)
                continue
            if last >= 0:
                yield total, some
            total, some, last = v, number > 0, first
        if last >= 0:
            yield total, some


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(languages in order of name, their vectors of length one) learned from docs(doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, total = Encoder(dim), {}
        for batch in batches:
            names, own = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for name in names.tolist():
                total.setdefault(name, np.zeros(dim))
            long, seen, last = np.zeros(dim), 0, -1
            for first, end, parts in [*pieces(batch.column(0)), (-1, -1, [])]:
                if last >= 0 and first != last:
                    total[names[own[last]]] += long / max(seen, 1)
                    long, seen, last = np.zeros(dim), 0, -1
                if not parts:
                    continue
                if parts[0].left or parts[0].right:  # a section: its text's length is known at the last one
                    v, number = e.sums(parts, np.zeros(1, np.int64), np.ones(1), 1)
                    long, seen, last = long + v[0], seen + int(number[0]), first
                    continue
                v, _ = e.sums(parts, own[first:end], np.full(end - first, -1.0), len(names))
                for name, x in zip(names.tolist(), v, strict=True):
                    total[name] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(lean(run), "lang string, v array<double>")
    sums = rows.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    found = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in sums.collect())  # a row of DIM numbers for each language
    if not found:
        return [], np.zeros((0, dim))
    p = np.array([v for _, v in found])
    return [x for x, _ in found], p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def judged(e: Encoder, texts: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the best prototype, its cosine, whether there are trigrams) of each text; with no prototype all are 0."""
    best, score, some = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
    for v, has in e.bundles(texts):
        cos = (v @ vectors.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        k = cos.argmax(1) if len(vectors) else np.zeros(len(v), np.int64)
        best.append(k)
        score.append(np.where(has, cos[np.arange(len(k)), k], 0) if len(vectors) else np.zeros(len(v)))
        some.append(has)
    return np.concatenate(best), np.concatenate(score), np.concatenate(some)


def identify(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, labels = Encoder(vectors.shape[1]), np.array([*names, UNKNOWN], object)
        for batch in batches:
            best, score, some = judged(e, batch.column(1), vectors)
            best = np.where(some & bool(names), best, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels[best], pa.string()), pa.array(np.round(np.clip(score, 0, 1), 6), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document, learned from docs' own labels outside the held-out fold."""
    return identify(docs, *prototypes(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, learned: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """docs without those whose language can't be told, by their cosine with prototypes learned from docs or given; columns stay."""
    names, vectors = learned or prototypes(docs)
    least, columns = CHANCE / np.sqrt(vectors.shape[1]), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(vectors.shape[1])
        for batch in batches:
            _, score, some = judged(e, batch.column(batch.schema.get_field_index("text")), vectors)
            yield batch.filter(pa.array(some & ((score > least) | (not names))))

    return docs.select(columns).mapInArrow(lean(run), docs.schema)
