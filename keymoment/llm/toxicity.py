"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences and only bags have labels. A sentence's score is a logistic function of its hashed
words and their beginnings of 4 and 5 bytes (each counts once a sentence), a document's the noisy-or 1 - prod(1 - score) of its sentences' scores.
The weights are trained through the noisy-or from document labels, by Adam with an L1 shrinkage step that leaves few words.
Scoring adds weights by sentence with numpy over whole buffers and gives back the offending sentences' places.

Training takes a sample of at most TRAIN_DOCS labelled documents outside the held-out fold, in order of a hash of
doc_id; it is read through a broadcast of those ids, whose size TRAIN_DOCS bounds.

Defined cases: null or empty text has no sentence and gets the model's score for an empty sentence; without a label to
learn from the score is 0; of labels that repeat a doc_id the largest counts, null ones don't; a null doc_id is
scored and not learned from; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .split import held_out, learnable
from .words import NOT_ALNUM, mix, prefixes, text_buffers, words_of

TRAIN_DOCS, BITS, EPOCHS, THRESHOLD = 8_000, 23, 120, 0.3
MIN_DOCS, LIFT, SHRINK = 6, 2.0, 3e-4
PREFIXES = (4, 5)
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True  # newline ! . ?


def _sentences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of rows: (first row, features' offsets by row, and of each feature: its word's start, number, sentence in the group)."""
    offsets, data = text_buffers(column)
    kinds = 1 + len(PREFIXES)
    for i, j, at, starts, ends, h in words_of(offsets, data, breaks=NOT_ALNUM):
        a, b = int(offsets[i]), int(offsets[j])
        marks = np.concatenate([[0], np.cumsum(_END[data[a:b]])])
        row = np.repeat(np.arange(j - i), np.diff(at))
        f = np.stack([h, *(mix(prefixes(data, starts, ends, k)) for k in PREFIXES)], 1).reshape(-1)
        yield i, at * kinds, np.repeat(starts, kinds), (f >> np.uint64(64 - BITS)).astype(np.int64), np.repeat(marks[starts - a] + row, kinds)


def _bags(docs: DataFrame) -> DataFrame:
    """(y, sentences, features) of docs(text, y): distinct (sentence, feature) pairs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent, feat = [], []
            for _, at, _, f, s in _sentences(batch.column(0)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.unique(s[a:b] << BITS | f[a:b])
                    k = own >> BITS
                    sent.append(np.unique(k, return_inverse=True)[1].astype("<u4").tobytes() if len(k) else b"")
                    feat.append((own & ((1 << BITS) - 1)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sent, pa.binary()), pa.array(feat, pa.binary())], names=["y", "sentences", "features"])

    return docs.select("text", F.col("y").cast("int")).mapInArrow(lean(run), "y int, sentences binary, features binary")


def gradient(y: np.ndarray, f: np.ndarray, s: np.ndarray, bag: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """(by weight, by bias) of the mean log loss of bags under noisy-or: a bag is toxic with 1 - product of (1 - p of its sentences)."""
    z = np.bincount(s, w[f], minlength=len(bag)) + b
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
    some = np.maximum(1 - none, 1e-9)
    g = np.where(y == 1, -none / some, 1.0)[bag] * p / len(y)  # by sentence
    return np.bincount(f, g[s], minlength=len(w)), float(g.sum())


def _adam(y: np.ndarray, f: np.ndarray, s: np.ndarray, bag: np.ndarray, w: np.ndarray, b: float, epochs: int, shrink: float) -> tuple[np.ndarray, float]:
    """(weights, bias) after so many full steps; f and s are the features and sentences of the entries, bag of each sentence."""
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.15
    for t in range(1, epochs + 1):
        gw, gb = gradient(y, f, s, bag, w, b)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, c = 1 - 0.9**t, 1 - 0.999**t
        scale = rate / (np.sqrt(v / c) + 1e-6)
        w = w - scale * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * shrink, 0)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return w, b


def fit(y: np.ndarray, sentences: list[np.ndarray], features: list[np.ndarray], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, their weights, the bias) from bags.

    Features are screened first: those in MIN_DOCS toxic documents or more (fewer in small samples), LIFT times as often
    there as in others, get a weight.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0), -30.0
    keep = [i for i in range(len(y)) if len(features[i])]
    if not keep or not y[keep].any():
        return nothing
    y = y[keep].astype(np.float64)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for k, i in enumerate(keep):
        seen[int(y[k] > 0), np.unique(features[i])] += 1
    least = min(MIN_DOCS, max(2, int(y.sum()) // 10))
    names = np.flatnonzero((seen[1] >= least) & (seen[1] * max(1, int((y == 0).sum())) >= LIFT * seen[0] * float(y.sum())))
    del seen
    number = np.full(1 << BITS, -1, np.int32)
    number[names] = np.arange(len(names))
    flat, row_starts, bag_of, base = [], [], [], 0
    for k, i in enumerate(keep):
        n = int(sentences[i].max()) + 1
        f, s = number[features[i]], sentences[i].astype(np.int64) + base
        ok = f >= 0
        flat.append(f[ok])
        row_starts.append(s[ok])
        bag_of.append(np.full(n, k, np.int32))
        base += n
    f, s, bag = np.concatenate(flat), np.concatenate(row_starts), np.concatenate(bag_of)
    b = np.log(max(y.mean(), 1e-3)) - np.log(base / len(y)) - 1.0
    w, b = _adam(y, f, s, bag, np.zeros(len(names)), b, epochs, SHRINK)
    left = w != 0  # what the shrinkage has left is trained again without it
    number = np.where(left, np.cumsum(left) - 1, -1)[f]
    w, b = _adam(y, number[number >= 0], s[number >= 0], bag, w[left], b, epochs, 0.0)
    return names[left], w, float(b)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    known = labels.where(learnable() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("text", "y")
    got = _bags(rows).toPandas()
    return fit(got["y"].to_numpy(), [np.frombuffer(x, "<u4") for x in got["sentences"]], [np.frombuffer(x, "<u4") for x in got["features"]])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], locate: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): sentences are those that score locate or more, with character offsets."""
    kept, values, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[kept] = values
        log_not_empty = -np.logaddexp(0, bias)
        for batch in batches:
            texts = batch.column(1)
            offsets, data = text_buffers(texts)
            out, found = np.full(batch.num_rows, 1 - np.exp(log_not_empty)), [[] for _ in range(batch.num_rows)]
            for i, at, starts, f, s in _sentences(texts):
                n = len(at) - 1
                if not len(f):
                    continue
                hot = np.flatnonzero(w[f])
                if len(hot):  # a word counts once a sentence
                    _, first = np.unique(s[hot] << BITS | f[hot], return_index=True)
                    hot = hot[first]
                cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                number = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
                z = np.bincount(number[hot], w[f[hot]], minlength=len(cuts)) + bias
                row = np.searchsorted(at, cuts, "right") - 1
                total = np.bincount(row, -np.logaddexp(0, z), minlength=n)
                some = np.diff(at) > 0
                out[i : i + n] = np.where(some, 1 - np.exp(total), out[i : i + n])
                for k in np.flatnonzero(z >= np.log(locate / (1 - locate))).tolist():
                    r = i + int(row[k])
                    a = int(starts[cuts[k]])
                    e = int(offsets[r + 1]) if k + 1 == len(cuts) or row[k + 1] != row[k] else int(starts[cuts[k + 1]])
                    base = int(offsets[r])
                    head = len(data[base:a].tobytes().decode())
                    own = data[a:e].tobytes().decode().rstrip()
                    found[r].append({"start": head, "end": head + len(own), "score": round(float(1 / (1 + np.exp(-z[k]))), 6)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.clip(out, 0, 1), 6)), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], names=["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) of each document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")
