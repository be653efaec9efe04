"""Operator 2: quality by hierarchical empirical Bayes.

A logistic classifier on measures of a text gives each document's evidence. Hosts and, below them, paths get posterior rates of
good documents: counts are labels (learnable fold, weight 1) and classifier probabilities of other documents (weight
SOFT), summed by grouped aggregation. A host's rate is shrunk toward the global one, a path's toward its host's, with strengths that the
method of moments finds from the spread between groups; sparse sites keep close to the prior above them. A document's own count is
taken out of its site's before its evidence is added, so nothing counts twice:
    logit(score) = logit(document) + logit(path posterior) - logit(global rate).

The classifier is fitted on at most TRAIN_DOCS labelled documents of the learnable fold, in order of a hash of doc_id.
Sites are tables joined by key: partial aggregation takes hot hosts, adaptive execution splits their join.

Defined cases: a null or empty text has all measures 0; null host or path is a site of its own; without labels the score is
0.5 for all; repeated rows are scored each and count each; of labels that repeat a doc_id the smallest counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .split import held_out, learnable
from .words import text_buffers, words_of

TRAIN_DOCS, SOFT, STEPS, KEEP = 20_000, 0.25, 400, 0.5
_MOST_STRENGTH = 1e6
MEASURES = ["log_words", "word_length", "upper", "digits", "symbols", "pipes", "repeated", "distinct", "ends", "lines", "top_word", "runs"]
_CLASSES = np.zeros((5, 256), bool)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[0, _b] = _b < 128 and _c.isupper()
    _CLASSES[1, _b] = _b < 128 and _c.isdigit()
    _CLASSES[2, _b] = _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:'\"-()|"
    _CLASSES[3, _b] = _c == "|"
    _CLASSES[4, _b] = _c == "\n"


def measure(column: pa.Array) -> np.ndarray:
    """Rows x MEASURES."""
    offsets, data = text_buffers(column)
    out = np.zeros((len(column), len(MEASURES)))
    for i, _, at, starts, ends, h in words_of(offsets, data):
        for r in range(len(at) - 1):
            a, b = int(at[r]), int(at[r + 1])
            n = b - a
            if not n:
                continue
            raw = data[offsets[i + r] : offsets[i + r + 1]]
            upper, digits, symbols, pipes, lines = (_CLASSES[:, raw].sum(1) / len(raw)).tolist()
            own = np.sort(h[a:b])
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.concatenate([new, [n]]))
            same = h[a + 1 : b] == h[a : b - 1]
            tail = data[ends[a:b] - 1]
            odd_end = _CLASSES[2, tail].mean()
            repeated = 0.0
            if n > 8:
                pairs = np.unique(h[a : b - 2] * np.uint64(3) ^ h[a + 1 : b - 1] * np.uint64(7) ^ h[a + 2 : b])
                repeated = 1 - len(pairs) / (n - 2)
            out[i + r] = (np.log1p(n), (ends[a:b] - starts[a:b]).mean(), upper, digits, symbols, pipes, repeated, len(new) / n, odd_end, lines * 10, counts.max() / n, same.mean() if n > 1 else 0.0)
    return out


class Classifier:
    """Logistic regression on standardised measures and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x = self._wide(x)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, STEPS + 1):
            e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
            g = np.append(x.T @ e / len(y) + 1e-4 * w, e.mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            d = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - d[:-1], b - float(d[-1])
        self.w, self.b = w, b

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, x**2], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self._wide(x) - self.mean) / self.sd, -8, 8) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def _measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    return docs.select("text", F.col("y").cast("int")).mapInArrow(lean(run), "y int, x binary")


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    chosen = labels.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)
    got = _measures(docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("text", "y")).toPandas()  # bounded by TRAIN_DOCS
    return Classifier(np.array([np.frombuffer(x) for x in got["x"]]), got["y"].to_numpy(np.float64)) if len(got) else None


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior counts of groups(k, n) around a mean, by the method of moments over their rates."""
    rate = F.col("k") / F.col("n")
    r = groups.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * (rate - mean) ** 2).alias("s"), F.sum(F.col("n") * mean * (1 - mean)).alias("v")).first()
    if not r["n"] or r["g"] < 2:
        return _MOST_STRENGTH
    within = r["v"] / r["n"]
    between = max(r["s"] / r["n"] - within * r["g"] / r["n"], within / _MOST_STRENGTH, 1e-12)
    return float(min(max(within / between - 1, 1.0), _MOST_STRENGTH))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, held_out, p_document, host_rate, path_rate, score, keep) of each row of docs(doc_id, text)."""
    known = labels.where(learnable() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("y"))
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path"))
    model = train(docs, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model(measure(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.round(p, 9))], names=["doc_id", "host", "path", "p"])

    scored = docs.mapInArrow(lean(run), "doc_id long, host string, path string, p double")
    rows = scored.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "host", "path", "p", F.when(F.col("y").isNull(), F.lit(SOFT)).otherwise(1.0).alias("n1"), F.when(F.col("y").isNull(), F.col("p") * SOFT).otherwise(F.col("y").cast("double")).alias("k1"))
    from .store import written

    rows = written(rows, "quality")
    paths = rows.groupBy("host", "path").agg(F.sum("k1").alias("k"), F.sum("n1").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    mean = total["k"] / total["n"] if total["n"] else 0.5
    s1 = _strength(hosts, F.lit(mean))
    sites = paths.join(hosts.select("host", F.col("k").alias("hk"), F.col("n").alias("hn")), "host")
    s2 = _strength(sites, (F.col("hk") + s1 * mean) / (F.col("hn") + s1))
    joined = rows.join(sites, ["host", "path"])
    host_rate = (F.col("hk") - F.col("k1") + s1 * mean) / (F.col("hn") - F.col("n1") + s1)
    path_rate = (F.col("k") - F.col("k1") + s2 * F.col("host_rate")) / (F.col("n") - F.col("n1") + s2)
    out = joined.withColumn("host_rate", F.round(host_rate, 6)).withColumn("path_rate", F.round(path_rate, 6))
    z = _logit(F.col("p")) + _logit(F.col("path_rate")) - _logit(F.lit(float(mean)))
    score = F.round(1 / (1 + F.exp(-z)), 6)
    return out.select("doc_id", held_out().alias("held_out"), F.round("p", 6).alias("p_document"), "host_rate", "path_rate", score.alias("score"), (score >= KEEP).alias("keep"))
