"""The stored text index: exact against a loop, with fewer blocks read."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from keymoment.operators import lexical, postings
from keymoment.sources.files import open_folder, shared_folder


def brute(docs, queries, k):
    tf = {}
    for d, t in docs:
        tf.setdefault(d, Counter()).update((t or "").split())
    tf = {d: c for d, c in tf.items() if c}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / max(1, len(tf))
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for q, text in queries:
        terms, scores = Counter(text.split()), {}
        for d, c in tf.items():
            own = [m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, m in terms.items() if t in c]
            if own:
                scores[d] = round(sum(own), 5)
        out += [(q, d, s, i + 1) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(r.choices(words, [1 / (1 + j) for j in range(400)], k=r.randint(3, 60)))) for i in range(3000)]
    docs += [(3001, None), (3002, ""), (3003, "w399 w399 only here rare"), (3004, "w399 w399 only here rare"), (7, "again w398")]  # a null, an empty, a tie, a key that repeats
    df = spark.createDataFrame(docs, "doc long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    return docs, postings.build(df, "doc", tokens, shared_folder(spark, "test-index"), width=16, buckets=8)


QUERIES = [(1, "rare w399 w3"), (2, "w380 w390 w0"), (3, "nowhere"), (4, "w1 w1 w2"), (5, "here again w17")]


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_best_documents(spark, corpus, k):
    docs, index = corpus
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    terms = lexical.query_terms(queries, F.split("text", " "))
    found = postings.search(spark, index, terms, k)
    got, want = sorted((r.query_id, r.doc, r.score, r.rnk) for r in found.top.collect()), sorted(brute(docs, QUERIES, k))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(got, want, strict=True))
    read, every = found.read.count(), postings.search(spark, index, terms, k, prune=False).read.count()
    assert read < 0.5 * every if k == 1 else read <= every


def test_reopened_and_its_folders(spark, corpus):
    _, index = corpus
    again = postings.opened(index.path)
    assert again == index and again.n_docs == 3002 and again.blocks(spark).agg(F.max("n")).first()[0] <= 16
    assert again.terms(spark).where("term = 'rare'").first().df == 2
    plan = postings._of_terms(again.blocks(spark), again, ["rare"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,rare\)", plan)


def test_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    index = postings.build(empty, "doc", F.split("text", " "), shared_folder(spark, "test-index"))
    terms = spark.createDataFrame([(1, "a", 1)], "query_id long, term string, qtf long")
    assert index.n_docs == 0 and postings.search(spark, index, terms).top.count() == 0


def test_hits_stay_with_their_shards(spark, corpus):
    """Documents' scores are summed where their blocks are, and the index holds its postings once."""
    _, index = corpus
    terms = lexical.query_terms(spark.createDataFrame(QUERIES, "query_id long, text string"), F.split("text", " "))
    plan = postings.search(spark, index, terms, 10).top._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(shard", plan) and not re.search(r"hashpartitioning\([^)]*doc", plan)
    fs, where = open_folder(index.path)
    assert {f.base_name for f in fs.get_file_info(FileSelector(where))} == {"blocks", "places", "index.json"}
