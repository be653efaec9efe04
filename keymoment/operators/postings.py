"""A stored text index: postings in blocks with their largest score, and top-k search that reads the blocks that can matter.

Documents are dealt to shards of `width` documents; a block is a term's postings in a shard, so no group is larger than a shard however common
a term is. A block row holds its documents, their BM25 parts without the term's weight, and the largest part. The table is partitioned by a hash of
the term and its files are sorted by it, so a batch of queries opens the folders of its terms only, and within them the row groups.

Texts are dealt to the tasks of their shards once, before they are cut into words; postings and blocks are made where the texts are. In a search, blocks of the
queries' terms are dealt by shard, and the queries come to them: hits, which are queries times postings, aren't shuffled.

A search makes two passes over (query, shard) pairs, both aggregations: the largest parts bound a shard's best score for a query. The k shards of
the largest bounds are read first; the k-th best score found there is a floor, and only shards whose bound reaches it are read whole. All
others can't hold one of the k best, so the result is exact, ties included.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.sources.files import open_folder, shared_folder, swept

from .fusion import kept
from .lexical import MOST_TERMS, bm25_idf
from .topk import top_per_group
from .vector import broadcast_if_small

#: Terms of a batch up to which the scan gets them as a list, so the reader can skip row groups; more are joined only.
LISTED = 5000
#: Documents whose places go with the tasks (more are joined by a shuffle), and documents in a task, about.
MOST_PLACES, TASK_DOCS = 1_000_000, 4096


class Index(NamedTuple):
    """Where an index is, and its collection's numbers."""

    path: str
    key: str
    kind: str  # of the key, as in DDL
    n_docs: int
    mean_length: float
    shards: int
    buckets: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        """(term, shard, n, most, docs, parts)."""
        return spark.read.schema(f"term string, shard long, n long, most double, docs array<{self.kind}>, parts array<double>, bucket int").parquet(f"{self.path}/blocks")

    def terms(self, spark: SparkSession) -> DataFrame:
        """(bucket, term, df), counted from the blocks of the terms that are asked for."""
        return self.blocks(spark).groupBy("bucket", "term").agg(F.sum("n").alias("df"))


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, key: str, tokens: Column, path: str, cluster: list[str] | None = None, k1: float = 1.2, b: float = 0.75, width: int = 32, buckets: int = 32) -> Index:
    """Writes the index of docs at path (a new folder). Documents are read and cut into words twice, for their lengths and for their postings;
    a null text has no words, rows of one key are one document. tokens should be without Python functions, behind which Spark deals rows anew.

    Shards are neighbours in order of the columns of cluster (a document's least value counts) and of length: the more alike they are, the tighter their bounds.
    """
    cluster = cluster or []
    spark = docs.sparkSession
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    lengths = docs.select(key, *cluster, F.size(tokens).alias("dl")).groupBy(key).agg(F.sum("dl").alias("dl"), *(F.min(c).alias(c) for c in cluster)).where("dl > 0")
    own = kept(lengths, "lengths")
    n_docs, mean = own.agg(F.count("*"), F.avg("dl")).first()
    mean = float(mean or 1.0)
    # Places in order within range partitions, written, as they are counted by task; a shard never crosses partitions.
    row = F.monotonically_increasing_id()
    shard = (F.shiftright(row, 33) * (1 << 28) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / width)).cast("long")
    ranges = max(1, min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), n_docs // (8 * width)))
    own.repartitionByRange(ranges, *cluster, "dl", key).sortWithinPartitions(*cluster, "dl", key).select(key, "dl", shard.alias("shard")).write.parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    # Dealt as texts: what follows groups by shard and more, so nothing else is shuffled.
    dealt = docs.drop(*{"dl", "shard"} & set(docs.columns)).join(broadcast_if_small(places, MOST_PLACES), key).repartition(_tasks(spark, n_docs), "shard")
    post = dealt.select("shard", F.col(key).alias("doc"), "dl", F.explode(tokens).alias("term")).groupBy("shard", "doc", "dl", "term").agg(F.count("*").alias("tf")).withColumn("part", part)
    block = post.groupBy("term", "shard").agg(F.count("*").alias("n"), F.max("part").alias("most"), F.sort_array(F.collect_list(F.struct("doc", "part"))).alias("p"))
    block = block.select("term", "shard", "n", "most", F.col("p.doc").alias("docs"), F.col("p.part").alias("parts"), _bucket("term", buckets).alias("bucket"))
    with swept(spark):
        block.sortWithinPartitions("bucket", "term", "shard").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    kind = docs.schema[key].dataType.simpleString()
    out = Index(path, key, kind, n_docs, mean, places.select("shard").distinct().count(), buckets)
    fs, where = open_folder(path)
    with fs.open_output_stream(f"{where}/index.json") as f:  # last, so a folder without it is no index
        f.write(json.dumps(out._asdict()).encode())
    return out


def opened(path: str) -> Index:
    fs, where = open_folder(path)
    with fs.open_input_stream(f"{where}/index.json") as f:
        return Index(**json.loads(f.read()))


def _tasks(spark: SparkSession, n_docs: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // TASK_DOCS)


def _of_terms(df: DataFrame, index: Index, listed: list[str] | None) -> DataFrame:
    """df's rows whose folder and, if they are listed, whose term a batch asks for."""
    if listed is None:
        return df
    rows = df.sparkSession.createDataFrame([(t,) for t in listed], "term string")
    wanted = sorted(r[0] for r in rows.select(_bucket("term", index.buckets)).distinct().collect())
    return df.where(F.col("bucket").isin(wanted) & F.col("term").isin(listed))


class Search(NamedTuple):
    """The steps of a search, each a plan: bounds, floors, the blocks read, the result."""

    bounds: DataFrame
    floors: DataFrame
    read: DataFrame
    top: DataFrame


def search(
    spark: SparkSession, index: Index, terms: DataFrame, k: int = 100, idf: Callable[[Column, Column], Column] = bm25_idf, idf_over: float | None = None, least_terms: int = 1, digits: int = 5, prune: bool = True
) -> Search:
    """top: (query_id, doc, score, rnk), the k best documents of each query of terms(query_id, term, qtf), rounded; ties go to the smaller doc.

    idf weighs a term by (documents, documents with it); terms that weigh idf_over or less are left out, and documents with fewer than
    least_terms of a query's terms. Terms of a batch are sent to the tasks behind a count of them. prune=False reads every block of the terms.
    """
    listed = [r[0] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]  # bounded by LISTED
    known = None if len(listed) > LISTED else listed
    wanted = broadcast_if_small(terms.select("term").distinct(), MOST_TERMS)
    blocks = _of_terms(index.blocks(spark), index, known).join(wanted, "term", "left_semi")
    own = blocks.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf(F.lit(index.n_docs), F.col("df")).alias("idf"))
    own = own if idf_over is None else own.where(F.col("idf") > idf_over)
    path = shared_folder(spark, "weights")  # a batch's terms are cut and weighed once; the caller's cluster clears the folder
    terms.join(own, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")).coalesce(8).write.parquet(path)
    weights = broadcast_if_small(spark.read.parquet(path), MOST_TERMS)
    tasks = _tasks(spark, index.n_docs)
    most = blocks.select("term", "shard", "most").repartition(tasks, "shard").join(weights, "term")
    bounds = kept(most.groupBy("shard", "query_id").agg((F.sum(F.col("most") * F.col("weight")) * (1 + 1e-9) + 10.0**-digits).alias("bound")).select("query_id", "shard", "bound"), "bounds")

    def best(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = shards.repartition(tasks, "shard").groupBy("shard").agg(F.collect_list("query_id").alias("_asked"))
        held = blocks.select("term", "shard", "docs", "parts").repartition(tasks, "shard").join(asked.hint("merge"), "shard")
        read = held.join(weights, "term").where(F.array_contains("_asked", F.col("query_id"))).drop("_asked")
        each = read.select("query_id", "shard", "weight", F.explode(F.arrays_zip("docs", "parts")).alias("p"))
        score = F.round(F.sum(F.col("weight") * F.col("p.parts")), digits)
        scored = each.groupBy("shard", "query_id", F.col("p.docs").alias("doc")).agg(score.alias("score"), F.count("*").alias("matched")).where(F.col("matched") >= least_terms).select("query_id", "doc", "score")
        return read, top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("doc")], k)

    if not prune:
        read, top = best(bounds)
        return Search(bounds, bounds.limit(0), read, top)
    first = top_per_group(bounds, ["query_id"], [F.desc("bound"), F.asc("shard")], k)
    floors = best(first.where(F.col("rnk") <= _probes(k, index)))[1].where(F.col("rnk") == k).select("query_id", F.col("score").alias("floor"))
    floors = broadcast_if_small(kept(floors, "floors"), MOST_TERMS)  # one row for each query
    read, top = best(bounds.join(floors, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0))))
    return Search(bounds, floors, read, top)


def _probes(k: int, index: Index) -> int:
    """Shards that are read for the floor: about as many as hold twice k documents, and a few."""
    return min(k, 4 + 2 * k * index.shards // max(1, index.n_docs))
