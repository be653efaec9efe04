"""What shows in larger tables only, on small ones made for it."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from test_oracle import kinds, rows

import __spark_entry__  # noqa: F401  registers the queries
from keymoment.plans.registry import ORACLE, QUERIES


def same(spark, folder, name, **tables):
    """Whether a query gives DuckDB's rows over these tables; the number of rows."""
    db = duckdb.connect()
    for t, pdf in tables.items():
        spark.createDataFrame(pdf[0], pdf[1]).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(folder)).toArrow(), db.sql(ORACLE[name]).to_arrow_table()
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)
    return got.num_rows


VECTORS = "vec_id long, label int, embedding array<float>"


def vectors(x):
    return pd.DataFrame({"vec_id": np.arange(len(x)), "label": 0, "embedding": [r.astype(float).tolist() for r in x]}), VECTORS


def test_picture_names_of_a_long_video(spark, tmp_path):
    """Past 9,999 items a name has five digits: cut to four, it was another item's."""
    x = np.random.default_rng(2).normal(0, 0.3, (10_020, 64))
    assert same(spark, tmp_path, "a7_picture_vectors", embeddings=vectors(x)) == 10_020


def test_halves_are_ranked_as_decimals(spark, tmp_path):
    """Scores such as 0.145, whose binary value times 100 is under 14.5."""
    x = np.zeros((40, 2))
    x[:4, 0] = 1
    x[4:, 0] = np.arange(36) * 0.01 + 0.005
    assert same(spark, tmp_path, "e12_rank_bounds", embeddings=vectors(x)) == 38


def test_scores_stay_where_they_are(spark):
    """Statistics and answers of all scores come to the scores: no exchange but those of the items' numbering and of aggregates."""
    from pyspark.sql import functions as F

    from keymoment.operators import evaluate, fusion

    s = spark.range(10_000).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("gid"), F.lit("V000").alias("video_id"), F.col("id").alias("frame_idx"), F.rand(1).alias("score"))
    truth = spark.range(50).select(F.col("id").alias("query_id"), F.lit("V000").alias("truth"), F.lit(0).alias("lo"), F.lit(500).alias("hi"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (fusion.row_zscore(s, ["query_id"], "score", "z"), evaluate.strict_ranks(s, truth))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)


def test_hits_of_queries_are_not_shuffled(spark):
    """Terms of queries come to a document's postings; no exchange lies between that join and the sums by query and document."""
    from pyspark.sql import functions as F

    from keymoment.operators import lexical

    docs = spark.range(500).select("id", F.array(F.lit("a"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("t"))
    terms = spark.range(50).select(F.col("id").alias("query_id"), F.lit("a").alias("term"), F.lit(1).alias("qtf"))
    post = lexical.postings(docs, "id", F.col("t"), terms)
    plan = lexical.bm25(post, "id", terms, dl=lexical.text_lengths(docs, "id", F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan


def test_sparse_channels_and_pairs_come_to_the_items(spark):
    """With more rows than are sent to tasks, channels are dealt by item and pairs of queries are scored in one row."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d = "/root/testdata/sf0.001"
        channels = QUERIES["k2_channel_rows"](spark, d)._jdf.queryExecution().executedPlan().toString()
        paired = QUERIES["k14_pairs_hm"](spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for plan in (channels, paired):  # the plan's top, down to the scores, has neither an exchange nor a join
        assert not any(x in plan[: plan.index("MapInArrow")] for x in ("Exchange", "Join"))


def test_pairs_of_parts_of_a_video(spark, monkeypatch):
    """A video cut into parts gives the windows' values, across the cuts too."""
    from pyspark.sql import functions as F

    from keymoment.operators import fusion, vector

    r = np.random.default_rng(4)
    items = spark.createDataFrame([(i, f"V{i % 2}", i // 2 + 1, [float(x) for x in r.normal(0, 1, 4)]) for i in range(60)], "gid long, video_id string, n long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [float(x) for x in r.normal(0, 1, 4)], [float(x) for x in r.normal(0, 1, 4)]) for q in range(3)], "query_id long, qv array<double>, qw array<double>")
    monkeypatch.setattr(fusion, "PART", 7)
    both = vector.products(items, queries, "v", {"a": "qv", "b": "qw"}).withColumns({c: F.greatest(c, F.lit(0.0)) for c in "ab"})
    for how in ("hm", "product", "a"):
        want = fusion.pair_score(both, ["query_id", "video_id"], "n", "a", "b", 5, how).select("query_id", "gid", "paired")
        assert sorted(fusion.pair_scores(items, queries, 5, how).collect()) == sorted(want.collect())


def test_queries_that_share_hits(spark):
    """A provider's hits of a group of queries are not made for each query of it."""
    plan = QUERIES["q2_hit_provider"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_m" in plan


def test_chains_of_products(spark, monkeypatch):
    """Chains where the items are give the windows' chains, ties and short videos too, and scores aren't shuffled."""
    from pyspark.sql import functions as F

    from keymoment.operators import align, vector

    r = np.random.default_rng(6)
    items = spark.createDataFrame([(i, "V1" if i < 4 else f"V{2 + i % 2}", i % 40 + 1 if i < 4 else i // 2 + 1, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(70)], "gid long, video_id string, n long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(q, e, [float(x) for x in r.integers(-1, 2, 3)]) for q in range(9) for e in range(3)], "query_id long, event_idx long, qv array<double>")
    monkeypatch.setattr(align, "CELLS", 100)
    for lam, gap, skip in ((0.01, 2, 1), (0.0, 1, 0)):
        s = vector.products(items.where(F.col("n") > skip), queries, "v", {"score": "qv"}).withColumn("t", F.col("n") - 1)
        got = align.chain_products(items, queries, 3, lam, gap, skip)
        assert sorted(got.collect()) == sorted(align.chain(s, 3, lam, gap).collect())
        assert "hashpartitioning(query_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_shaken_searches_leave_pairs_where_they_are(spark, monkeypatch):
    """The best by shaken scores among few pairs is the best among all, with ties, copies, bad numbers and a floor of one item too; no query asks for all pairs."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from keymoment.operators import evaluate, vector

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 1, (200, 4)), np.repeat(r.integers(-1, 2, (5, 4)).astype(float), 30, axis=0), np.full((2, 4), np.nan)])
    monkeypatch.setattr(vector, "CELLS", 2000)
    for rows, head in ((x[:-2], 1), (x, 16)):
        items = spark.createDataFrame([(i, None if i == 7 else v.tolist()) for i, v in enumerate(rows)], "gid long, v array<double>").repartition(3)
        queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([r.normal(0, 1, (5, 4)), np.zeros((1, 4)), np.eye(4)]))], "query_id long, qv array<double>")
        shaken = F.round(F.col("score") + 0.5 * (evaluate.draw(31, "query_id", "gid") - 0.5), 6)
        whole = vector.similarities(items, queries, "v", "qv").withColumn("by", shaken)
        want = [{r.query_id: r.gid for r in whole.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "gid"))).where("r = 1").collect()} for c in ("score", "by")]
        assert [{r.query_id: r.gid for r in t.collect()} for t in vector.top_shaken(items, queries, "v", "qv", shaken, 0.25, head)] == want

    monkeypatch.setattr(vector, "products", lambda *a, **b: 1 / 0)
    assert QUERIES["n26_rerun_flips"](spark, "/root/testdata/sf0.001").count() == 1


def test_ranks_are_counted_where_items_are(spark, monkeypatch):
    """Ranks of products, with copies of the answer, answers of several items, bad numbers and queries without an answer, are those by rows of all scores; no query makes such rows."""
    from pyspark.sql import functions as F

    from keymoment.operators import evaluate, vector

    r = np.random.default_rng(9)
    x = r.integers(-2, 3, (90, 3)).astype(float)
    x[:3] = np.nan
    items = spark.createDataFrame([(i, f"V{i % 3}", i // 3, None if i == 40 else v.tolist()) for i, v in enumerate(x)], "gid long, video_id string, frame_idx long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, r.normal(0, 1, 3).tolist(), r.normal(0, 1, 3).tolist()) for i in range(20)], "query_id long, qv array<double>, c array<double>")
    truth = spark.createDataFrame([(i, f"V{i % 3}", i % 5, i % 5 + i % 4) for i in range(18)] + [(18, "V9", 0, 9)], "query_id long, truth string, lo long, hi long")
    two = vector.products(items, queries, "v", {"s": "qv", "f": "c"}, digits=None)
    monkeypatch.setattr(vector, "CELLS", 100)
    for vectors, score, column in ((["qv"], lambda s: vector.rounded(s, 6), F.round("s", 6)), (["qv", "c"], lambda s, f: vector.rounded(vector.rounded(s, 6) + 0.3 * f, 5), F.round(F.round("s", 6) + 0.3 * F.col("f"), 5))):
        want = evaluate.strict_ranks(two.withColumn("score", column), truth)
        got = evaluate.product_ranks(items, queries, truth, "v", vectors, score)
        assert sorted(got.collect()) == sorted(want.collect()) and 0 < want.count() <= 18
    assert vector.rounded(np.array([0.5, 1.5, 2.5, -0.5, -2.5, 0.49, np.nan, np.inf]), 0).tolist()[:6] == [1, 2, 3, -1, -3, 0]

    monkeypatch.setattr(vector, "products", lambda *a, **b: 1 / 0)
    for name in ("n22_paired", "n22_strict_ranks"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_normalised_products_are_made_where_items_are(spark, monkeypatch):
    """Parts of videos give the values of normalise(), with missing vectors, a video of one item and one of copies too; a block leaves in order; no query joins statistics to rows of all pairs."""
    from keymoment.operators import vector, windows

    r = np.random.default_rng(10)
    x = r.normal(0, 1, (70, 4))
    x[1::3] = x[1]
    rows = [(i, "V9" if i == 69 else f"V{i % 3}", 1 if i == 69 else i // 3 + 1, None if i == 12 else v.tolist()) for i, v in enumerate(x)]
    items = spark.createDataFrame(rows, "gid long, video_id string, n long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(5 * i, r.normal(0, 1, 4).tolist()) for i in range(9)] + [(3, None)], "query_id long, qv array<double>")
    s = vector.similarities(items, queries, "v", "qv")
    monkeypatch.setattr(windows, "query_blocks", lambda df, key: vector.query_blocks(df, key, 4))
    monkeypatch.setattr(windows, "PART", 7)
    monkeypatch.setattr(windows, "SORTED", 20)
    for how in ("mean", "zscore", "minmax"):
        want = {(w.query_id, w.gid): w.normal for w in windows.normalise(s, ["query_id", "video_id"], ["query_id"], "score", how, 0.5, 6).collect()}
        found = windows.normal_products(items, queries, how, 0.5, 6).collect()
        got = {(w.query_id, w.gid): w.normal for w in found}
        assert len(found) == len(got) == len(want) == 69 * 9 and got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1.5e-6
    monkeypatch.setattr(windows, "query_blocks", vector.query_blocks)
    monkeypatch.setattr(windows, "PART", 100)
    monkeypatch.setattr(windows, "SORTED", 10_000)
    block = [w.normal for w in windows.normal_products(items.where("video_id = 'V0'"), queries, "mean").collect()]
    assert block == sorted(block)
    assert windows.normal_products(items, queries.limit(0), "mean").count() == windows.normal_products(items.limit(0), queries, "mean").count() == 0

    monkeypatch.setattr(vector, "products", lambda *a, **b: 1 / 0)
    assert QUERIES["h6_normal_mean"](spark, "/root/testdata/sf0.001").count() == 5_000
