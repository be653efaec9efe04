"""Small worked examples of the scoring, tokenizing, fusion and search rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keymoment.functions import text
from keymoment.operators import evaluate, fusion, lexical, vector, windows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_moment_answer_sequence_scores(spark):
    f = lambda v, x: evaluate.moment_score(F.lit(v), F.lit(x), F.lit("L01"), F.lit(500), F.lit(510))
    assert list(one(spark, f("L01", 505).alias("a"), f("L01", 600).alias("b"), f("L02", 505).alias("c"), f("L01", 500).alias("d"), f("L01", 510).alias("e"), f("L01", 499).alias("g"))) == [1, 0, 0, 1, 1, 0]
    a = lambda x, y: evaluate.answer_score(F.lit(1.0), F.lit(x), F.lit(y))
    assert list(one(spark, a("màu xanh", "Màu xanh.").alias("a"), a("màu đỏ", "màu xanh").alias("b"), a("", "x").alias("c"))) == [1, 0, 0]
    spans = F.array(*[F.array(F.lit(p), F.lit(q)) for p, q in ((95, 105), (145, 155), (195, 205), (245, 255))])
    s = lambda v, *x: evaluate.sequence_score(F.lit(v), F.array(*map(F.lit, x)), F.lit("L01"), spans)
    assert list(one(spark, s("L01", 101, 156, 203, 251).alias("a"), s("L01", 101, 150, 203, 251).alias("b"), s("L02", 101, 150, 203, 251).alias("c"), s("L01", 101).alias("d"))) == [0.75, 1.0, 0.0, 0.25]


def test_tokens_and_passages(spark):
    assert {"măng_tây", "chiên_bột", "măng"} <= set(one(spark, text.tokens(F.lit("măng tây chiên bột")).alias("t"))["t"])
    assert one(spark, text.tokens(F.lit("và là")).alias("t"))["t"] == []
    assert one(spark, text.folded(F.lit("Măng")).alias("t"))["t"] == "măng"
    cues = spark.createDataFrame([("v", 0, 0.0, "xin chào các bạn"), ("v", 20, 60.0, "cắt củ năng hạt lựu"), ("v", 40, 120.0, "cho vào nồi")], "video string, turn int, start double, text string")
    q = lexical.query_terms(spark.createDataFrame([(1, "cắt củ năng hạt lựu")], "query_id int, text string"), text.tokens(F.col("text")))
    idf = q.select("term", F.lit(1.0).alias("idf"))
    assert lexical.best_passage(cues, q, idf, text.tokens(F.col("text"))).first()["start"] == 60.0
    docs = spark.createDataFrame([("a", "củ năng"), ("b", "củ năng " + " ".join(f"w{i}" for i in range(800))), ("c", "khác hẳn")], "d string, t string")
    got = {r["d"]: r["score"] for r in lexical.bm25(lexical.postings(docs, "d", text.tokens(F.col("t"))), "d", lexical.query_terms(spark.createDataFrame([(1, "củ năng")], "query_id int, text string"), text.tokens(F.col("text")))).collect()}
    assert got["a"] > got["b"] and "c" not in got


def test_colours_and_tasks(spark):
    want = {(220, 30, 30): "đỏ", (240, 200, 30): "vàng", (30, 140, 60): "xanh lá", (40, 90, 210): "xanh dương", (250, 250, 250): "trắng", (8, 8, 8): "đen", (128, 128, 128): "xám"}
    df = spark.createDataFrame(list(want), "r int, g int, b int")
    got = {(x["r"], x["g"], x["b"]): x["c"] for x in df.select("r", "g", "b", text.colour_in_vietnamese(text.colour_class(F.col("r"), F.col("g"), F.col("b"))).alias("c")).collect()}
    assert got == want
    assert list(one(spark, text.task_of(F.lit("query-7-vqa.txt")).alias("a"), text.task_of(F.lit("something-else.txt")).alias("b"), text.task_of(F.lit("query-1-trake.txt")).alias("c"))) == ["qa", "kis", "trake"]


def test_fusion_of_one_present_channel_is_its_zscore(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.5), (1, 3, 0.9)], "q int, gid int, score double")
    z = fusion.row_zscore(df, ["q"], "score", "zs").withColumn("zs_active", F.lit(True)).withColumn("zt", F.lit(0.0)).withColumn("zt_active", F.lit(False))
    for r in z.select("zs", fusion.fuse(z, ["zs", "zt"], [0.7, 0.3]).alias("f"), fusion.fuse(z, ["zs", "zt"], [0.7, 0.3], F.lit(0.0)).alias("none")).collect():
        assert r["f"] == pytest.approx(r["zs"]) and r["none"] == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "gid long, v array<double>")
    assert [r["u"] for r in v.orderBy("gid").select(vector.unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    q = v.select(F.col("gid").alias("query_id"), F.col("v").alias("q"))
    top = {(r["query_id"], r["gid"], r["score"]) for r in vector.top_similar(v, q, "v", "q", 1).collect()}
    assert top == {(1, 1, 25.0), (2, 1, 0.0)}
    assert vector.top_similar(v, q.limit(0), "v", "q", 1).count() == 0
    hinted = lambda x: "UnresolvedHint" in x._jdf.queryExecution().logical().toString() or "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(vector.broadcast_if_small(q, 2)) and not hinted(vector.broadcast_if_small(q, 1))


def test_peak_without_neighbours_keeps_its_score(spark):
    items = spark.createDataFrame([(i, "v", i) for i in range(5)], "gid long, video_id string, n int")
    hits = spark.createDataFrame([("q", 0, "v", 0.5), ("q", 2, "v", 0.4), ("q", 3, "v", 0.8)], "query_id string, gid long, video_id string, score double")
    got = {r["gid"]: r["bumped"] for r in windows.local_peak(hits, items).collect()}
    assert got[0] == 0.5 and got[2] == 0.4 and got[3] == pytest.approx(0.8 + 0.01 * 0.4 / 0.8)
