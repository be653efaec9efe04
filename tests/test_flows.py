"""Streams that are killed and run again, prompts that come late, pictures in folders, ceilings: against plain loops."""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from keymoment.operators import allocate, ceilings, fusion
from keymoment.plans import answer_queries
from keymoment.plans.registry import QUERIES
from keymoment.sources import pictures
from keymoment.streaming import flows

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("moment", ["before", "half written", "after"])
def test_a_killed_stream_goes_on(spark, tmp_path, moment):
    """The second batch is killed before it writes, when its folder is half written, or when it is written but not committed."""
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id")
    for i in range(3):  # the three inputs overlap
        e.where(F.col("event_id") % 4 != i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    sink = flows.batch_sink(out, ["event_id"], lambda x: x.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))))

    def killed(df, no):
        if no != 1:
            return sink(df, no)
        if moment != "before":
            sink(df, no)
        if moment == "half written":
            os.remove(f"{out}/batch={no:09d}/_SUCCESS")
        raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        flows.run_available(stream, killed, checkpoint)
    assert flows.read_batches(spark, out).count() < 2 * e.count() or moment == "after"
    flows.run_available(stream, sink, checkpoint)
    flows.run_available(stream, sink, checkpoint)  # nothing new
    got = flows.read_batches(spark, out)
    assert got.count() == 2 * e.count() and rows(got.where("twice = 1").select("event_id", "user_id")) == rows(e)


def test_a_cache_with_nulls_ties_and_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    assert flows.read_batches(spark, out) is None
    sink = flows.batch_sink(out, ["k", "batch key"])
    make = lambda *r: spark.createDataFrame(list(r), "k long, `batch key` string, x int")
    sink(make(), 0)
    sink(make((1, "a", 1), (1, "a", 1), (None, "a", 2), (None, None, 3)), 1)
    sink(make((None, None, 9), (1, "a", 9), (2, None, 4)), 2)
    assert sorted(map(repr, (tuple(r) for r in flows.read_batches(spark, out).collect()))) == sorted(map(repr, [(1, "a", 1), (None, "a", 2), (None, None, 3), (2, None, 4)]))
    assert flows.read_batches(spark, out, before=1).count() == 0


def test_prompts_are_gathered(spark, tmp_path):
    """Complete queries at once, others when their timer runs out; repeated prompts count once; what comes after that is dropped."""
    schema = "query_id long, prompt_no long, weight double, at timestamp, v array<double>"
    at = lambda s: F.timestamp_seconds(F.lit(1704067200 + s))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # timers don't depend on it
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        out: dict[int, list] = defaultdict(list)

        def keep(df, _):
            for r in df.collect():
                out[r["query_id"]].append((r["prompts"], r["complete"], [tuple(i) for i in r["items"]]))

        def arrive(s, *prompts):
            spark.createDataFrame([(q, n, w, v) for q, n, w, v in prompts], "query_id long, prompt_no long, weight double, v array<double>").withColumn("at", at(s)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            flows.run_available(flows.gather_prompts(stream, 2, "10 minutes"), keep, str(tmp_path / "cp"))

        arrive(0, (1, 1, 0.2, [3.0, 4.0]), (1, 1, 9.0, [9.0, 9.0]), (2, 0, 0.5, [1.0, 2.0]), (3, 0, 1.0, [5.0, 6.0]))
        assert not out
        arrive(60, (1, 0, 0.8, [1.0, 2.0]), (-1, None, None, []))
        assert dict(out) == {1: [(2, True, [(0, 0.8, [1.0, 2.0]), (1, 0.2, [3.0, 4.0])])]}
        arrive(1100, (3, 1, 0.5, [7.0, 8.0]))  # the watermark is at 500: both timers still run
        assert set(out) == {1, 3} and out[3][0][1]
        arrive(7200, (-1, None, None, []))
        assert out[2] == [(1, False, [(0, 0.5, [1.0, 2.0])])]
        arrive(1, (2, 1, 0.5, [1.0, 1.0]))
        assert set(out) == {1, 2, 3} and all(len(x) == 1 for x in out.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_folders_of_pictures(spark, tmp_path):
    files = ("V2/0010.png", "V2/2.JPG", "V2/-3.jpeg", "V2/1_0.png", "V2/x7.png", "V2/notes.txt", "V2/png", "top.png", "V1/deep/1.png", "V 1/é.jpg", "V2/99999999999999999999.png", "V2/1.5.png")
    for f in files:
        p = tmp_path / "root" / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(f))
    got = {r.rel_path: (r.video_id, r.frame_idx, r.n, r.bytes) for r in pictures.scan_pictures(spark, str(tmp_path / "root")).collect()}
    want = {"V 1/é.jpg": (0, 1), "V2/-3.jpeg": (-3, 1), "V2/0010.png": (10, 2), "V2/1.5.png": (0, 3), "V2/1_0.png": (10, 4), "V2/2.JPG": (2, 5), "V2/99999999999999999999.png": (0, 6), "V2/x7.png": (0, 7)}
    assert got == {k: (k.split("/")[0], *v, len(k)) for k, v in want.items()}
    (tmp_path / "empty").mkdir()
    assert pictures.scan_pictures(spark, str(tmp_path / "empty")).count() == 0


def test_an_encoder_gets_full_batches(spark):
    def encode(contents):
        return np.array([[np.nan, 0] if c == b"bad" else [0, 0] if c == b"zero" else [3.0, 4.0 * len(contents) / 64] for c in contents])

    df = spark.range(331).select("id", F.when(F.col("id") == 5, b"bad").when(F.col("id") == 6, b"zero").when(F.col("id") == 7, None).otherwise(b"good").alias("content")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r.v for r in pictures.encode_pictures(df, encode).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 331 and got[5] is None and got[6] == [0, 0] and got[7] is None
    for i in set(range(331)) - {5, 6, 7}:
        y = 4.0 * (63 if i < 64 else 64 if i < 320 else 11) / 64  # the null content is not among the first 64
        assert got[i] == pytest.approx([3 / np.hypot(3, y), y / np.hypot(3, y)], rel=1e-6)
    assert pictures.encode_pictures(df.limit(0), encode).count() == 0


def test_judged_permutation(spark):
    """Rows without a key keep their score; the others' scores go by key, ties by position."""
    c = [(1, "a", 1, 0.9, None), (1, "a", 2, 0.8, 1.0), (1, "a", 3, 0.7, 3.0), (1, "a", 4, 0.6, 3.0), (1, "b", 5, 0.5, 2.0)]
    df = spark.createDataFrame(c, "query_id long, video_id string, rnk long, score double, k double")
    got = {r.rnk: r.permuted for r in fusion.permute_judged(df, ["query_id", "video_id"], F.col("k")).collect()}
    assert got == {1: 0.9, 2: 0.6, 3: 0.8, 4: 0.7, 5: 0.5}


def test_ceilings_of_the_coverage_allocation(spark):
    """The whole result: scores given out anew in loops, rows by the greedy plan, means by level."""
    c = defaultdict(list)
    for r in answer_queries.candidates(spark, DATA, 400).orderBy("query_id", "pos").collect():
        c[r.query_id].append(r)
    truth = {r.query_id: r for r in answer_queries.truth(spark, DATA).collect()}
    shown, want = defaultdict(int), []
    names = ceilings.levels()
    for q, own in sorted(c.items()):
        t = truth[q]
        videos = list(dict.fromkeys(r.video_id for r in own))
        for no, level in enumerate(names):
            v, f = (0, 0) if level == "base" else (10**6, 10**6) if level in ("identity", "oracle") else map(int, level.split("x"))
            seen = [i for x in videos[:v] for i in sorted((i for i, r in enumerate(own) if r.video_id == x), key=lambda i: (-own[i].score, i))[:f]]
            shown[level] += len(seen)
            score = [r.score for r in own]
            mine = [i for i in seen if own[i].video_id == t.truth] if level != "identity" else []
            near = sorted(mine, key=lambda i: (abs(own[i].frame_idx - (t.lo + t.hi) // 2), i))
            for i, s in zip(near, sorted((own[i].score for i in mine), reverse=True), strict=True):
                score[i] = s
            order = sorted(range(len(own)), key=lambda i: (-score[i], i))
            want += [(q * 100 + no, p, own[i].video_id, own[i].frame_idx, score[i], own[i].last_frame) for p, i in enumerate(order)]
    plan = allocate.coverage_rows(spark.createDataFrame(want, "query_id long, pos long, video_id string, frame_idx long, score double, last_frame long")).collect()
    x = ceilings.judged(answer_queries.candidates(spark, DATA, 400), answer_queries.truth(spark, DATA))
    made = ceilings.level_rows(x, allocate.coverage_rows).collect()
    assert sorted((r.query_id * 100 + r.level, r["rank"], r.video_id, r.frame) for r in made) == sorted((r.query_id, r["rank"], r.video_id, r.frame) for r in plan)
    pick = lambda no: sorted((r.query_id, r["rank"], r.video_id, r.frame) for r in made if r.level == no)
    assert pick(0) == pick(1) != pick(2)
    hit, score = defaultdict(lambda: 10**6), defaultdict(float)
    for r in plan:
        q, no = divmod(r.query_id, 100)
        if r.video_id == truth[q].truth and truth[q].lo <= r.frame <= truth[q].hi:
            hit[q, no] = min(hit[q, no], r["rank"])
    for (_, no), rank in hit.items():
        score[names[no]] += sum(rank <= k for k in (1, 5, 20, 50, 100)) / 5 / len(c)
    out = {r.level: r for r in QUERIES["n25_coverage_ceilings"](spark, DATA).collect()}
    assert {k: r.pictures for k, r in out.items()} == dict(shown) and {r.queries for r in out.values()} == {len(c)}
    assert {k: r.score for k, r in out.items()} == pytest.approx({k: score[k] for k in names}, abs=1e-6)
    assert out["oracle"].reach == 100 and all(r.batches == -(-r.pictures // 8) for r in out.values())


def test_decomposer_with_a_limit(spark):
    """Answers in time, late ones, faults, answers of another kind, nulls."""
    import time

    from keymoment import engine

    def ask(x):
        if x == "hangs":
            time.sleep(30)
        if x == "fails":
            raise RuntimeError(x)
        return {"none": [], "blank": ["a", " "], "text": "a b", "numbers": [1]}.get(x, x.split())

    texts = ["a b", "hangs", "fails", "none", "blank", "text", "numbers", None, "c"]
    at = time.time()
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", engine.within(ask, 0.5, lambda t: F.array(F.lit("all"), t))(F.col("t")).alias("e")).collect()
    assert time.time() - at < 25
    assert {r.t: r.e for r in got} == {t: [t] if t == "c" else ["a", "b"] if t == "a b" else ["all", t] for t in texts}


def test_engine_with_a_verifier(spark):
    from keymoment import engine

    items = spark.createDataFrame([(10 * v + n, f"V{v}", n, 55 * n, [1.0, 0.0]) for v in range(2) for n in range(1, 9)], "gid long, video_id string, n long, frame_idx long, v array<double>")
    found = spark.createDataFrame([(0, "V0", 0.9, [3, 5], 1), (0, "V1", 0.8, [13, 15], 2)], "query_id long, video_id string, score double, gids array<long>, rnk int")
    seen = []

    def verifier(asked):
        seen.extend((r.event_idx, r.gid) for r in asked.collect())
        return asked.withColumn("conf", F.when(F.col("gid") == 14, 7.0).when(F.col("gid") == 16, 0.5).when(F.col("gid") == 3, 0.25).when(F.col("gid") == 4, -1.0)).where("conf is not null")

    out = {r.video_id: (r.rnk, r.verdict, r.accepted, r["items"], r.new_rank) for r in engine.Engine(items, None, verifier=verifier).verified(found, 1).collect()}
    assert sorted(seen) == sorted((e, b + c + i) for b in (0, 10) for e, c in ((0, 3), (1, 5)) for i in (-1, 0, 1))
    assert out == {"V1": (2, 1.0, False, [3, 5], 1), "V0": (1, 0.125, True, [3, 4], 2)}
    with pytest.raises(ValueError):
        engine.Engine(items, None).verified(found)
