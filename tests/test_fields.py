"""Fielded phrase boosts, transcript bonuses and drawn moments against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keymoment.functions import text
from keymoment.operators import evaluate, lexical


def brute_boost(docs, queries, stop):
    runs = lambda w: [(n, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    df = Counter(r for _, *f in docs for r in set(runs(" ".join(x or "" for x in f).split())) if r[0] > 1 or (len(r[1]) > 1 and r[1] not in stop))
    out = {}
    for q, words in queries:
        for k, *f in docs:
            x = 0.0
            for r in runs(words or []):
                idf = math.log(1 + (len(docs) - df[r] + 0.5) / (df[r] + 0.5)) if r in df else 1.0
                for i, t in enumerate(f):
                    if (f" {r[1]} " in f" {t or ''} ") if r[0] == 1 else (r[1] in (t or "")):
                        x += lexical.FIELD_WEIGHTS[r[0]][i] * idf * (3 if i == 2 else 1)
                        break
            if x:
                out[q, k] = round(math.tanh(0.02 * x) * 0.035, 8)
    return out


@pytest.mark.parametrize("stop", [(), ("aa", "b")])
def test_fields_against_loops(spark, stop):
    """Nulls, empty fields, repeated runs, runs within words, a document twice as long as others."""
    r = random.Random(5)
    some = lambda n: " ".join(r.choice(("aa", "b", "ca", "dd", "aab", "é")) for _ in range(n))
    docs = [(i, some(r.randint(0, 4)), r.choice((None, some(3))), some(r.randint(0, 12))) for i in range(30)] + [(30, None, None, None), (31, "", "", some(3000))]
    queries = [(i, some(r.randint(1, 7)).split()) for i in range(12)] + [(12, []), (13, ["aa", "b", "aa", "b"]), (14, None), (15, ["zz", "nowhere"])]
    d = spark.createDataFrame(docs, "doc long, title string, tags string, description string")
    q = spark.createDataFrame(queries, "query_id long, words array<string>")
    got = {(x.query_id, x.doc): x.boost for x in lexical.field_boost(d, "doc", q, stop).collect()}
    want = brute_boost(docs, queries, stop)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-8)
    assert lexical.field_boost(d.limit(0), "doc", q).count() == 0 == lexical.field_boost(d, "doc", q.limit(0)).count()


def test_words_of_queries_and_fields(spark):
    t = spark.createDataFrame([("Một con, mèo; màu ĐỎ. x don't",), ("École--ok  9",), (None,), ("",)], "t string")
    got = t.select(text.field_query_words(F.col("t")).alias("q"), text.plain_words(F.col("t")).alias("p")).collect()
    assert got[0].q == ["con", "mèo", "đỏ", "don't"] and got[1].p == "école ok 9" and got[2].q is None and got[3].q == [] and got[3].p == ""


def test_transcript_bonus(spark):
    """A query with one clear video, one whose best two are near, one of a single video, one without speech."""
    hits = [(q, v * 10 + i, f"V{v}", float(10 * i), round(0.5 - 0.01 * (v + 3 * i), 3), v + 3 * i + 1) for q in range(4) for v in range(3) for i in range(4)]
    videos = [(0, "V0", 1.0), (0, "V1", 4.0), (0, "V2", 1.5), (1, "V0", 4.0), (1, "V1", 3.9), (2, "V2", 2.0)]
    where = [(0, "V1", 20.0), (0, "V0", 0.0), (1, "V0", 0.0)]
    h = spark.createDataFrame(hits, "query_id long, gid long, video_id string, pts_time double, score double, rnk long")
    v, p = spark.createDataFrame(videos, "query_id long, video_id string, s double"), spark.createDataFrame(where, "query_id long, video_id string, start double")
    for least in (0.0, 0.1):
        want = {}
        for q in range(4):
            own = {x: s for a, x, s in videos if a == q}
            best = sorted(own.values(), reverse=True)
            spread = (best[0] - best[1]) / best[0] if len(best) > 1 else 0.0
            share = {x: s / best[0] for x, s in own.items()} if own and spread >= least else {}
            for mode in lexical.TRANSCRIPT_MODES:
                scored = []
                for a, gid, x, at, s, rnk in hits:
                    if a == q:
                        n = share.get(x, 0.0)
                        start = next((y for b, z, y in where if (b, z) == (q, x)), None)
                        near = n * math.exp(-abs(at - start) / 20) if start is not None else 0.0
                        scored.append((-round(s + 0.1 * {"video": n, "gate": float(n > 0.5), "time": near, "both": n + near}[mode], 6), rnk, gid))
                for i, (s, _, gid) in enumerate(sorted(scored)):
                    want[q, mode, gid] = (-s, i + 1)
        got = {(x.query_id, x.mode, x.gid): (x.score, x.rnk) for x in lexical.transcript_bonus(h, v, p, 0.1, least).collect()}
        assert got.keys() == want.keys()
        assert {k: r for k, (_, r) in got.items()} == {k: r for k, (_, r) in want.items()}
        assert {k: s for k, (s, _) in got.items()} == pytest.approx({k: s for k, (s, _) in want.items()}, abs=2e-6)


def test_drawn_frames(spark):
    """All draws stay in their cell, cells of no frame or one too; the triangle's and the normal's middle lie at the item."""
    r = random.Random(3)
    cells = [(i, lo, lo + w, lo + w // 2, r.random(), r.random()) for i, (lo, w) in enumerate([(r.randint(-30, 900), r.choice((0, 1, 2, 55, 60))) for _ in range(3000)])]
    wide = [(10_000 + i, 0, 1000, 250, r.random(), r.random()) for i in range(4000)]
    df = spark.createDataFrame(cells + wide, "k long, lo long, hi long, at long, u double, v double")
    c = F.col
    got = df.select("k", "lo", "hi", "at", *[x.alias(n) for n, x in evaluate.drawn_frames(c("lo"), c("hi"), c("at"), c("u"), c("v")).items()]).collect()
    for x in got:
        for n in ("uniform", "triangular", "normal", "after"):
            assert x.lo <= x[n] <= max(x.lo, x.hi - 1)
        assert x.after >= min(max(x.at, x.lo), max(x.lo, x.hi - 1))
    mean = lambda n: sum(x[n] for x in got if x.k >= 10_000) / 4000
    assert abs(mean("uniform") - 499.5) < 20 and abs(mean("triangular") - 1250 / 3) < 15 and abs(mean("normal") - 250) < 1 and abs(mean("after") - 624.5) < 15
