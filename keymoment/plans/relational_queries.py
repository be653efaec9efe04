"""Queries of top-k, joins, aggregation, windows and set operations (E to I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.operators import joins, topk, vector, windows

from .corpus import H, K, S, hits, keyframes, query_vectors, scores, table
from .registry import query
from .scan_queries import _DET, detections


@query("e1_top_n", f"WITH {H} SELECT query_id, gid, score, rnk FROM h WHERE rnk <= 50")
def top_n(spark, d):
    return hits(spark, d, 50).select("query_id", "gid", "score", "rnk")


@query("e1_top_n_blocks", f"WITH {H} SELECT query_id, gid, score, rnk FROM h WHERE rnk <= 50")
def top_n_blocks(spark, d):
    from .corpus import query_vectors

    return vector.top_similar(keyframes(spark, d).where("n > 2"), query_vectors(spark, d), "v", "qv", 50)


@query("e2_top_videos", f"WITH {S}, b AS (SELECT query_id, video_id, max(score) AS best FROM s WHERE n > 2 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, video_id) AS rnk FROM b) WHERE rnk <= 5")
def top_videos(spark, d):
    b = scores(spark, d).where("n > 2").groupBy("query_id", "video_id").agg(F.max("score").alias("best"))
    return topk.top_per_group(b, ["query_id"], [F.desc("best"), F.asc("video_id")], 5)


@query("e3_pooling", f"""WITH {H}, t AS (SELECT query_id, video_id, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b, max(CASE WHEN r = 3 THEN score END) AS c
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, gid) AS r FROM h) GROUP BY ALL)
SELECT query_id, video_id, round(CASE WHEN b IS NULL THEN a WHEN c IS NULL THEN CAST(0.75 AS DOUBLE) * a + CAST(0.25 AS DOUBLE) * b ELSE CAST(0.75 AS DOUBLE) * a + CAST(0.20 AS DOUBLE) * b + CAST(0.05 AS DOUBLE) * c END, 6) AS pooled FROM t""")
def pooling(spark, d):
    return topk.pool_top3(hits(spark, d), ["query_id", "video_id"])


@query("e4_density", f"""WITH {H}, b AS (SELECT query_id, video_id, max(score) AS m, count(*) AS c FROM h GROUP BY ALL), x AS (SELECT query_id, video_id, count(*) FILTER (score >= CAST(0.91 AS DOUBLE) * m) AS near, any_value(c) AS c FROM h JOIN b USING (query_id, video_id) GROUP BY ALL)
SELECT query_id, video_id, near, round(CASE WHEN c >= 2 THEN log2(1 + least(near, 8)) * CAST(0.015 AS DOUBLE) / 3 ELSE 0 END, 6) AS bonus FROM x""")
def density(spark, d):
    return topk.density_bonus(hits(spark, d), ["query_id", "video_id"])


@query("e5_video_cap", f"WITH {H} SELECT query_id, gid, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, gid) AS r FROM h) WHERE r <= 2")
def video_cap(spark, d):
    return topk.top_per_group(hits(spark, d), ["query_id", "video_id"], [F.desc("score"), F.asc("gid")], 2, "r").select("query_id", "gid", "r")


def _greedy_sql(rows: str, keep: str, out: str, groups: str = "query_id, video_id") -> str:
    """A fold over a group's rows in order of score; a are the kept ones, x is the row, y one of a."""
    return f"""WITH {H}, g AS (SELECT query_id, list(struct_pack(gid := gid, video_id := video_id, n := n, frame_idx := frame_idx, pts_time := pts_time, score := score) ORDER BY score DESC, gid) AS g FROM {rows} GROUP BY {groups}),
    f AS (SELECT query_id, g, list_reduce(g, lambda a, x: CASE WHEN {keep} THEN list_append(a, x) ELSE a END, g[1:0]) AS kept FROM g) {out}"""


_KEPT = "SELECT query_id, u.gid, u.score FROM (SELECT query_id, unnest(kept) AS u FROM f)"


@query("e6_nms", _greedy_sql("h", "len(a) < 3 AND len(list_filter(a, lambda y: abs(x.n - y.n) <= 2 OR abs(x.pts_time - y.pts_time) <= 10)) = 0", _KEPT))
def nms(spark, d):
    return topk.nms(hits(spark, d), ["query_id", "video_id"], 2, 3).select("query_id", "gid", "score")


@query("e6_nms_ordinal", _greedy_sql("h", "len(list_filter(a, lambda y: abs(x.n - y.n) <= 3)) = 0", _KEPT))
def nms_ordinal(spark, d):
    return topk.nms(hits(spark, d), ["query_id", "video_id"], 3, None, seconds=False).select("query_id", "gid", "score")


@query("e7_spread", _greedy_sql(
    "h WHERE rnk <= 100", "len(list_filter(a, lambda y: y.video_id = x.video_id AND abs(x.frame_idx - y.frame_idx) < 110)) = 0",
    "SELECT query_id, u.gid, pos FROM (SELECT query_id, unnest(o) AS u, generate_subscripts(o, 1) AS pos FROM (SELECT query_id, list_concat(kept, list_filter(g, lambda x: NOT list_contains(list_transform(kept, lambda y: y.gid), x.gid))) AS o FROM f))", "query_id",
))
def spread(spark, d):
    return topk.spread(hits(spark, d, 100), ["query_id"], 110).select("query_id", "gid", "pos")


@query("e8_best_per_video", f"WITH {H} SELECT query_id, video_id, gid, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rnk) AS r FROM h) WHERE r = 1")
def best_per_video(spark, d):
    return topk.top_per_group(hits(spark, d), ["query_id", "video_id"], [F.asc("rnk")], 1, "r").select("query_id", "video_id", "gid", "score")


@query("e9_neighbours", f"""WITH {H}, seed AS (SELECT query_id, video_id, gid AS seed_gid, n AS sn FROM h WHERE rnk <= 10 AND score >= 0.16),
c AS (SELECT seed.query_id, seed_gid, b.gid, h.score, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cosine FROM seed JOIN k a ON a.gid = seed_gid JOIN k b ON b.video_id = seed.video_id AND b.n BETWEEN sn - 4 AND sn + 4 AND b.n <> sn JOIN h ON h.query_id = seed.query_id AND h.gid = b.gid),
f AS (SELECT *, round(score + CAST(0.04 AS DOUBLE) * cosine, 6) AS composite FROM c WHERE score >= 0.05 AND cosine >= 0.05)
SELECT query_id, seed_gid, gid, composite, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed_gid ORDER BY composite DESC, gid) AS place FROM f) WHERE place <= 2""")
def neighbours(spark, d):
    return topk.expand_neighbours(hits(spark, d), keyframes(spark, d), "v", least=0.05, cosine=0.05).select("query_id", "seed_gid", "gid", "composite", "place")


@query("e10_even_sample", f"WITH {K} SELECT gid FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY video_id) // 6) AS step FROM k) WHERE (n - 1) % step = 0 AND n - 1 < 6 * step")
def even_sample(spark, d):
    return topk.even_sample(keyframes(spark, d), "video_id", "n", 6).select("gid")


@query("e11_stable_sort", f"WITH {H} SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 2) DESC, rnk) AS place FROM h")
def stable_sort(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 2)), "rnk")
    return hits(spark, d).select("query_id", "gid", F.row_number().over(w).alias("place"))


@query("e12_rank_bounds", f"WITH {H}, r AS (SELECT query_id, gid, round(CAST(score AS DECIMAL(18, 6)), 2) AS s FROM h) SELECT query_id, gid, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS best, rank() OVER (PARTITION BY query_id ORDER BY s DESC) + count(*) OVER (PARTITION BY query_id, s) - 1 AS worst FROM r")
def rank_bounds(spark, d):
    """Ranks by scores at two places, halves of their six decimal digits away from zero."""
    r = hits(spark, d).withColumn("s", F.round("score", 2))
    best = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    return r.select("query_id", "gid", best.alias("best"), (best + F.count("*").over(Window.partitionBy("query_id", "s")) - 1).alias("worst"))


@query("e13_samplers", f"WITH {K}, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS c FROM k), e AS (SELECT DISTINCT video_id, (i * c) // 7 + 1 AS n FROM c, (SELECT unnest(range(7)) AS i)) SELECT gid, 'even' AS how FROM e JOIN k USING (video_id, n) UNION ALL SELECT gid, 'head' FROM k WHERE n <= 3 UNION ALL SELECT gid, 'range' FROM k WHERE frame_idx BETWEEN 500 AND 900 UNION ALL SELECT gid, 'nth' FROM k WHERE (n - 1) % 5 = 0")
def samplers(spark, d):
    k = keyframes(spark, d)
    c = k.groupBy("video_id").agg(F.count("*").alias("c"))
    e = c.select("video_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor(i * F.col("c") / 7) + 1))).alias("n")).join(k, ["video_id", "n"])
    parts = (("even", e), ("head", k.where("n <= 3")), ("range", k.where("frame_idx between 500 and 900")), ("nth", k.where("(n - 1) % 5 = 0")))
    out = None
    for how, x in parts:
        y = x.select("gid", F.lit(how).alias("how"))
        out = y if out is None else out.unionAll(y)
    return out


@query("e13_first_above", f"WITH {S} SELECT query_id, video_id, min(frame_idx) AS frame FROM s WHERE score >= 0.2 GROUP BY ALL")
def first_above(spark, d):
    return scores(spark, d).where("score >= 0.2").groupBy("query_id", "video_id").agg(F.min("frame_idx").alias("frame"))


@query("e14_leads", f"WITH {H}, v AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rnk)) AS vr FROM h GROUP BY query_id, video_id) SELECT query_id, gid, vr, fr FROM (SELECT h.query_id, gid, vr, row_number() OVER (PARTITION BY h.query_id, h.video_id ORDER BY rnk) AS fr FROM h JOIN v USING (query_id, video_id)) WHERE vr <= 3 AND fr <= 4")
def leads(spark, d):
    h = hits(spark, d)
    v = topk.top_per_group(h.groupBy("query_id", "video_id").agg(F.min("rnk").alias("first")), ["query_id"], [F.asc("first")], 3, "vr")
    return topk.top_per_group(h.join(v, ["query_id", "video_id"]), ["query_id", "video_id"], [F.asc("rnk")], 4, "fr").select("query_id", "gid", "vr", "fr")


# --- joins


@query("f1_vectors_by_key", f"WITH {K} SELECT k.gid, k.video_id, round(v[1], 6) AS x FROM k")
def vectors_by_key(spark, d):
    from keymoment.sources.items import with_vectors

    k = keyframes(spark, d)
    return with_vectors(k.drop("v"), k.select("gid", "v")).select("gid", "video_id", F.round(F.col("v")[0], 6).alias("x"))


@query("f2_lookup", f"WITH {H}, {_DET} SELECT query_id, h.gid, coalesce(best, 0) AS best FROM h LEFT JOIN (SELECT frame, max(conf) AS best FROM d GROUP BY frame) ON frame = gid WHERE rnk <= 100")
def lookup(spark, d):
    best = detections(spark, d).groupBy(F.col("frame").alias("gid")).agg(F.max("conf").alias("best"))
    return hits(spark, d, 100).join(best, "gid", "left").select("query_id", "gid", F.coalesce("best", F.lit(0.0)).alias("best"))


@query("f3_semi_anti", "SELECT c_custkey, 'buyer' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'other' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("buyer").alias("kind")).unionAll(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("other").alias("kind")))


@query("f4_range_join", f"WITH {K}, r AS (SELECT video_id, min(g) AS s, max(g) AS e FROM (SELECT *, row_number() OVER (ORDER BY video_id, n) - 1 AS g FROM k) GROUP BY video_id) SELECT o_orderkey, video_id FROM orders JOIN r ON o_orderkey BETWEEN s AND e")
def range_join(spark, d):
    from keymoment.sources.items import ranges, remap

    return joins.in_ranges(table(spark, d, "orders").select("o_orderkey"), ranges(remap(keyframes(spark, d))), "o_orderkey", "s", "e", 64).select("o_orderkey", "video_id")


@query("f5_nearest", f"""WITH {K}, p AS (SELECT event_id, 'V' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') AS video_id, event_id % 2750 AS f FROM events),
m AS (SELECT event_id, min({{'d': abs(f - frame_idx), 'b': frame_idx, 'g': gid}}) AS m FROM p JOIN k USING (video_id) GROUP BY event_id) SELECT event_id, m.d AS distance, m.g AS gid FROM m""")
def nearest(spark, d):
    p = table(spark, d, "events").select("event_id", F.format_string("V%03d", F.col("user_id") % 10).alias("video_id"), (F.col("event_id") % 2750).alias("f"))
    return joins.nearest(p, keyframes(spark, d), ["video_id"], "f", "frame_idx", ["event_id"], ["gid"], 1100)


@query("f6_interval", f"WITH {H}, t AS (SELECT gid AS truth, video_id, frame_idx - 100 AS lo, frame_idx + 100 AS hi FROM k) SELECT query_id, h.gid, truth FROM h JOIN t ON h.video_id = t.video_id AND frame_idx BETWEEN lo AND hi WHERE rnk <= 50")
def interval(spark, d):
    t = keyframes(spark, d).select(F.col("gid").alias("truth"), "video_id", (F.col("frame_idx") - 100).alias("lo"), (F.col("frame_idx") + 100).alias("hi"))
    return joins.within(hits(spark, d, 50), t, ["video_id"], "frame_idx", "lo", "hi").select("query_id", "gid", "truth")


_SEG = "seg AS (SELECT conv_id AS video, turn, turn * CAST(3.0 AS DOUBLE) AS start, text FROM conversations)"


def segments(spark, d):
    """video, turn, start, text: turns of conversations as timed speech."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video"), "turn", (F.col("turn") * 3.0).alias("start"), "text")


@query("f7_band", f"WITH {_SEG} SELECT a.video, a.turn, substr(string_agg(b.text, ' ' ORDER BY b.start, b.turn, b.text), 1, 1500) AS around FROM (SELECT DISTINCT video, turn, start FROM seg) a JOIN seg b ON a.video = b.video AND abs(a.start - b.start) <= 6 GROUP BY ALL")
def band(spark, d):
    s = segments(spark, d)
    a = s.select("video", "turn", F.col("start").alias("at")).distinct()
    pairs = joins.band(a, s.select("video", "start", "text", F.col("turn").alias("t2")), ["video"], "at", "start", 6.0)
    text = F.transform(F.sort_array(F.collect_list(F.struct("start", "t2", "text"))), lambda x: x["text"])
    return pairs.groupBy("video", "turn").agg(F.substring(F.array_join(text, " "), 1, 1500).alias("around"))


@query("f8_timeline", f"WITH {H}, t AS (SELECT gid, lag(gid) OVER w AS before, lead(gid) OVER w AS after FROM k WINDOW w AS (PARTITION BY video_id ORDER BY n)) SELECT query_id, gid, before, after FROM h JOIN t USING (gid) WHERE rnk <= 100")
def timeline(spark, d):
    w = Window.partitionBy("video_id").orderBy("n")
    t = keyframes(spark, d).select("gid", F.lag("gid").over(w).alias("before"), F.lead("gid").over(w).alias("after"))
    return hits(spark, d, 100).join(t, "gid").select("query_id", "gid", "before", "after")


@query("f9_pool_union", f"""WITH {H}, u AS (SELECT query_id, video_id, frame_idx, rnk AS pos, 0 AS src FROM h WHERE rnk <= 50 UNION ALL SELECT query_id, video_id, frame_idx, row_number() OVER (PARTITION BY query_id ORDER BY n, gid), 1 FROM h WHERE n <= 8)
SELECT query_id, video_id, frame_idx, CAST(src AS BIGINT) AS source, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_idx ORDER BY src, pos) AS r FROM u) WHERE r = 1""")
def pool_union(spark, d):
    h = hits(spark, d)
    a = h.where("rnk <= 50").select("query_id", "video_id", "frame_idx", F.col("rnk").alias("pos"))
    b = h.where("n <= 8").select("query_id", "video_id", "frame_idx", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "gid")).cast("long").alias("pos"))
    return joins.union_first([a, b], ["query_id", "video_id", "frame_idx"]).select("query_id", "video_id", "frame_idx", "source", "pos")


@query("f9_max_merge", f"WITH {H} SELECT query_id // 2 AS query_id, gid, max(score) AS score FROM h GROUP BY ALL")
def max_merge(spark, d):
    return hits(spark, d).groupBy(F.floor(F.col("query_id") / 2).alias("query_id"), "gid").agg(F.max("score").alias("score"))


@query("f10_cross", "SELECT r_name, n_name FROM region, nation")
def cross(spark, d):
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(table(spark, d, "region").select("r_name")))


@query("f11_outer_ranks", f"""WITH {H}, a AS (SELECT query_id, gid, rnk FROM h WHERE rnk <= 60), b AS (SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY n, gid) AS rnk FROM h QUALIFY rnk <= 60)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.gid, b.gid) AS gid, coalesce(a.rnk, 1000000) AS rank_a, coalesce(b.rnk, 1000000) AS rank_b FROM a FULL JOIN b ON a.query_id = b.query_id AND a.gid = b.gid""".replace("row_number() OVER (PARTITION BY query_id ORDER BY n, gid) AS rnk FROM h QUALIFY rnk <= 60", "r2 AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, gid) AS r2 FROM h) WHERE r2 <= 60"))
def outer_ranks(spark, d):
    h = hits(spark, d)
    b = topk.top_per_group(h.drop("rnk"), ["query_id"], [F.asc("n"), F.asc("gid")], 60, "rnk")
    return joins.outer_ranks(h.where("rnk <= 60"), b, ["query_id", "gid"])


# --- aggregation


@query("g1_last_frame", f"WITH {K} SELECT video_id, max(frame_idx) AS last_frame FROM k GROUP BY video_id")
def last_frame(spark, d):
    return keyframes(spark, d).groupBy("video_id").agg(F.max("frame_idx").alias("last_frame"))


@query("g2_ranges", f"WITH {K} SELECT video_id, min(gid) AS s, max(gid) AS e, count(*) AS items, max(gid) - min(gid) + 1 = count(*) AS contiguous FROM k GROUP BY video_id")
def range_check(spark, d):
    from keymoment.sources.items import ranges

    return ranges(keyframes(spark, d))


@query("g4_class_counts", f"WITH {_DET}, c AS (SELECT frame, cls, count(*) AS c FROM d GROUP BY ALL) SELECT frame, string_agg(cls || ':' || c, ', ' ORDER BY c DESC, cls) AS caption FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY c DESC, cls) AS r FROM c) WHERE r <= 4 GROUP BY frame")
def class_counts(spark, d):
    c = detections(spark, d).groupBy("frame", "cls").agg(F.count("*").alias("c"))
    t = topk.top_per_group(c, ["frame"], [F.desc("c"), F.asc("cls")], 4, "r")
    return t.groupBy("frame").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "cls", "c"))), lambda x: F.concat_ws(":", x["cls"], x["c"])), ", ").alias("caption"))


@query("g5_group_statistics", f"WITH {S} SELECT query_id, gid, min(score) OVER w AS lo, max(score) OVER w AS hi, round(avg(score) OVER w, 12) AS mean, round(stddev_pop(score) OVER w, 6) AS sd FROM s WINDOW w AS (PARTITION BY query_id, video_id)")
def group_statistics(spark, d):
    w = Window.partitionBy("query_id", "video_id")
    return scores(spark, d).select("query_id", "gid", F.min("score").over(w).alias("lo"), F.max("score").over(w).alias("hi"), F.round(F.avg("score").over(w), 12).alias("mean"), F.round(F.stddev_pop("score").over(w), 6).alias("sd"))


@query("g6_rank_histogram", f"WITH {H}, f AS (SELECT query_id, min(rnk) AS r FROM h WHERE gid % 10 = query_id % 10 GROUP BY query_id) SELECT CASE WHEN r <= 1 THEN '1' WHEN r <= 5 THEN '2-5' WHEN r <= 20 THEN '6-20' WHEN r <= 50 THEN '21-50' WHEN r <= 100 THEN '51-100' ELSE 'later' END AS bucket, count(*) AS queries FROM f GROUP BY 1")
def rank_histogram(spark, d):
    from keymoment.operators.evaluate import rank_bucket

    f = hits(spark, d).where("gid % 10 = query_id % 10").groupBy("query_id").agg(F.min("rnk").alias("r"))
    return f.groupBy(rank_bucket(F.col("r")).alias("bucket")).agg(F.count("*").alias("queries"))


@query("g7_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def summary(spark, d):
    from keymoment.operators.evaluate import summary as of

    return of(table(spark, d, "events"), ["event_type"], "value")


@query("g8_ordered_distinct", "SELECT conv_id, list(t ORDER BY first) AS texts FROM (SELECT conv_id, lower(trim(text)) AS t, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id", F.lower(F.trim("text")).alias("t")).agg(F.min("turn").alias("first"))
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]).alias("texts"))


@query("g9_shot_density", f"WITH {K}, c AS (SELECT video_id, CASE WHEN n % 11 = 0 THEN -1 ELSE (n - 1) // 5 END AS shot FROM k), g AS (SELECT video_id, shot, count(*) AS c FROM c WHERE shot >= 0 GROUP BY ALL) SELECT min(c) AS least, round(avg(c), 6) AS mean, count(*) FILTER (c < 4) AS below, (SELECT count(*) FROM c WHERE shot < 0) AS unlabelled FROM g")
def shot_density(spark, d):
    c = keyframes(spark, d).select("video_id", F.when(F.col("n") % 11 == 0, -1).otherwise(F.floor((F.col("n") - 1) / 5)).alias("shot"))
    g = c.groupBy("video_id", "shot").agg(F.count("*").alias("c"))
    named = F.col("shot") >= 0
    return g.agg(F.min(F.when(named, F.col("c"))).alias("least"), F.round(F.avg(F.when(named, F.col("c"))), 6).alias("mean"), F.count_if(named & (F.col("c") < 4)).alias("below"), F.coalesce(F.sum(F.when(~named, F.col("c"))), F.lit(0)).alias("unlabelled"))


@query("g10_bursts", """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 3600 THEN 0 ELSE 1 END AS new FROM t),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS burst FROM f), g AS (SELECT user_id, burst, count(*) AS size FROM b GROUP BY ALL)
SELECT user_id, count(*) AS bursts, max(size) AS largest, count(*) FILTER (size > 1) AS runs FROM g GROUP BY user_id""")
def bursts(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id"))
    b = windows.bursts(e, ["user_id"], "o", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600)
    return b.groupBy("user_id").agg(F.count("*").alias("bursts"), F.max("size").alias("largest"), F.count_if(F.col("size") > 1).alias("runs"))


@query("g11_median_gap", f"WITH {K}, g AS (SELECT video_id, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY n) AS gap FROM k WHERE gid % 3 <> 1) SELECT video_id, quantile_cont(gap, 0.5) AS gap FROM g WHERE gap IS NOT NULL GROUP BY video_id")
def median_gap(spark, d):
    w = Window.partitionBy("video_id").orderBy("n")
    g = keyframes(spark, d).where("gid % 3 <> 1").withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(w)).where("gap is not null")
    return g.groupBy("video_id").agg(F.percentile("gap", 0.5).alias("gap"))


@query("g12_concentration", f"WITH {H}, c AS (SELECT query_id, video_id, count(*) AS c FROM h WHERE rnk <= 20 GROUP BY ALL) SELECT query_id, max(c) / CAST(20 AS DOUBLE) AS share FROM c GROUP BY query_id")
def concentration(spark, d):
    return hits(spark, d, 20).groupBy("query_id", "video_id").agg(F.count("*").alias("c")).groupBy("query_id").agg((F.max("c") / 20.0).alias("share"))


@query("g13_majority", "SELECT l_suppkey, l_returnflag AS answer FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_suppkey, l_returnflag) WHERE r = 1")
def majority(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("c"))
    best = c.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("c")).alias("c"), "l_returnflag")).alias("b"))
    return best.select("l_suppkey", F.col("b.l_returnflag").alias("answer"))


@query("g14_run_comparison", "SELECT CASE WHEN toxic > quality THEN 'better' WHEN toxic < quality THEN 'worse' ELSE 'same' END AS verdict, count(*) AS n FROM labels GROUP BY 1")
def run_comparison(spark, d):
    from keymoment.operators.evaluate import compare_runs

    x = table(spark, d, "labels")
    return compare_runs(x.select("doc_id", F.col("quality").alias("score")), x.select("doc_id", F.col("toxic").alias("score")), ["doc_id"])


@query("g_report_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def report_sets(spark, d):
    x = table(spark, d, "lineitem")
    return x.groupingSets([[x["l_returnflag"], x["l_linestatus"]], [x["l_returnflag"]], []], x["l_returnflag"], x["l_linestatus"]).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"))


# --- windows


@query("h1_ranks", f"WITH {S} SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS r FROM s")
def ranks(spark, d):
    return scores(spark, d).select("query_id", "gid", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")).alias("r"))


@query("h2_video_rank", f"WITH {H} SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rnk)) AS r FROM h GROUP BY query_id, video_id")
def video_rank(spark, d):
    f = hits(spark, d).groupBy("query_id", "video_id").agg(F.min("rnk").alias("first"))
    return f.select("query_id", "video_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")).alias("r"))


PEAK = f"""{H}, t AS (SELECT gid, lag(gid) OVER w AS p, lead(gid) OVER w AS q FROM k WINDOW w AS (PARTITION BY video_id ORDER BY n)),
pk AS (SELECT h.query_id, h.gid, h.video_id, h.n, h.frame_idx, h.score, h.rnk, round(h.score + CASE WHEN a.score IS NULL AND b.score IS NULL THEN 0 ELSE CAST(0.01 AS DOUBLE) * greatest(h.score - greatest(a.score, b.score), 0) / greatest(abs(h.score), 1e-6) END, 8) AS bumped
 FROM h JOIN t USING (gid) LEFT JOIN h a ON a.query_id = h.query_id AND a.gid = t.p LEFT JOIN h b ON b.query_id = h.query_id AND b.gid = t.q)"""


@query("h3_local_peak", f"WITH {PEAK} SELECT query_id, gid, bumped, row_number() OVER (PARTITION BY query_id ORDER BY bumped DESC, rnk) AS place FROM pk")
def local_peak(spark, d):
    p = windows.local_peak(hits(spark, d), keyframes(spark, d))
    return p.select("query_id", "gid", "bumped", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bumped"), "rnk")).alias("place"))


@query("h4_gaussian", f"WITH {S} SELECT a.query_id, a.gid, round(CAST(0.5 AS DOUBLE) * any_value(a.score) + CAST(0.5 AS DOUBLE) * sum(b.score * exp(-0.5 * (b.n - a.n) * (b.n - a.n) / 4.0)) / sum(exp(-0.5 * (b.n - a.n) * (b.n - a.n) / 4.0)), 6) AS smooth FROM s a JOIN s b ON a.query_id = b.query_id AND a.video_id = b.video_id AND abs(a.n - b.n) <= 5 GROUP BY a.query_id, a.gid")
def gaussian(spark, d):
    return windows.gaussian_smooth(scores(spark, d), ["query_id", "video_id"], "n", "score", 2.0, 0.5).select("query_id", "gid", "smooth")


@query("h5_box", f"WITH {S} SELECT query_id, gid, round(avg(score) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 8) AS smooth FROM s")
def box(spark, d):
    return windows.box_smooth(scores(spark, d), ["query_id", "video_id"], "n", "score", 2, 8).select("query_id", "gid", "smooth")


for _how, _x in (("mean", "score - avg(score) OVER o + avg(score) OVER a"), ("zscore", "(score - avg(score) OVER o) / (stddev_pop(score) OVER o + 1e-6) * stddev_pop(score) OVER a + avg(score) OVER a"), ("minmax", "CASE WHEN max(score) OVER o - min(score) OVER o > 1e-12 THEN (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o) ELSE 0 END")):

    @query(f"h6_normal_{_how}", f"WITH {S} SELECT query_id, gid, round(CAST(0.5 AS DOUBLE) * score + CAST(0.5 AS DOUBLE) * ({_x}), {8 if _how == 'minmax' else 5}) AS normal FROM s WINDOW o AS (PARTITION BY query_id, video_id), a AS (PARTITION BY query_id)")
    def normal(spark, d, how=_how):
        return windows.normal_products(keyframes(spark, d), query_vectors(spark, d), how, 0.5, 8 if how == "minmax" else 5)


@query("h7_boundary", f"WITH {S} SELECT query_id, gid, round(score + coalesce(CAST(0.3 AS DOUBLE) * greatest(score - avg(score) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 0), 9) AS bumped FROM s")
def boundary(spark, d):
    return windows.boundary_bump(scores(spark, d), ["query_id", "video_id"], "n", "score", 3, 0.3, 9).select("query_id", "gid", "bumped")


@query("h8_stretch", f"WITH {S} SELECT query_id, gid, round(avg(score) OVER w + 1.5 * (score - avg(score) OVER w), 6) AS stretched FROM s WINDOW w AS (PARTITION BY query_id)")
def stretch(spark, d):
    return windows.stretch(scores(spark, d), ["query_id"], "score", 1.5).select("query_id", "gid", "stretched")


@query("h9_forward_max", f"WITH {S} SELECT query_id, gid, max(score) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM s")
def forward_max(spark, d):
    return windows.forward_max(scores(spark, d), ["query_id", "video_id"], "n", "score", 4).select("query_id", "gid", "ahead")


@query("h9_symmetric_max", f"WITH {S} SELECT query_id, gid, max(score) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS ahead FROM s")
def symmetric_max(spark, d):
    return windows.forward_max(scores(spark, d), ["query_id", "video_id"], "n", "score", 4, True).select("query_id", "gid", "ahead")


@query("h10_passages", f"WITH {_SEG}, u AS (SELECT video, turn, min(start) AS start, min(text) AS text FROM seg GROUP BY video, turn) SELECT video, turn, list(text) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS cues FROM u")
def passages(spark, d):
    s = segments(spark, d).groupBy("video", "turn").agg(F.min("text").alias("text"))
    return s.select("video", "turn", F.collect_list("text").over(Window.partitionBy("video").orderBy("turn").rowsBetween(0, 4)).alias("cues"))


@query("h11_prefix_max", f"WITH {S} SELECT query_id, gid, max(score) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS so_far FROM s")
def prefix_max(spark, d):
    return windows.prefix_max(scores(spark, d), ["query_id", "video_id"], "n", "score", 2).select("query_id", "gid", "so_far")


@query("h12_r_at_k", f"WITH {H}, x AS (SELECT *, CASE WHEN gid % 7 = query_id % 7 THEN 1.0 ELSE 0 END AS r FROM h) SELECT query_id, CAST(coalesce(max(r) FILTER (rnk <= 1), 0) AS DOUBLE) AS r1, CAST(coalesce(max(r) FILTER (rnk <= 5), 0) AS DOUBLE) AS r5, CAST(coalesce(max(r) FILTER (rnk <= 20), 0) AS DOUBLE) AS r20, CAST(coalesce(max(r) FILTER (rnk <= 50), 0) AS DOUBLE) AS r50, CAST(coalesce(max(r) FILTER (rnk <= 100), 0) AS DOUBLE) AS r100 FROM x GROUP BY query_id")
def r_at_k(spark, d):
    from keymoment.operators.evaluate import r_at_k as of

    return of(hits(spark, d).withColumn("r", F.when(F.col("gid") % 7 == F.col("query_id") % 7, 1.0).otherwise(0.0)), ["query_id"], "r", "rnk")


@query("h13_first_scene", f"WITH {S} SELECT query_id, gid, round(score * (1 - 0.5 * coalesce(lag(score) OVER (PARTITION BY query_id, video_id ORDER BY n), 0)), 6) AS located FROM s")
def first_scene(spark, d):
    return windows.two_scene_locator(scores(spark, d), ["query_id", "video_id"], "n", "score", 0.5).select("query_id", "gid", "located")


@query("h14_sharpness", f"WITH {S} SELECT query_id, video_id, round((max(score) - avg(score)) / (stddev_pop(score) + 1e-9), 4) AS sharpness, round(stddev_pop(score), 6) AS noise FROM s GROUP BY ALL")
def sharpness(spark, d):
    return windows.sharpness(scores(spark, d), ["query_id", "video_id"], "score").withColumn("sharpness", F.round("sharpness", 4))


# --- sets


@query("i1_append", f"WITH {H}, x AS (SELECT query_id, gid, rnk AS pos FROM h WHERE rnk <= 10 UNION ALL SELECT query_id, gid, 10 + row_number() OVER (PARTITION BY query_id ORDER BY n, gid) FROM h WHERE rnk > 10 AND n <= 5) SELECT * FROM x")
def append(spark, d):
    h = hits(spark, d)
    tail = h.where("rnk > 10 and n <= 5").select("query_id", "gid", (F.row_number().over(Window.partitionBy("query_id").orderBy("n", "gid")) + 10).cast("long").alias("pos"))
    return h.where("rnk <= 10").select("query_id", "gid", F.col("rnk").alias("pos")).unionByName(tail)


@query("i2_pinned_first", f"WITH {H}, x AS (SELECT query_id, gid, 0 AS s, rnk FROM h WHERE n = 10 UNION ALL SELECT query_id, gid, 1, rnk FROM h), f AS (SELECT query_id, gid, min(s * 1000 + rnk) AS o FROM x GROUP BY ALL) SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY o) AS pos FROM f")
def pinned_first(spark, d):
    h = hits(spark, d).select("query_id", "gid", F.col("rnk").alias("pos"), "n")
    u = joins.union_first([h.where("n = 10").drop("n"), h.drop("n")], ["query_id", "gid"])
    return u.select("query_id", "gid", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "pos")).alias("pos"))


@query("i3_missing_extra", "SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id % 5 <> 0 EXCEPT SELECT doc_id, 'missing' FROM labels UNION ALL (SELECT doc_id, 'extra' FROM labels EXCEPT SELECT doc_id, 'extra' FROM documents WHERE doc_id % 5 <> 0)")
def missing_extra(spark, d):
    from keymoment.operators.evaluate import missing_extra as of

    return of(table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


_SETS = "w AS (SELECT a.item_id AS a, b.item_id AS b, list_distinct(string_split(lower(a.text), ' ')) AS x, list_distinct(string_split(lower(b.text), ' ')) AS y FROM benchmark a, benchmark b WHERE b.item_id BETWEEN a.item_id + 1 AND a.item_id + 3)"


def word_sets(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    near = t.select(F.col("item_id").alias("a"), "x", F.explode(F.array(*[F.col("item_id") + i for i in (1, 2, 3)])).alias("b"))
    return near.join(t.select(F.col("item_id").alias("b"), F.col("x").alias("y")), "b")


@query("i4_common_words", f"WITH {_SETS} SELECT a, b, CAST(len(list_intersect(x, y)) AS BIGINT) AS common FROM w")
def common_words(spark, d):
    return word_sets(spark, d).select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"))


@query("i5_subset", f"WITH {_SETS} SELECT a, b, len(list_intersect(x, y)) = least(len(x), len(y)) AS subset FROM w")
def subset(spark, d):
    from keymoment.operators.evaluate import token_subset

    return word_sets(spark, d).select("a", "b", token_subset(F.col("x"), F.col("y")).alias("subset"))


@query("i6_jaccard", f"WITH {_SETS} SELECT a, b, round(len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE), 6) AS jaccard FROM w")
def jaccard(spark, d):
    from keymoment.operators.evaluate import jaccard as of

    return word_sets(spark, d).select("a", "b", F.round(of(F.col("x"), F.col("y")), 6).alias("jaccard"))
