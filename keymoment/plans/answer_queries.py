"""Queries of alignment, allocation and evaluation (L, M, N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.operators import align, allocate, evaluate, topk, vector

from .corpus import H, K, S, hits, keyframes, query_vectors, scores, table
from .registry import query

#: Sequence queries of four events each: event i of query q is retrieval query 4 q + i. A last one with fewer events is left out.
EV = f"""{S}, ev AS (SELECT query_id // 4 AS query_id, query_id % 4 AS event_idx, video_id, gid, n, frame_idx, n - 1 AS t, CASE WHEN n > 2 THEN score ELSE -1e9 END AS score FROM s WHERE query_id // 4 < (SELECT count(*) // 4 FROM qv))"""
EVENTS = 4


def events(spark, d):
    q = F.floor(F.col("query_id") / EVENTS)
    whole = query_vectors(spark, d).withColumn("_c", F.count("*").over(Window.partitionBy(q))).where(F.col("_c") == EVENTS).drop("_c")
    s = vector.similarities(keyframes(spark, d), whole, "v", "qv")
    return s.select(q.alias("query_id"), (F.col("query_id") % EVENTS).cast("int").alias("event_idx"), "video_id", "gid", "n", "frame_idx", (F.col("n") - 1).alias("t"), F.when(F.col("n") > 2, F.col("score")).otherwise(align.NEG).alias("score"))


def _choices(span: int | None, gap: int, penalties: bool = False) -> str:
    """Every increasing choice of four items a video in DuckDB's SQL, by joins: cb(query_id, video_id, score, ts, gids), o the order of its events."""
    orders = {"[0, 1, 2, 3]": 0.0} | ({"[1, 0, 2, 3]": 0.5, "[0, 2, 1, 3]": 0.5, "[0, 1, 3, 2]": 0.5} if penalties else {})
    o = " UNION ALL ".join(f"SELECT {k} AS o, CAST({v} AS DOUBLE) AS fee" for k, v in orders.items())
    join = lambda x, y, i: f"JOIN e0 {x} ON {x}.query_id = a.query_id AND {x}.video_id = a.video_id AND {x}.event_idx = o[{i}] AND {x}.t >= {y}.t + {gap}"
    return f"""{EV}, e0 AS MATERIALIZED (SELECT query_id, video_id, event_idx, t, gid, score FROM ev WHERE n > 2), od AS ({o}),
cb AS (SELECT a.query_id, a.video_id, round(a.score + b.score + c.score + d.score - CAST(0.01 AS DOUBLE) * (d.t - a.t) - fee, 6) AS score, [a.gid, b.gid, c.gid, d.gid] AS gids, {{'f': -fee, 'd': -d.t, 'c': -c.t, 'b': -b.t, 'a': -a.t}} AS tie
 FROM od JOIN e0 a ON a.event_idx = o[1] {join('b', 'a', 2)} {join('c', 'b', 3)} {join('d', 'c', 4)} {f'WHERE d.t - a.t <= {span}' if span else ''})"""


_BEST = "SELECT query_id, video_id, max(score) AS score, arg_max(gids, {'s': score, 'tie': tie}) AS gids FROM cb GROUP BY query_id, video_id"


@query("l1_alignment", f"WITH {_choices(None, 2)} {_BEST}")
def alignment(spark, d):
    """Windows alone; the SQL tries every choice of items."""
    return align.chain(events(spark, d), EVENTS, 0.01, 2)


_CHAIN = f"""{EV}, w AS (SELECT query_id, video_id, t, max(score) FILTER (event_idx = 0) AS s0, max(score) FILTER (event_idx = 1) AS s1, max(score) FILTER (event_idx = 2) AS s2, max(score) FILTER (event_idx = 3) AS s3 FROM ev WHERE n > 2 GROUP BY ALL),
d1 AS (SELECT *, s1 - CAST(0.01 AS DOUBLE) * t + max(s0 + CAST(0.01 AS DOUBLE) * t) OVER p AS d1 FROM w WINDOW p AS (PARTITION BY query_id, video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
d2 AS (SELECT *, s2 - CAST(0.01 AS DOUBLE) * t + max(d1 + CAST(0.01 AS DOUBLE) * t) OVER p AS d2 FROM d1 WINDOW p AS (PARTITION BY query_id, video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
d3 AS (SELECT *, s3 - CAST(0.01 AS DOUBLE) * t + max(d2 + CAST(0.01 AS DOUBLE) * t) OVER p AS d3 FROM d2 WINDOW p AS (PARTITION BY query_id, video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
best AS (SELECT query_id, video_id, round(max(d3), 6) AS score FROM d3 GROUP BY ALL HAVING max(d3) IS NOT NULL)"""


@query("l1_alignment_windows", f"WITH {_CHAIN} SELECT query_id, video_id, score FROM best")
def alignment_windows(spark, d):
    return align.prefix_max_chain(events(spark, d), EVENTS, 0.01, 2)


@query("l1_alignment_score", f"WITH {_CHAIN} SELECT query_id, video_id, score FROM best")
def alignment_score(spark, d):
    return align.align(events(spark, d).where("n > 2"), "monotone", lam=0.01, gap=2).select("query_id", "video_id", "score")


@query("l2_ramp", f"WITH {K} SELECT gid, round((n - 1) / CAST(greatest(count(*) OVER (PARTITION BY video_id) - 1, 1) AS DOUBLE), 6) AS ramp FROM k")
def ramp(spark, d):
    c = F.count("*").over(Window.partitionBy("video_id"))
    return keyframes(spark, d).select("gid", F.round((F.col("n") - 1) / F.greatest(c - 1, F.lit(1)), 6).alias("ramp"))


@query("l3_tempo", f"""WITH {EV}, b AS (SELECT query_id, video_id, event_idx, max(score) AS m, arg_max(t, {{'s': score, 'n': -t}}) AS t FROM ev GROUP BY ALL),
v AS (SELECT * FROM (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(m), 6) DESC, video_id) AS r FROM b GROUP BY query_id, video_id) WHERE r <= 3),
g AS (SELECT query_id, t - lag(t) OVER (PARTITION BY query_id, video_id ORDER BY t) AS gap FROM b JOIN v USING (query_id, video_id)) SELECT query_id, quantile_cont(gap, 0.5) AS gap FROM g WHERE gap IS NOT NULL GROUP BY query_id""")
def tempo(spark, d):
    b = events(spark, d).groupBy("query_id", "video_id", "event_idx").agg(F.max("score").alias("m"), F.max(F.struct("score", (-F.col("t")).alias("n"))).alias("x")).withColumn("t", -F.col("x.n"))
    v = topk.top_per_group(b.groupBy("query_id", "video_id").agg(F.round(F.sum("m"), 6).alias("s")), ["query_id"], [F.desc("s"), F.asc("video_id")], 3)
    g = b.join(v, ["query_id", "video_id"]).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("query_id", "video_id").orderBy("t"))).where("gap is not null")
    return g.groupBy("query_id").agg(F.percentile("gap", 0.5).alias("gap"))


_SCALE = f"{EV}, sd AS (SELECT query_id, event_idx, stddev_pop(score) AS sd FROM ev WHERE score > -5e8 GROUP BY ALL), sc AS (SELECT query_id, quantile_cont(sd, 0.5) AS scale FROM sd GROUP BY query_id)"


def scales(spark, d):
    sd = events(spark, d).where("score > -5e8").groupBy("query_id", "event_idx").agg(F.stddev_pop("score").alias("sd"))
    return sd.groupBy("query_id").agg(F.percentile("sd", 0.5).alias("scale"))


@query("l4_score_scale", f"WITH {_SCALE} SELECT query_id, round(scale, 6) AS scale FROM sc")
def score_scale(spark, d):
    return scales(spark, d).select("query_id", F.round("scale", 6).alias("scale"))


@query("l5_adaptive_lambda", f"WITH {_SCALE} SELECT query_id, round(least(greatest(0.5 / greatest(8.0 + query_id * 40, 1), 0.005), 0.2) * scale, 8) AS lambda FROM sc")
def adaptive_lambda(spark, d):
    lam = F.least(F.greatest(0.5 / F.greatest(8.0 + F.col("query_id") * 40, F.lit(1.0)), F.lit(0.005)), F.lit(0.2))
    return scales(spark, d).select("query_id", F.round(lam * F.col("scale"), 8).alias("lambda"))


@query("l6_anchors", f"WITH {EV} SELECT query_id, event_idx, gid, CASE WHEN event_idx <> 1 THEN score WHEN n = 9 THEN 10 ELSE -1e9 END AS score FROM ev")
def anchors(spark, d):
    return events(spark, d).select("query_id", "event_idx", "gid", F.when(F.col("event_idx") != 1, F.col("score")).when(F.col("n") == 9, 10.0).otherwise(align.NEG).alias("score"))


@query("l7_windowed", f"WITH {_choices(12, 1)} {_BEST}")
def windowed(spark, d):
    return align.align(events(spark, d), "windowed", width=12, lam=0.01, gap=1)


#: Every choice of four distinct items in any order within 20 places, with the prior on later places.
_ANY = f"""{EV}, sz AS (SELECT video_id, greatest(count(*) - 1, 1) AS m FROM k GROUP BY video_id), e0 AS MATERIALIZED (SELECT query_id, video_id, event_idx, t, gid, score - CAST(0.05 AS DOUBLE) / 4 * t / m AS score FROM ev JOIN sz USING (video_id) WHERE n > 2),
ab AS (SELECT a.query_id, a.video_id, a.t AS ta, b.t AS tb, least(a.t, b.t) AS lo, greatest(a.t, b.t) AS hi, a.score + b.score AS s, a.gid AS ga, b.gid AS gb FROM e0 a JOIN e0 b ON a.event_idx = 0 AND b.event_idx = 1 AND a.query_id = b.query_id AND a.video_id = b.video_id AND b.t <> a.t AND abs(a.t - b.t) <= 20),
abc AS (SELECT ab.* EXCLUDE (lo, hi, s), c.t AS tc, c.gid AS gc, least(lo, c.t) AS lo, greatest(hi, c.t) AS hi, s + c.score AS s FROM ab JOIN e0 c ON c.event_idx = 2 AND c.query_id = ab.query_id AND c.video_id = ab.video_id AND c.t <> ta AND c.t <> tb AND greatest(hi, c.t) - least(lo, c.t) <= 20),
cb AS (SELECT abc.query_id, abc.video_id, s + d.score AS score, [ga, gb, gc, d.gid] AS gids FROM abc JOIN e0 d ON d.event_idx = 3 AND d.query_id = abc.query_id AND d.video_id = abc.video_id AND d.t <> ta AND d.t <> tb AND d.t <> tc AND greatest(hi, d.t) - least(lo, d.t) <= 20)"""


@query("l8_unordered", f"WITH {_ANY} SELECT query_id, video_id, round(max(score), 6) AS score, arg_max(gids, score) AS gids FROM cb GROUP BY query_id, video_id")
def unordered(spark, d):
    return align.align(events(spark, d), "unordered", mu=0.05, span=20)


@query("l9_soft_order", f"WITH {_choices(None, 2, True)} {_BEST}")
def soft_order(spark, d):
    return align.align(events(spark, d), "soft", lam=0.01, gap=2)


@query("l14_entropy_paths")
def entropy_paths(spark, d):
    return align.align(events(spark, d), "entropy")


@query("l10_search", f"WITH {_CHAIN} SELECT query_id, video_id, score, r AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS r FROM best) WHERE r <= 5")
def search(spark, d):
    return align.best_videos(align.chain(events(spark, d), EVENTS, 0.01, 2), 5).select("query_id", "video_id", "score", "rnk")


_PRE = f"{S}, b AS (SELECT query_id // 4 AS query_id, video_id, max(score) AS best FROM s WHERE query_id % 4 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, video_id) AS rnk FROM b)"


@query("l11_prefilter", f"WITH {_PRE} SELECT query_id, video_id FROM r WHERE rnk <= 4")
def prefilter(spark, d):
    b = scores(spark, d).where("query_id % 4 = 0").groupBy(F.floor(F.col("query_id") / 4).alias("query_id"), "video_id").agg(F.max("score").alias("best"))
    return topk.top_per_group(b, ["query_id"], [F.desc("best"), F.asc("video_id")], 4).select("query_id", "video_id")


@query("l12_forced_videos", f"WITH {_PRE} SELECT query_id, video_id FROM r WHERE rnk <= 4 UNION SELECT query_id, 'V' || lpad(CAST(query_id AS VARCHAR), 3, '0') FROM r")
def forced_videos(spark, d):
    q = query_vectors(spark, d).select(F.floor(F.col("query_id") / 4).alias("query_id")).distinct()
    return prefilter(spark, d).union(q.select("query_id", F.format_string("V%03d", F.col("query_id")).alias("video_id"))).distinct()


@query("l13_assembly", f"WITH {_choices(None, 2, True)}, b AS ({_BEST}) SELECT query_id, video_id, score, gids, list_sort(gids) AS chronological, video_id || ',' || array_to_string(list_sort(gids), ',') AS line FROM b")
def assembly(spark, d):
    a = align.align(events(spark, d), "soft", lam=0.01, gap=2)
    return a.select("query_id", "video_id", "score", "gids", F.sort_array("gids").alias("chronological"), F.concat_ws(",", "video_id", F.array_join(F.transform(F.sort_array("gids"), lambda x: x.cast("string")), ",")).alias("line"))


_CV = "ch AS (SELECT q AS query_id, 'V00' || q AS video_id, e AS event_idx, 3 + 4 * e + q AS n FROM (SELECT unnest(range(0, 4)) AS q), (SELECT unnest(range(0, 3)) AS e)), ve AS (SELECT user_id % 4 AS query_id, event_id % 3 AS event_idx, 'V00' || user_id % 4 AS video_id, event_id % 20 AS n, max(value) / 100 AS conf FROM events WHERE event_type = 'signup' GROUP BY ALL)"


@query("k8_chain_verdicts", f"""WITH {_CV}, b AS (SELECT ch.query_id, ch.video_id, ch.event_idx, ch.n AS own, max({{'c': coalesce(conf, 0), 'm': -ve.n}}) AS b FROM ch LEFT JOIN ve ON ch.query_id = ve.query_id AND ch.event_idx = ve.event_idx AND ch.video_id = ve.video_id AND ve.n BETWEEN ch.n - 3 AND ch.n + 3 GROUP BY ALL),
p AS (SELECT query_id, video_id, round(avg(b.c), 6) AS verdict, list(coalesce(-b.m, own) ORDER BY event_idx) AS picks FROM b GROUP BY ALL) SELECT *, picks[1] < picks[2] AND picks[2] < picks[3] AS accepted FROM p""")
def chain_verdicts(spark, d):
    from keymoment.operators.fusion import chain_verdicts as of

    q = spark.range(4).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("event_idx"))
    chains = q.select("query_id", F.format_string("V%03d", "query_id").alias("video_id"), "event_idx", (3 + 4 * F.col("event_idx") + F.col("query_id")).alias("n"))
    e = table(spark, d, "events").where("event_type = 'signup'")
    v = e.groupBy((F.col("user_id") % 4).alias("query_id"), (F.col("event_id") % 3).alias("event_idx"), F.format_string("V%03d", F.col("user_id") % 4).alias("video_id"), (F.col("event_id") % 20).alias("n")).agg((F.max("value") / 100).alias("conf"))
    return of(chains, v)


@query("l15_independent", f"WITH {EV}, b AS (SELECT query_id, video_id, event_idx, max(score) AS m FROM ev GROUP BY ALL) SELECT query_id, video_id, round(sum(m), 6) AS score FROM b GROUP BY ALL")
def independent(spark, d):
    return align.align(events(spark, d), "independent").select("query_id", "video_id", "score")


@query("l16_problems", f"WITH {K}, r AS (SELECT video_id, min(gid) AS s, max(gid) AS e FROM k GROUP BY video_id), p AS (SELECT *, lag(e) OVER (ORDER BY s, e) AS p, row_number() OVER (ORDER BY s DESC, e DESC) = 1 AS last FROM r) SELECT video_id, 'start' AS problem FROM p WHERE p IS NULL AND s <> 0 UNION ALL SELECT video_id, 'gap' FROM p WHERE s > p + 1 UNION ALL SELECT video_id, 'overlap' FROM p WHERE s <= p UNION ALL SELECT video_id, 'tail' FROM p WHERE last AND e <> (SELECT count(*) - 1 FROM k)")
def problems(spark, d):
    from keymoment.sources.items import range_problems, ranges

    k = keyframes(spark, d)
    return range_problems(ranges(k), k.count())


#: Frames of the two best alignments of each query, and their answer rows by offsets of up to two steps an event.
_FR = f"""{_choices(None, 2)}, bs AS ({_BEST}), tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS r FROM bs QUALIFY r <= 2),
fr AS (SELECT tp.query_id, tp.video_id, r, list(frame_idx ORDER BY i) AS f, any_value(last) AS last FROM (SELECT *, unnest(gids) AS g, generate_subscripts(gids, 1) AS i FROM tp) tp JOIN k ON k.gid = g JOIN (SELECT video_id, max(frame_idx) AS last FROM k GROUP BY video_id) l ON l.video_id = tp.video_id GROUP BY ALL),
of AS (SELECT unnest(range(-2, 3)) AS o), mv AS (SELECT query_id, video_id, r, abs(x.o) + abs(y.o) + abs(z.o) + abs(w.o) AS cost, [x.o, y.o, z.o, w.o] AS o, list_transform(list_zip(f, [x.o, y.o, z.o, w.o]), lambda p: greatest(0, least(p[1] + p[2] * 10, last))) AS frames FROM fr, of x, of y, of z, of w),
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frames ORDER BY cost, o) AS again FROM mv QUALIFY again = 1),
la AS (SELECT query_id, video_id, r, row_number() OVER (PARTITION BY query_id, video_id ORDER BY cost, o) AS rank, frames FROM ft QUALIFY rank <= 100)"""


@query("l17_hedge", f"WITH {_FR}, sh AS (SELECT * FROM la WHERE rank <= CASE WHEN r = 1 THEN 60 ELSE 40 END) SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY r, rank) AS rank, frames FROM sh")
def hedge(spark, d):
    a = _frames(spark, d).withColumn("share", F.when(F.col("rnk") == 1, 60).otherwise(40))
    rows = allocate.sequence_rows(a).join(a.select("query_id", "video_id", "share", "rnk"), ["query_id", "video_id"]).where(F.col("rank") <= F.col("share"))
    return rows.select("query_id", "video_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rnk", "rank")).alias("rank"), "frames")


def _frames(spark, d):
    """query_id, video_id, rnk, frames, last_frame of the best alignments."""
    q = F.floor(F.col("query_id") / EVENTS)
    whole = query_vectors(spark, d).withColumn("_c", F.count("*").over(Window.partitionBy(q))).where(F.col("_c") == EVENTS)
    vectors = whole.select(q.alias("query_id"), (F.col("query_id") % EVENTS).alias("event_idx"), "qv")
    a = align.best_videos(align.chain_products(keyframes(spark, d), vectors, EVENTS, 0.01, 2, 2), 2).select("query_id", "video_id", "rnk", F.posexplode("gids").alias("i", "gid"))
    k = keyframes(spark, d)
    f = a.join(k.select("gid", "frame_idx"), "gid").groupBy("query_id", "video_id", "rnk").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "frame_idx"))), lambda x: x["frame_idx"]).alias("frames"))
    return f.join(k.groupBy("video_id").agg(F.max("frame_idx").alias("last_frame")), "video_id")


# --- allocation

CAND = f"{H}, lf AS (SELECT video_id, max(frame_idx) AS last_frame FROM k GROUP BY video_id), cand AS (SELECT query_id, rnk - 1 AS pos, h.video_id, frame_idx, score, last_frame FROM h JOIN lf USING (video_id) WHERE rnk <= 60)"
_OFF = "(CASE WHEN d % 2 = 1 THEN -ceil(d / 2.0) ELSE ceil(d / 2.0) END) * 10"


def _slots(cost: str, depth: int = 24, p: str = "", cand: str = "cand") -> str:
    """Cost slots of a candidate table in SQL, as {p}ro(query_id, rank, video_id, frame)."""
    return f"""{p}lad AS (SELECT query_id, pos, video_id, CAST(frame_idx + {_OFF} AS BIGINT) AS frame, d FROM {cand}, (SELECT unnest(range(0, 193)) AS d) WHERE frame_idx + {_OFF} >= 0 AND frame_idx + {_OFF} <= last_frame),
{p}sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY d) - 1 AS depth FROM {p}lad) WHERE depth < {depth}),
{p}co AS (SELECT *, {cost} AS cost FROM {p}sl), {p}one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY cost, pos, depth) AS r FROM {p}co) WHERE r = 1), {p}ro AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cost, pos, depth) AS rank, video_id, frame FROM {p}one)"""


def _hybrid(flat: str = "30", tail: int = 300, p: str = "", cand: str = "cand") -> str:
    """Flat candidates and then slots in SQL, as {p}hr(query_id, rank, video_id, frame), not cut to the budget."""
    return f"""{_slots("pos + CAST(0.5 AS DOUBLE) * depth", p=p, cand=cand)}, {p}hy AS (SELECT query_id, video_id, frame_idx AS frame, 0 AS phase, pos AS place FROM {cand} WHERE pos < {flat} UNION ALL SELECT query_id, video_id, frame, 1, rank FROM {p}ro WHERE rank <= {tail}),
{p}h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY phase, place) AS r FROM {p}hy) WHERE r = 1), {p}hr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY phase, place) AS rank, video_id, frame FROM {p}h1)"""


SLOTS = _slots("pos + CAST(0.5 AS DOUBLE) * depth")
HYBRID = _hybrid()


def candidates(spark, d, n=60):
    last = keyframes(spark, d).groupBy("video_id").agg(F.max("frame_idx").alias("last_frame"))
    return hits(spark, d, n).join(last, "video_id").select("query_id", (F.col("rnk") - 1).alias("pos"), "video_id", "frame_idx", "score", "last_frame")


@query("m1_ladder", f"WITH {CAND}, l AS (SELECT query_id, pos, frame_idx + CAST({_OFF} AS BIGINT) AS frame, row_number() OVER (PARTITION BY query_id, pos ORDER BY d) - 1 AS depth FROM cand, (SELECT unnest(range(0, 97)) AS d) WHERE frame_idx + {_OFF} BETWEEN 0 AND last_frame) SELECT * FROM l WHERE depth < 12")
def ladder(spark, d):
    c = candidates(spark, d).withColumn("lo", F.lit(0))
    return allocate.frame_ladder(c, "frame_idx", 12, 10, "lo", "last_frame").select("query_id", "pos", "frame", "depth")


@query("m2_slots", f"WITH {CAND}, {SLOTS} SELECT * FROM ro WHERE rank <= 100")
def slots(spark, d):
    return allocate.moment_rows(candidates(spark, d))


@query("m3_hybrid", f"WITH {CAND}, {HYBRID} SELECT * FROM hr WHERE rank <= 100")
def hybrid(spark, d):
    return allocate.hybrid_rows(candidates(spark, d))


def _extras(spark, d):
    k = keyframes(spark, d).where("n in (5, 7)")
    q = query_vectors(spark, d).select("query_id", (F.col("query_id") % 8).alias("most"))
    r = F.explode(F.sequence(F.col("gid") % 8, F.lit(7).cast("long"))).alias("most")  # a remainder of the item or more, so that the sides meet by equality
    x = k.select("gid", "video_id", "frame_idx", r).join(q, "most")
    return x.select("query_id", "video_id", F.col("frame_idx").alias("frame"), F.row_number().over(Window.partitionBy("query_id").orderBy("gid")).alias("rank"))


@query("m4_reserved_tail", f"""WITH {CAND}, {HYBRID}, b AS (SELECT * FROM hr WHERE rank <= 100), x AS (SELECT query_id, video_id, frame_idx AS frame, row_number() OVER (PARTITION BY query_id ORDER BY gid) AS rank FROM k, (SELECT query_id FROM qv) WHERE n IN (5, 7) AND gid % 8 <= query_id % 8),
f AS (SELECT query_id, video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS e FROM x WHERE (query_id, video_id, frame) NOT IN (SELECT query_id, video_id, frame FROM b)), n AS (SELECT query_id, count(*) AS n FROM f GROUP BY query_id),
u AS (SELECT b.query_id, video_id, frame, 0 AS p, rank AS o FROM b LEFT JOIN n USING (query_id) WHERE rank <= 100 - least(coalesce(n, 0), 100) UNION ALL SELECT query_id, video_id, frame, 1, e FROM f WHERE e <= 100) SELECT query_id, video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY p, o) AS rank FROM u""")
def reserved_tail(spark, d):
    return allocate.reserve_tail(allocate.hybrid_rows(candidates(spark, d)), _extras(spark, d))


@query("m5_coverage")
def coverage(spark, d):
    return allocate.coverage_rows(candidates(spark, d, 400))


@query("m6_dispatch_hybrid", f"WITH {CAND}, {HYBRID} SELECT * FROM hr WHERE rank <= 100")
def dispatch_hybrid(spark, d):
    return allocate.allocate(candidates(spark, d), "hybrid")


@query("m6_dispatch")
def dispatch(spark, d):
    """The default, coverage."""
    return allocate.allocate(candidates(spark, d, 400))


@query("m7_lattice", f"WITH {_FR} SELECT query_id, video_id, rank, frames FROM la")
def lattice(spark, d):
    return allocate.sequence_rows(_frames(spark, d))


_LAT = f"{H}, lf AS (SELECT video_id, max(frame_idx) AS last_frame FROM k GROUP BY video_id), a AS (SELECT query_id, video_id, [frame_idx, least(frame_idx + 220, last_frame)] AS frames, last_frame FROM h JOIN lf USING (video_id) WHERE rnk = 1)"


@query("m8_product_lattice", f"""WITH {_LAT}, o AS (SELECT a.*, x, y, [greatest(0, least(frames[1] + x * 10, last_frame)), greatest(0, least(frames[2] + y * 10, last_frame))] AS moved FROM a, (SELECT unnest(range(-6, 7)) AS x), (SELECT unnest(range(-6, 7)) AS y)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, moved ORDER BY abs(x) + abs(y), x, y) AS r FROM o) WHERE r = 1) SELECT query_id, video_id, rank, moved AS frames FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(x) + abs(y), x, y) AS rank FROM u) WHERE rank <= 100""")
def product_lattice(spark, d):
    c = candidates(spark, d, 1)
    a = c.select("query_id", "video_id", F.array("frame_idx", F.least(F.col("frame_idx") + 220, "last_frame")).alias("frames"), "last_frame")
    return allocate.product_lattice(a, 2, 6)


@query("m9_by_video", f"""WITH {CAND}, pv AS (SELECT query_id, pos, video_id, min(pos) OVER (PARTITION BY query_id, video_id) AS f, row_number() OVER (PARTITION BY query_id, video_id ORDER BY pos) - 1 AS m FROM cand), vv AS (SELECT query_id, pos, m, dense_rank() OVER (PARTITION BY query_id ORDER BY f) - 1 AS v FROM pv),
{_slots("0").replace("0 AS cost FROM sl)", "v + CAST(0.5 AS DOUBLE) * m + CAST(0.5 AS DOUBLE) * depth AS cost FROM sl JOIN vv USING (query_id, pos))")} SELECT * FROM ro WHERE rank <= 100""")
def by_video(spark, d):
    return allocate.video_rows(candidates(spark, d))


_PIN = f"""{CAND}, pn AS (SELECT query_id, video_id AS v, CASE query_id % 3 WHEN 0 THEN [frame_idx] WHEN 1 THEN [frame_idx, frame_idx + 110, frame_idx] ELSE [] END AS f, last_frame AS l FROM cand WHERE pos = 4), pu AS (SELECT query_id, v, l, list_distinct(f) AS d, f FROM pn),
le AS (SELECT query_id, len(d) AS flat, 0 AS g, i - 1 AS i, f[i] AS frame_idx, v AS video_id, l AS last_frame FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM pu)), ow AS (SELECT cand.query_id, len(d) AS flat, 1 AS g, pos AS i, frame_idx, video_id, last_frame FROM cand JOIN pu USING (query_id) WHERE video_id = v AND NOT list_contains(d, frame_idx)),
pc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, i) - 1 AS pos FROM (SELECT * FROM le UNION ALL SELECT * FROM ow)), oc AS (SELECT cand.query_id, row_number() OVER (PARTITION BY cand.query_id ORDER BY pos) - 1 AS pos, video_id, frame_idx, last_frame FROM cand JOIN pu USING (query_id) WHERE video_id <> v)"""


@query("m10_pinned", f"""WITH {_PIN}, {_hybrid("CASE WHEN flat > 0 THEN flat ELSE 30 END", 150, "p", "pc")}, {_hybrid("30", 300, "o", "oc")}, u AS (SELECT query_id, video_id, frame, 0 AS p, rank FROM phr WHERE rank <= 50 UNION ALL SELECT query_id, video_id, frame, 1, rank FROM ohr WHERE rank <= 100),
u1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY p, rank) AS r FROM u QUALIFY r = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank, video_id, frame FROM u1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, rank) <= 100""".replace("row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank, video_id", "row_number() OVER (PARTITION BY query_id ORDER BY p, u1.rank) AS rank, video_id").replace("ORDER BY p, rank) <= 100", "ORDER BY p, u1.rank) <= 100"))
def pinned(spark, d):
    """The three cases by query: one confirmed frame, two, none."""
    c = candidates(spark, d)
    f, case = F.col("frame_idx"), F.col("query_id") % 3
    frames = F.when(case == 0, F.array(f)).when(case == 1, F.array(f, f + 110, f))
    return allocate.pinned_rows(c, c.where("pos = 4").select("query_id", "video_id", frames.alias("frames"), "last_frame"), how="hybrid")


@query("m11_respent_tail")
def respent_tail(spark, d):
    c = candidates(spark, d, 200)
    return allocate.respend_tail(allocate.hybrid_rows(c), c)


for _how, _order in (("breadth", "i, f"), ("by_video", "f, rank"), ("density", "dn DESC, rank")):

    @query(f"m12_{_how}", f"WITH {CAND}, {HYBRID}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS i, min(rank) OVER (PARTITION BY query_id, video_id) AS f, count(*) OVER (PARTITION BY query_id, video_id ORDER BY frame RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS dn FROM hr WHERE rank <= 100) SELECT query_id, rank, video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY {_order}) AS new_rank FROM x")
    def reordered(spark, d, how=_how):
        return allocate.reorder(allocate.hybrid_rows(candidates(spark, d)), how)


@query("m13_injected", f"WITH {H}, a AS (SELECT query_id, gid, rnk - 1 AS pos FROM h WHERE rnk <= 40), x AS (SELECT query_id, gid, 40 + row_number() OVER (PARTITION BY query_id ORDER BY rnk) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rnk) AS r FROM h) WHERE r <= 3 AND rnk > 40) SELECT * FROM a UNION ALL SELECT * FROM x")
def injected(spark, d):
    h = hits(spark, d)
    a = h.where("rnk <= 40").select("query_id", "gid", (F.col("rnk") - 1).alias("pos"))
    x = topk.top_per_group(h, ["query_id", "video_id"], [F.asc("rnk")], 3, "r").where("rnk > 40")
    return a.unionByName(x.select("query_id", "gid", (F.row_number().over(Window.partitionBy("query_id").orderBy("rnk")) + 39).cast("long").alias("pos")))


# --- evaluation

#: The truth of query q is the item n = 6 of the video of its first example, with its cell as span.
TRUTH = f"""{K.replace('k AS', 'k0 AS')}, tr AS (SELECT l.query_id, k0.video_id AS truth, frame_idx - 27 AS lo, frame_idx + 27 AS hi FROM (SELECT vec_id // 50 AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS video_id FROM embeddings WHERE vec_id % 50 = 0) l JOIN k0 USING (video_id) WHERE n = 6)"""
SC = f"{CAND}, {HYBRID}, {TRUTH}, an AS (SELECT query_id, rank, CASE WHEN video_id = truth AND frame BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END AS r, video_id, frame, truth, lo, hi FROM hr JOIN tr USING (query_id) WHERE rank <= 100)"


def truth(spark, d):
    lab = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), F.format_string("V%03d", "label").alias("video_id"))
    k = keyframes(spark, d).where("n = 6").select("video_id", "frame_idx")
    return lab.join(k, "video_id").select("query_id", F.col("video_id").alias("truth"), (F.col("frame_idx") - 27).alias("lo"), (F.col("frame_idx") + 27).alias("hi"))


def scored(spark, d, rows=None):
    rows = allocate.hybrid_rows(candidates(spark, d)) if rows is None else rows
    x = rows.join(truth(spark, d), "query_id")
    return x.withColumn("r", evaluate.moment_score(F.col("video_id"), F.col("frame"), F.col("truth"), F.col("lo"), F.col("hi")))


@query("n1_moment_scores", f"WITH {SC} SELECT query_id, rank, r FROM an")
def moment_scores(spark, d):
    return scored(spark, d).select("query_id", "rank", "r")


@query("n1_answer_scores", "SELECT item_id, CASE WHEN a = b OR contains(a, b) OR contains(b, a) THEN 1.0::DOUBLE ELSE 0 END AS r FROM (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[.,;:!?\"'']', '', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(substr(text, 5, 12)), '[.,;:!?\"'']', '', 'g'), '\\s+', ' ', 'g')) AS b FROM benchmark) WHERE length(a) > 0 AND length(b) > 0")
def answer_scores(spark, d):
    return table(spark, d, "benchmark").select("item_id", evaluate.answer_score(F.lit(1.0), F.col("text"), F.substring("text", 5, 12)).alias("r"))


@query("n1_sequence_scores", f"WITH {H} SELECT query_id, gid, ((CASE WHEN frame_idx BETWEEN 500 AND 600 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN frame_idx + 55 BETWEEN 500 AND 600 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN frame_idx + 110 BETWEEN 700 AND 800 THEN 1.0::DOUBLE ELSE 0 END)) / 3 * (CASE WHEN video_id = 'V00' || query_id % 10 THEN 1 ELSE 0 END) AS r FROM h")
def sequence_scores(spark, d):
    f = F.array("frame_idx", F.col("frame_idx") + 55, F.col("frame_idx") + 110)
    spans = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((500, 600), (500, 600), (700, 800))])
    return hits(spark, d).select("query_id", "gid", evaluate.sequence_score(F.col("video_id"), f, F.format_string("V%03d", F.col("query_id") % 10), spans).alias("r"))


FINAL = f"{SC}, fs AS (SELECT query_id, round((coalesce(max(r) FILTER (rank <= 1), 0) + coalesce(max(r) FILTER (rank <= 5), 0) + coalesce(max(r) FILTER (rank <= 20), 0) + coalesce(max(r) FILTER (rank <= 50), 0) + coalesce(max(r) FILTER (rank <= 100), 0)) / 5, 6) AS final_score FROM an GROUP BY query_id)"


@query("n2_final_score", f"WITH {FINAL} SELECT query_id, final_score FROM fs")
def final_score(spark, d):
    return evaluate.final_score(scored(spark, d), ["query_id"], "r", "rank")


@query("n3_strict_sequences", f"WITH {H} SELECT query_id, gid, CASE WHEN n % 2 = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN frame_idx BETWEEN 500 AND 600 THEN 1.0::DOUBLE ELSE 0 END) / 2 END AS r FROM h")
def strict_sequences(spark, d):
    f = F.when(F.col("n") % 2 == 0, F.array("frame_idx")).otherwise(F.array("frame_idx", F.lit(-1).cast("long")))
    spans = F.array(F.array(F.lit(500), F.lit(600)), F.array(F.lit(0), F.lit(9)))
    return hits(spark, d).select("query_id", "gid", evaluate.sequence_score(F.lit("a"), f, F.lit("a"), spans, True).alias("r"))


@query("n4_token_match", "SELECT a.item_id, len(list_intersect(x, y)) = len(x) OR len(list_intersect(x, y)) = len(y) AS subset, round(len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE), 6) >= 0.1 AS similar FROM (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS x FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, list_distinct(string_split(lower(text), ' ')) AS y FROM benchmark) b USING (item_id)")
def token_match(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return t.join(b, "item_id").select("item_id", evaluate.token_subset(F.col("x"), F.col("y")).alias("subset"), (F.round(evaluate.jaccard(F.col("x"), F.col("y")), 6) >= 0.1).alias("similar"))


_DRAW = "CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT AS DOUBLE) / 4294967296"
_CELL = f"{K}, ce AS (SELECT gid, video_id, coalesce(CAST(floor((frame_idx + lag(frame_idx) OVER w) / 2) AS BIGINT), frame_idx - 30) AS lo, coalesce(CAST(floor((frame_idx + lead(frame_idx) OVER w) / 2) AS BIGINT), frame_idx + 30) AS hi FROM k WINDOW w AS (PARTITION BY video_id ORDER BY n))"


@query("n5_moment_draws", f"WITH {_CELL} SELECT gid, i AS draw, CAST(lo + floor({_DRAW.format(seed=7, key='gid || chr(58) || i')} * (hi - lo)) AS BIGINT) AS frame FROM ce, (SELECT unnest(range(1, 5)) AS i)")
def moment_draws(spark, d):
    c = evaluate.moment_cells(keyframes(spark, d)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return c.select("gid", "draw", (F.col("lo") + F.floor(evaluate.draw(7, "gid", "draw") * (F.col("hi") - F.col("lo")))).cast("long").alias("frame"))


@query("n6_first_hit_score", f"WITH {SC}, f AS (SELECT query_id, min(CASE WHEN r = 1 THEN rank END) AS first FROM an GROUP BY query_id) SELECT query_id, CASE WHEN first <= 1 THEN 1.0::DOUBLE WHEN first <= 5 THEN 0.8 WHEN first <= 20 THEN 0.6 WHEN first <= 50 THEN 0.4 WHEN first <= 100 THEN 0.2 ELSE 0 END AS score FROM f")
def first_hit_score(spark, d):
    f = scored(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("r") == 1, F.col("rank"))).alias("first"))
    return f.select("query_id", evaluate.bucket_score(F.col("first")).alias("score"))


def _poisson_steps(n: int = 8) -> list[float]:
    """The distribution function of a Poisson draw of mean 1 at 0 to n - 1."""
    p, c, out = 0.36787944117144233, 0.0, []
    for i in range(n):
        c += p
        out.append(c)
        p /= i + 1
    return out


_WEIGHT = " + ".join(f"CASE WHEN u >= CAST({c!r} AS DOUBLE) THEN 1 ELSE 0 END" for c in _poisson_steps())


@query("n7_bootstrap", f"""WITH {FINAL}, dr AS (SELECT final_score AS x, b, {_DRAW.format(seed=11, key="query_id || chr(58) || b")} AS u FROM fs, (SELECT unnest(range(1, 1001)) AS b)), w AS (SELECT x, b, {_WEIGHT} AS w FROM dr), m AS (SELECT sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY b)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_not_positive FROM m""")
def bootstrap(spark, d):
    return evaluate.bootstrap(evaluate.final_score(scored(spark, d), ["query_id"], "r", "rank"), "query_id", "final_score", 1000, 11)


@query("n8_split", f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(seed=3, key='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents) SELECT doc_id, CASE WHEN r <= floor(c * 0.5) THEN 'tune' ELSE 'test' END AS part FROM r")
def split(spark, d):
    return evaluate.stratified_split(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 3).select("doc_id", "part")


@query("n9_ceilings", f"WITH {SC} SELECT query_id, max(CASE WHEN video_id = truth THEN 1.0::DOUBLE ELSE 0 END) AS perfect_frame, max(r) AS perfect_rank FROM an GROUP BY query_id")
def ceilings(spark, d):
    x = scored(spark, d)
    return x.groupBy("query_id").agg(F.max(F.when(F.col("video_id") == F.col("truth"), 1.0).otherwise(0.0)).alias("perfect_frame"), F.max("r").alias("perfect_rank"))


@query("n10_pool_oracle", f"WITH {CAND}, {TRUTH} SELECT query_id, max(CASE WHEN video_id = truth AND frame_idx BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS in_pool, max(CASE WHEN video_id = truth THEN 1.0::DOUBLE ELSE 0 END) AS video_in_pool FROM cand JOIN tr USING (query_id) GROUP BY query_id")
def pool_oracle(spark, d):
    x = scored(spark, d, candidates(spark, d).withColumnRenamed("frame_idx", "frame"))
    return x.groupBy("query_id").agg(F.max("r").alias("in_pool"), F.max(F.when(F.col("video_id") == F.col("truth"), 1.0).otherwise(0.0)).alias("video_in_pool"))


@query("n11_coverage_diagnostics", f"WITH {SC} SELECT query_id, count(*) FILTER (video_id = truth AND abs(frame - (lo + hi) // 2) <= 50) AS near50, count(*) FILTER (video_id = truth AND abs(frame - (lo + hi) // 2) <= 200) AS near200, count(DISTINCT video_id) AS videos FROM an GROUP BY query_id")
def coverage_diagnostics(spark, d):
    x = scored(spark, d).withColumn("off", F.abs(F.col("frame") - F.floor((F.col("lo") + F.col("hi")) / 2)))
    near = lambda w: F.count_if((F.col("video_id") == F.col("truth")) & (F.col("off") <= w))
    return x.groupBy("query_id").agg(near(50).alias("near50"), near(200).alias("near200"), F.countDistinct("video_id").alias("videos"))


@query("n12_pool_recall", f"WITH {H}, {TRUTH}, x AS (SELECT h.query_id, max(CASE WHEN rnk <= 50 THEN 1 ELSE 0 END) AS a, 1 AS b FROM h JOIN tr ON h.query_id = tr.query_id AND video_id = truth AND frame_idx BETWEEN lo AND hi GROUP BY h.query_id) SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS small, CAST(coalesce(sum(b), 0) AS BIGINT) AS large FROM x")
def pool_recall(spark, d):
    x = scored(spark, d, hits(spark, d).select("query_id", "video_id", F.col("frame_idx").alias("frame"), "rnk")).where("r = 1")
    return x.groupBy("query_id").agg(F.max(F.when(F.col("rnk") <= 50, 1).otherwise(0)).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("small"), F.count("*").alias("large"))


@query("n13_duels", f"WITH {H}, {TRUTH}, a AS (SELECT h.query_id, max(score) AS s FROM h JOIN tr ON h.query_id = tr.query_id AND video_id = truth GROUP BY h.query_id), t AS (SELECT query_id, rnk, score FROM h WHERE rnk <= 3) SELECT rnk, round(avg(CASE WHEN a.s > score THEN 1.0::DOUBLE WHEN a.s = score THEN 0.5 ELSE 0 END), 6) AS win_rate FROM t JOIN a USING (query_id) GROUP BY rnk")
def duels(spark, d):
    h = hits(spark, d)
    a = h.join(truth(spark, d), "query_id").where("video_id = truth").groupBy("query_id").agg(F.max("score").alias("s"))
    t = h.where("rnk <= 3").join(a, "query_id")
    return t.groupBy("rnk").agg(F.round(F.avg(F.when(F.col("s") > F.col("score"), 1.0).when(F.col("s") == F.col("score"), 0.5).otherwise(0.0)), 6).alias("win_rate"))


@query("n14_sequence_levels", f"WITH {_CHAIN}, r AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS r FROM best) SELECT query_id, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END AS base, 1.0::DOUBLE AS oracle_video FROM r WHERE video_id = 'V' || lpad(CAST(query_id AS VARCHAR), 3, '0')")
def sequence_levels(spark, d):
    r = align.search(events(spark, d).where("n > 2"), 1000, lam=0.01, gap=2)
    return r.where(F.col("video_id") == F.format_string("V%03d", F.col("query_id"))).select("query_id", F.when(F.col("rnk") == 1, 1.0).otherwise(0.0).alias("base"), F.lit(1.0).alias("oracle_video"))


@query("n15_grid", f"WITH {CAND}, {TRUTH}, g AS (SELECT unnest([5, 10, 20]) AS step), x AS (SELECT step, query_id, min(pos) AS first FROM cand JOIN tr USING (query_id), g WHERE video_id = truth AND frame_idx BETWEEN lo - step AND hi + step GROUP BY ALL) SELECT CAST(step AS BIGINT) AS step, count(*) AS found, round(avg(first), 6) AS mean_first FROM x GROUP BY step")
def grid(spark, d):
    g = spark.createDataFrame([(5,), (10,), (20,)], "step int")  # the grid of parameters
    x = candidates(spark, d).join(truth(spark, d), "query_id").join(F.broadcast(g)).where((F.col("video_id") == F.col("truth")) & F.col("frame_idx").between(F.col("lo") - F.col("step"), F.col("hi") + F.col("step")))
    return x.groupBy("step", "query_id").agg(F.min("pos").alias("first")).groupBy("step").agg(F.count("*").alias("found"), F.round(F.avg("first"), 6).alias("mean_first"))


@query("n16_binomial_error", "SELECT source, count(*) AS n, round(avg(quality), 6) AS p, round(sqrt(avg(quality) * (1 - avg(quality)) / count(*)), 6) AS se FROM labels JOIN documents USING (doc_id) GROUP BY source")
def binomial_error(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    p = F.avg("quality")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.round(p, 6).alias("p"), F.round(F.sqrt(p * (1 - p) / F.count("*")), 6).alias("se"))


@query("n17_verdicts", "SELECT doc_id, CASE WHEN q IS NULL THEN 'unchecked' WHEN q = 1 AND n >= 500 AND t = 0 THEN 'pass' ELSE 'reject' END AS verdict FROM (SELECT doc_id, quality AS q, toxic AS t, n_chars AS n FROM documents LEFT JOIN labels USING (doc_id))")
def verdicts(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("quality").isNull(), "unchecked").when((F.col("quality") == 1) & (F.col("n_chars") >= 500) & (F.col("toxic") == 0), "pass").otherwise("reject").alias("verdict"))


@query("n19_failure_classes", f"WITH {SC}, x AS (SELECT query_id, max(r) AS hit, max(CASE WHEN video_id = truth THEN 1 ELSE 0 END) AS v, min(CASE WHEN video_id = truth THEN abs(frame - (lo + hi) // 2) END) AS near FROM an GROUP BY query_id) SELECT query_id, CASE WHEN hit = 1 THEN 'hit' WHEN v = 0 THEN 'wrong video' WHEN near <= 200 THEN 'placement' ELSE 'no near row' END AS failure, near FROM x")
def failure_classes(spark, d):
    x = scored(spark, d).withColumn("same", F.col("video_id") == F.col("truth"))
    g = x.groupBy("query_id").agg(F.max("r").alias("hit"), F.bool_or("same").alias("v"), F.min(F.when(F.col("same"), F.abs(F.col("frame") - F.floor((F.col("lo") + F.col("hi")) / 2)))).alias("near"))
    return g.select("query_id", F.when(F.col("hit") == 1, "hit").when(~F.col("v"), "wrong video").when(F.col("near") <= 200, "placement").otherwise("no near row").alias("failure"), "near")


@query("n20_detectable_effect", "SELECT source, round(2.8 * stddev_pop(n_chars) * sqrt(2.0 / count(*)), 4) AS mde FROM documents GROUP BY source")
def detectable_effect(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(2.8 * F.stddev_pop("n_chars") * F.sqrt(2.0 / F.count("*")), 4).alias("mde"))


@query("n21_snake_split", "SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) - 1) % 4 IN (0, 3) THEN 'tune' ELSE 'test' END AS part FROM documents")
def snake_split(spark, d):
    return evaluate.snake_split(table(spark, d, "documents"), ["source", "lang"], "n_chars", "doc_id").select("doc_id", "part")


@query("n22_strict_ranks", f"WITH {S}, {TRUTH}, a AS (SELECT s.query_id, max(score) AS s FROM s JOIN tr ON s.query_id = tr.query_id AND video_id = truth AND frame_idx BETWEEN lo AND hi GROUP BY s.query_id) SELECT s.query_id, 1 + count(*) FILTER (score > a.s) AS rank FROM s JOIN a USING (query_id) GROUP BY s.query_id")
def strict_ranks(spark, d):
    return evaluate.product_ranks(keyframes(spark, d), query_vectors(spark, d), truth(spark, d), "v", ["qv"], lambda s: vector.rounded(s, 6))


@query("n23_saturation", f"WITH {S}, {TRUTH}, r AS (SELECT s.query_id, n, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, gid) AS r FROM s JOIN tr ON s.query_id = tr.query_id AND video_id = truth) SELECT query_id, abs(max(CASE WHEN r = 1 THEN n END) - 6) <= 6 AS within6, max(CASE WHEN n = 6 THEN r END) AS rank FROM r GROUP BY query_id")
def saturation(spark, d):
    x = scores(spark, d).join(truth(spark, d), "query_id").where("video_id = truth")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")))
    return x.groupBy("query_id").agg((F.abs(F.max(F.when(F.col("r") == 1, F.col("n"))) - 6) <= 6).alias("within6"), F.max(F.when(F.col("n") == 6, F.col("r"))).alias("rank"))


@query("n24_run_difference", f"WITH {CAND}, {HYBRID}, a AS (SELECT * FROM ro WHERE rank <= 100), b AS (SELECT * FROM hr WHERE rank <= 100) SELECT b.query_id, count(*) FILTER (a.rank IS NULL) AS fresh, count(*) FILTER (a.rank IS NOT NULL AND a.rank <> b.rank) AS moved, count(DISTINCT b.video_id) AS videos FROM b LEFT JOIN a ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.frame = b.frame GROUP BY b.query_id")
def run_difference(spark, d):
    c = candidates(spark, d)
    a = allocate.moment_rows(c).withColumnRenamed("rank", "old")
    x = allocate.hybrid_rows(c).join(a, ["query_id", "video_id", "frame"], "left")
    return x.groupBy("query_id").agg(F.count_if(F.col("old").isNull()).alias("fresh"), F.count_if(F.col("old") != F.col("rank")).alias("moved"), F.countDistinct("video_id").alias("videos"))


@query("n25_permutation_oracle", f"WITH {H}, {TRUTH}, x AS (SELECT h.query_id, h.video_id, max(score) AS top, max(CASE WHEN frame_idx BETWEEN lo AND hi THEN score END) AS own FROM h JOIN tr ON h.query_id = tr.query_id AND video_id = truth GROUP BY ALL) SELECT query_id, top - own AS gain FROM x WHERE own IS NOT NULL".replace("top - own AS gain", "round(top - own, 6) AS gain"))
def permutation_oracle(spark, d):
    x = hits(spark, d).join(truth(spark, d), "query_id").where("video_id = truth")
    g = x.groupBy("query_id").agg(F.max("score").alias("top"), F.max(F.when(F.col("frame_idx").between(F.col("lo"), F.col("hi")), F.col("score"))).alias("own"))
    return g.where("own is not null").select("query_id", F.round(F.col("top") - F.col("own"), 6).alias("gain"))


@query("n26_noise_floor", "SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS lost, count(*) FILTER (quality = 0 AND toxic = 0) AS won FROM labels JOIN documents USING (doc_id) GROUP BY source")
def noise_floor(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return x.groupBy("source").agg(F.count_if(F.expr("quality = 1 and toxic = 1")).alias("lost"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("won"))


@query("flagship_retrieval", f"WITH {FINAL} SELECT query_id, final_score FROM fs")
def flagship(spark, d):
    """Vectors to scores: similarity, mask, top candidates, allocation, evaluation."""
    return final_score(spark, d)
