"""Queries of measurement: resampling, split nulls, power, gates, and what follows from whole runs (C, D, N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions import arrays
from keymoment.operators import align, allocate, ceilings, evaluate, fusion, joins, resampling, vector
from keymoment.operators import evidence as shown

from . import scan_queries  # noqa: F401  its SQL of d10_rocchio is used below
from .answer_queries import _CELL, _DRAW, _FR, CAND, EVENTS, FINAL, HYBRID, TRUTH, _frames, _hybrid, candidates, events, scored, truth
from .corpus import N_ITEMS, N_QUERIES, H, K, S, dealt, hits, keyframes, query_vectors, scores, table
from .registry import ORACLE, query

def _final(spark, d):
    return evaluate.final_score(scored(spark, d), ["query_id"], "r", "rank")


_N7 = f"""WITH {FINAL}, nu AS (SELECT query_id, final_score AS x, row_number() OVER (ORDER BY substr(md5(query_id::VARCHAR), 1, 2), query_id) - 1 AS idx, count(*) OVER () AS n FROM fs),
sn AS (SELECT b AS resample, n, unnest(range(n)) AS slot FROM (SELECT unnest(range(4000)) AS b), (SELECT count(*) AS n FROM fs)),
dn AS (SELECT resample, CAST(floor({_DRAW.format(seed=13, key="resample || chr(58) || slot")} * n) AS BIGINT) AS idx FROM sn), mn AS (SELECT round(sum(x) / max(n), 9) AS m FROM dn JOIN nu USING (idx) GROUP BY resample)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_not_positive FROM mn"""


@query("n7_resampled", _N7)
def resampled(spark, d):
    """4,000 resamples of as many queries as there are, with replacement."""
    return resampling.interval(resampling.resampled_means(_final(spark, d), "query_id", "final_score", 4000, 13))


_STRATA = "sq AS (SELECT vec_id // 50 AS query_id, label % 2 AS stratum FROM embeddings WHERE vec_id % 50 = 0), q AS (SELECT query_id, stratum, final_score AS x FROM fs JOIN sq USING (query_id))"


def _stratified(spark, d):
    strata = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), (F.col("label") % 2).alias("stratum"))
    return _final(spark, d).join(strata, "query_id")


@query("n8_half_split_null", f"""WITH {FINAL}, {_STRATA}, ob AS (SELECT avg(x) FILTER (NOT first) - avg(x) FILTER (first) AS observed FROM (SELECT x, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW.format(seed=3, key='query_id')}, query_id) <= floor(count(*) OVER (PARTITION BY stratum) * 0.5) AS first FROM q)),
hs AS (SELECT split, avg(x) FILTER (NOT first) - avg(x) FILTER (first) AS gap FROM (SELECT split, x, row_number() OVER (PARTITION BY split, stratum ORDER BY {_DRAW.format(seed=17, key="split || chr(58) || query_id")}, query_id) <= count(*) OVER (PARTITION BY split, stratum) // 2 AS first FROM q, (SELECT unnest(range(1, 2001)) AS split)) GROUP BY split),
x AS (SELECT round(gap, 9) AS gap, round(observed, 9) AS observed FROM hs, ob)
SELECT round(observed, 6) AS observed, count(gap) AS splits, round(stddev_samp(gap), 6) AS sd, round(quantile_cont(abs(gap), 0.95), 6) AS p95, round(max(abs(gap)), 6) AS most, round(avg(CASE WHEN abs(gap) >= abs(observed) THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_value FROM x GROUP BY observed""")
def half_split_null(spark, d):
    """The gap of one split of the queries against those of 2,000 random ones, halves within strata."""
    q = _stratified(spark, d)
    part = evaluate.stratified_split(q, ["stratum"], "query_id", 3)
    gap = lambda p: F.avg(F.when(F.col("part") == p, F.col("final_score")))
    return resampling.against_null(part.agg((gap("test") - gap("tune")).alias("gap")), resampling.half_splits(q, ["stratum"], "query_id", "final_score", 2000, 17))


_K = {"three": "least(3, n)", "eleven": "least(11, n)", "third": "n // 3", "every_mixed": "n", "every": "n"}
_SHAPE = ", ".join(f"{_K[name]} AS {name}_k, greatest(1, CAST(round({_K[name]} * CAST({share!r} AS DOUBLE)) AS BIGINT)) AS {name}_u" for name, _, share in resampling.SHAPES)
_SUMS = ", ".join(f"sum(CASE WHEN idx < {name}_u THEN 1 WHEN idx < {name}_k THEN -1 ELSE 0 END) AS {name}" for name in _K)
_FOUND = ", ".join(f"CASE WHEN quantile_cont({name}, 0.025) > 0 THEN 1.0::DOUBLE ELSE 0 END AS {name}" for name in _K)
_ROWS = " UNION ALL ".join(f"SELECT grp, '{name}' AS shape, n, {name}_k AS changed, {name}_u AS up, round({name}, 6) AS power, CASE WHEN round({name}, 6) >= 0.8 AND base > 0 AND 2 * {name}_u > {name}_k THEN 0.001::DOUBLE END AS mde FROM sh JOIN g USING (grp)" for name in _K)


@query("n20_power", f"""WITH {FINAL}, {_STRATA}, g0 AS (SELECT 'all' AS grp, count(*) AS n, avg(x) AS base FROM q UNION ALL SELECT CAST(stratum AS VARCHAR), count(*), avg(x) FROM q GROUP BY stratum),
g AS (SELECT *, {_SHAPE} FROM g0), sx AS (SELECT *, unnest(range(n * 8000)) AS id FROM g), sy AS (SELECT *, id // (n * 200) AS rep, id // n % 200 AS resample, id % n AS slot FROM sx),
dx AS (SELECT *, CAST(floor({_DRAW.format(seed=19, key="n || chr(58) || rep || chr(58) || resample || chr(58) || slot")} * n) AS BIGINT) AS idx FROM sy),
pm AS (SELECT grp, rep, resample, {_SUMS} FROM dx GROUP BY ALL), e AS (SELECT grp, rep, {_FOUND} FROM pm GROUP BY grp, rep), sh AS (SELECT grp, {", ".join(f"avg({n}) AS {n}" for n in _K)} FROM e GROUP BY grp) {_ROWS}""")
def power(spark, d):
    """40 experiments of 200 resamples for five shapes of an effect, over all queries and each stratum's."""
    q = _stratified(spark, d)
    each = F.explode(F.array(F.lit("all"), F.col("stratum").cast("string"))).alias("grp")
    groups = q.select(each, "final_score").groupBy("grp").agg(F.count("*").alias("n"), F.avg("final_score").alias("base"))
    return resampling.power(groups, "grp", 40, 200, 19)


def _gap_sql(axis: str) -> str:
    gap = "avg(n_chars) FILTER (part = 'test') - avg(n_chars) FILTER (part = 'tune')"
    return f"""WITH r AS (SELECT source, lang, n_chars, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(seed=3, key='doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.5) THEN 'tune' ELSE 'test' END AS part FROM documents),
    o AS (SELECT {axis}, count(*) AS n, {gap} AS gap FROM r GROUP BY {axis}), x AS (SELECT sum(n * gap) FILTER (gap IS NOT NULL) / sum(n) FILTER (gap IS NOT NULL) AS gap FROM o), w AS (SELECT {gap} AS raw FROM r)
    SELECT round(raw, 6) AS raw, round(gap, 6) AS gap, CASE WHEN abs(raw) > 1e-9 THEN round(1 - abs(gap) / abs(raw), 6) END AS explained FROM x, w"""


@query("n20_post_stratified", _gap_sql("lang"))
def post_stratified(spark, d):
    """How much of the gap in length between two halves of the documents their languages explain."""
    part = evaluate.stratified_split(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source"], "doc_id", 3)
    return resampling.post_stratified(part, "lang", "part", "n_chars")


_GREY = "list_transform(range(1, 65), lambda i: least(255, greatest(0, round(128 + 100 * CAST(embedding[i] AS DOUBLE)))))"


@query("c10_picture_gates", f"""WITH p AS (SELECT vec_id, {_GREY} AS g FROM embeddings), l AS (SELECT vec_id, list_stddev_pop(g) AS sd, list_var_pop(list_transform(list_filter(range(9, 57), lambda i: (i - 1) % 8 > 0 AND (i - 1) % 8 < 7), lambda i: abs(g[i - 8] + g[i + 8] + g[i - 1] + g[i + 1] - 4 * g[i]))) AS sharp FROM p)
SELECT vec_id, round(sd, 6) AS sd, round(sharp, 4) AS sharpness, round(sd, 6) >= 12 AND round(sharp, 4) >= 20 AS kept FROM l""")
def picture_gates(spark, d):
    """A vector's first 64 numbers as an 8 x 8 picture of greys: flat ones and blurred ones go."""
    grey = F.transform(F.slice("embedding", 1, 64), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(128 + 100 * x.cast("double")))))
    e = table(spark, d, "embeddings").select("vec_id", grey.alias("g"))
    e = e.select("vec_id", F.round(arrays.deviation(F.col("g")), 6).alias("sd"), F.round(arrays.sharpness(F.col("g"), 8), 4).alias("sharpness"))
    return e.withColumn("kept", (F.col("sd") >= 12) & (F.col("sharpness") >= 20))


@query("d17_cross_video", f"""WITH {K}, nu AS (SELECT gid, video_id, v, row_number() OVER (ORDER BY substr(md5(gid::VARCHAR), 1, 2), gid) - 1 AS idx, count(*) OVER () AS n FROM k),
dr AS (SELECT gid, video_id, v, CAST(floor({_DRAW.format(seed=23, key="gid || chr(58) || slot")} * n) AS BIGINT) AS other FROM nu, (SELECT unnest(range(1, 5)) AS slot)),
c AS (SELECT round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS c FROM dr a JOIN nu b ON a.other = b.idx WHERE a.video_id <> b.video_id)
SELECT count(*) AS pairs, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.95), 6) AS p95, round(avg(CASE WHEN c < 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low FROM c""")
def cross_video(spark, d):
    """The cosines of pairs of different videos, against which those within a video are to be read: four drawn partners of every item."""
    c = vector.drawn_pairs(keyframes(spark, d), "gid", "video_id", "v", 4, 23)
    c = c.select(F.round("cosine", 9).alias("c"))
    q = lambda p: F.round(F.percentile("c", p), 6)
    return c.agg(F.count("*").alias("pairs"), q(0.5).alias("median"), q(0.05).alias("p5"), q(0.95).alias("p95"), F.round(F.avg(F.when(F.col("c") < 0.5, 1.0).otherwise(0.0)), 6).alias("low"))


@query("d17_step_percentile", f"""WITH {K}, c AS (SELECT gid, video_id, round(list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))), 9) AS c FROM (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY n) AS p, count(*) OVER (PARTITION BY video_id) AS many FROM k) WHERE p IS NOT NULL AND many >= 4)
SELECT gid, video_id, round((rank() OVER (PARTITION BY video_id ORDER BY c) - 1) / count(*) OVER (PARTITION BY video_id), 6) AS percentile, c < 0.5 AS low FROM c""")
def step_percentile(spark, d):
    """Where an item's cosine with the one before stands among those of its video (of four items or more): the share below it."""
    c = vector.adjacent_cosine(keyframes(spark, d), "video_id", "n", "v", 1).withColumn("c", F.round("cosine", 9))
    w = Window.partitionBy("video_id")
    c = c.withColumn("many", F.count("*").over(w)).where("c is not null and many >= 4")
    return c.select("gid", "video_id", F.round((F.rank().over(w.orderBy("c")) - 1) / F.count("*").over(w), 6).alias("percentile"), (F.col("c") < 0.5).alias("low"))


_SAID = "vn AS (SELECT count(DISTINCT label) AS videos FROM embeddings), sp AS (SELECT 'V' || lpad(CAST(conv_id % videos AS VARCHAR), 3, '0') AS video_id, turn * CAST(3.0 AS DOUBLE) AS start, conv_id AS no, text FROM conversations, vn)"


@query("q8_evidence_parts", f"""WITH {H}, {_SAID}, a AS (SELECT query_id, video_id, n, pts_time FROM h WHERE rnk = 1),
st AS (SELECT unnest([0, -1, 1, -2, 2]) AS step, unnest(range(5)) AS pos), fp AS (SELECT query_id, 1 AS part, pos, k.video_id, k.gid, NULL::VARCHAR AS text FROM a, st JOIN k ON k.video_id = a.video_id AND k.n = a.n + step),
o AS (SELECT h.query_id, h.video_id, h.gid, h.rnk FROM h JOIN a ON h.query_id = a.query_id AND h.video_id <> a.video_id WHERE rnk <= 24 QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id ORDER BY rnk) = 1),
op AS (SELECT query_id, 2 AS part, row_number() OVER (PARTITION BY query_id ORDER BY rnk) - 1 AS pos, video_id, gid, NULL::VARCHAR AS text FROM o QUALIFY pos < 2),
tp AS (SELECT query_id, 3 AS part, 0 AS pos, a.video_id, NULL::BIGINT AS gid, string_agg(text, ' ' ORDER BY start, no, text) AS text FROM a JOIN sp ON sp.video_id = a.video_id AND abs(a.pts_time - start) <= 30 GROUP BY query_id, a.video_id)
SELECT query_id, CAST(part AS BIGINT) AS part, CAST(pos AS BIGINT) AS pos, video_id, gid, text FROM (SELECT * FROM fp UNION ALL SELECT * FROM op UNION ALL SELECT * FROM tp)""")
def evidence_parts(spark, d):
    """Conversations are the videos' speech, dealt to them by the remainder of their number."""
    videos = table(spark, d, "embeddings").agg(F.countDistinct("label").alias("videos"))
    said = table(spark, d, "conversations").join(F.broadcast(videos))  # one row
    said = said.select(F.format_string("V%03d", F.col("conv_id") % F.col("videos")).alias("video_id"), (F.col("turn") * 3.0).alias("start"), F.col("conv_id").alias("no"), "text")
    return shown.evidence(hits(spark, d, 24), keyframes(spark, d), said)


_LEVELS = (
    _FR.split(",\nof AS (")[0]
    + """, tv AS (SELECT vec_id // 200 AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS truth FROM embeddings WHERE vec_id % 200 = 0),
tf AS (SELECT query_id, truth, list(frame_idx ORDER BY n) AS moments FROM tv JOIN k ON video_id = truth AND n IN (4, 7, 10, 13) GROUP BY ALL), lv AS (SELECT video_id, max(frame_idx) AS last FROM k GROUP BY video_id),
l0 AS (SELECT fr.query_id, 1 AS r, fr.video_id, f FROM fr WHERE r = 1 UNION ALL SELECT fr.query_id, 2, fr.video_id, moments FROM fr JOIN tf USING (query_id) WHERE r = 1 UNION ALL SELECT tf.query_id, 3, truth, moments FROM tf JOIN fr USING (query_id) WHERE r = 1),
ll AS (SELECT l0.*, last FROM l0 JOIN lv USING (video_id)), of AS ("""
    + _FR.split(",\nof AS (")[1].replace("last))) AS frames FROM fr,", "last))) AS frames FROM ll,").replace("PARTITION BY query_id, video_id", "PARTITION BY query_id, r, video_id")
)


@query("n14_levels", f"""WITH {_LEVELS}, sc AS (SELECT la.query_id, r, w, rank, CASE WHEN video_id = truth THEN len(list_filter(list_zip(frames, moments), lambda p: abs(p[1] - p[2]) <= w)) / 4::DOUBLE ELSE 0 END AS s FROM la JOIN tf USING (query_id), (SELECT unnest([6, 10, 20]) AS w)),
fl AS (SELECT query_id, r, w, round((coalesce(max(s) FILTER (rank <= 1), 0) + coalesce(max(s) FILTER (rank <= 5), 0) + coalesce(max(s) FILTER (rank <= 20), 0) + coalesce(max(s) FILTER (rank <= 50), 0) + coalesce(max(s) FILTER (rank <= 100), 0)) / 5, 6) AS s FROM sc GROUP BY ALL)
SELECT query_id, CASE r WHEN 1 THEN 'base' WHEN 2 THEN 'true moments' ELSE 'true video' END AS level, round(avg(s), 6) AS score FROM fl GROUP BY query_id, r""")
def levels(spark, d):
    """What is lost to placing the events and what to choosing the video: the rows of a query's best alignment, of the true moments in its video, and of
    those in the true one, each scored with windows of 6, 10 and 20 frames in one pass."""
    best = _frames(spark, d).where("rnk = 1").select("query_id", "video_id", "frames")
    k = keyframes(spark, d)
    own = table(spark, d, "embeddings").where("vec_id % 200 = 0").select(F.floor(F.col("vec_id") / 200).alias("query_id"), F.format_string("V%03d", "label").alias("truth"))
    moments = F.transform(F.sort_array(F.collect_list(F.struct("n", "frame_idx"))), lambda x: x["frame_idx"])
    true = own.join(k.where("n in (4, 7, 10, 13)").select(F.col("video_id").alias("truth"), "n", "frame_idx"), "truth").groupBy("query_id", "truth").agg(moments.alias("moments"))
    level = lambda no, video, frames: F.struct(F.lit(no).alias("level"), F.col(video).alias("video_id"), F.col(frames).alias("frames"))
    each = F.explode(F.array(level(1, "video_id", "frames"), level(2, "video_id", "moments"), level(3, "truth", "moments"))).alias("x")
    both = best.join(true, "query_id").select("query_id", each).select((F.col("query_id") * 4 + F.col("x.level")).alias("query_id"), "x.video_id", "x.frames")
    rows = allocate.sequence_rows(both.join(k.groupBy("video_id").agg(F.max("frame_idx").alias("last_frame")), "video_id"))
    rows = rows.withColumn("level", F.col("query_id") % 4).withColumn("query_id", F.floor(F.col("query_id") / 4)).join(true, "query_id").withColumn("w", F.explode(F.array(F.lit(6), F.lit(10), F.lit(20))))
    spans = F.transform("moments", lambda m: F.array(m - F.col("w"), m + F.col("w")))
    s = rows.withColumn("s", evaluate.sequence_score(F.col("video_id"), F.col("frames"), F.col("truth"), spans))
    name = F.element_at(F.array(*map(F.lit, ("base", "true moments", "true video"))), F.col("level").cast("int"))
    return evaluate.final_score(s, ["query_id", "level", "w"], "s", "rank").groupBy("query_id", name.alias("level")).agg(F.round(F.avg("final_score"), 6).alias("score"))


#: Ranks of the answers before and after feedback from the best items.
_BOTH = ORACLE["d10_rocchio"].rpartition("\nSELECT ")
_BOTH = f"""{_BOTH[0]}, fb AS (SELECT {_BOTH[2]}), {TRUTH}, own AS (SELECT s.query_id, max(s.score) AS a, max(fb.score) AS b FROM s JOIN fb USING (query_id, gid) JOIN tr ON s.query_id = tr.query_id AND s.video_id = truth AND s.frame_idx BETWEEN lo AND hi GROUP BY s.query_id),
rk AS (SELECT own.query_id, 1 + count(*) FILTER (s.score > a) AS direct, 1 + count(*) FILTER (fb.score > b) AS fed FROM s JOIN fb USING (query_id, gid) JOIN own ON own.query_id = s.query_id GROUP BY own.query_id)"""


def _ranks(spark, d):
    """query_id, direct, fed: the answer's strict rank by the vectors alone, and with feedback."""
    k, t, q = keyframes(spark, d), truth(spark, d), query_vectors(spark, d)
    a = evaluate.product_ranks(k, q, t, "v", ["qv"], lambda s: vector.rounded(s, 6))
    b = evaluate.product_ranks(k, fusion.feedback(k, q, 5), t, "v", ["qv", "centre"], lambda s, f: vector.rounded(vector.rounded(s, 6) + 0.3 * f, 5))
    return a.withColumnRenamed("rank", "direct").join(b.withColumnRenamed("rank", "fed"), "query_id")


@query("n22_rank_table", f"{_BOTH}, u AS (SELECT 'direct' AS scoring, direct AS rank FROM rk UNION ALL SELECT 'feedback', fed FROM rk) SELECT scoring, count(*) AS n, quantile_cont(rank, 0.5) AS median, count(*) FILTER (rank = 1) AS first, count(*) FILTER (rank <= 5) AS top5 FROM u GROUP BY scoring")
def rank_table(spark, d):
    each = F.explode(F.array(F.struct(F.lit("direct").alias("scoring"), F.col("direct").alias("rank")), F.struct(F.lit("feedback").alias("scoring"), F.col("fed").alias("rank")))).alias("x")
    return evaluate.rank_table(_ranks(spark, d).select(each).select("x.*"), ["scoring"])


@query("n22_paired", f"""{_BOTH}, nu AS (SELECT direct - fed AS x, row_number() OVER (ORDER BY substr(md5(query_id::VARCHAR), 1, 2), query_id) - 1 AS idx FROM rk), nn AS (SELECT count(*) AS n FROM rk),
dn AS (SELECT resample, n, CAST(floor({_DRAW.format(seed=29, key="resample || chr(58) || slot")} * n) AS BIGINT) AS idx FROM (SELECT b AS resample, n, unnest(range(n)) AS slot FROM (SELECT unnest(range(4000)) AS b), nn)), mn AS (SELECT round(sum(x) / max(n), 9) AS m FROM dn JOIN nu USING (idx) GROUP BY resample),
wl AS (SELECT count(*) FILTER (fed < direct) AS win, count(*) FILTER (fed > direct) AS lose, count(*) FILTER (fed = direct) AS tie FROM rk)
SELECT win, lose, tie, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_not_positive FROM mn, wl GROUP BY ALL""")
def paired_ranks(spark, d):
    """Wins, losses and ties of feedback against the vectors alone, and the places gained, resampled by query 4,000 times."""
    x = fusion.kept(_ranks(spark, d), "ranks").withColumn("gain", (F.col("direct") - F.col("fed")).cast("double"))
    verdicts = x.agg(F.count_if(F.col("gain") > 0).alias("win"), F.count_if(F.col("gain") < 0).alias("lose"), F.count_if(F.col("gain") == 0).alias("tie"))
    return verdicts.join(F.broadcast(resampling.interval(resampling.resampled_means(x, "query_id", "gain", 4000, 29))))  # one row each


@query("n24_first_rows", f"WITH {CAND}, {HYBRID}, a AS (SELECT * FROM ro WHERE rank = 1), b AS (SELECT * FROM hr WHERE rank = 1) SELECT query_id, a.video_id <> b.video_id AS video_changed, a.video_id <> b.video_id OR a.frame <> b.frame AS row_changed FROM a JOIN b USING (query_id)")
def first_rows(spark, d):
    """Whether the first row, and its video, differ between the allocation by cost alone and the hybrid one."""
    c = candidates(spark, d)
    return evaluate.first_rows(allocate.moment_rows(c), allocate.hybrid_rows(c))


_BUDGETS = ", ".join(f"({i}, '{name}', {v}, {f})" for i, (name, (v, f)) in enumerate(zip(ceilings.levels(), ((0, 0), (9999, 9999), (9999, 9999), *ceilings.BUDGETS), strict=True)))
_JUDGED = f"""{CAND}, {TRUTH}, lv AS (SELECT * FROM (VALUES {_BUDGETS}) AS t(no, level, v, f)), jf AS (SELECT *, min(pos) OVER (PARTITION BY query_id, video_id) AS first, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, pos) AS fr FROM cand),
jv AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS vr FROM jf), jl AS (SELECT jv.*, no, vr <= v AND fr <= f AS shown, CASE WHEN no = 1 THEN score WHEN vr <= v AND fr <= f AND video_id = truth THEN -abs(frame_idx - (lo + hi) // 2) END AS key FROM jv JOIN tr USING (query_id), lv),
jr AS (SELECT *, key IS NULL AS fixed, row_number() OVER (PARTITION BY query_id, no, video_id, key IS NULL ORDER BY key DESC, pos) AS kr, row_number() OVER (PARTITION BY query_id, no, video_id, key IS NULL ORDER BY score DESC, pos) AS sr FROM jl),
jp AS (SELECT a.*, CASE WHEN a.fixed THEN a.score ELSE b.score END AS permuted FROM jr a LEFT JOIN jr b ON a.query_id = b.query_id AND a.no = b.no AND a.video_id = b.video_id AND a.fixed = b.fixed AND a.kr = b.sr),
jc AS (SELECT query_id * 64 + no AS query_id, row_number() OVER (PARTITION BY query_id, no ORDER BY permuted DESC, pos) - 1 AS pos, video_id, frame_idx, last_frame, shown, permuted FROM jp)"""


@query("n25_judged", f"WITH {_JUDGED} SELECT query_id // 64 AS query_id, query_id % 64 AS level, pos, video_id, frame_idx, permuted AS score, shown FROM jc")
def judged(spark, d):
    """Candidates by level: as they are, permuted by their own scores, by the truth, and by the truth within what a judge sees."""
    return ceilings.judged(candidates(spark, d), truth(spark, d)).drop("last_frame")


@query("n25_ceilings", f"""WITH {_JUDGED}, {_hybrid(p="c_", cand="jc")}, sc AS (SELECT h.query_id // 64 AS query_id, h.query_id % 64 AS no, rank, CASE WHEN video_id = truth AND frame BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END AS r FROM c_hr h JOIN tr ON h.query_id // 64 = tr.query_id WHERE rank <= 100),
fs AS (SELECT query_id, no, round((coalesce(max(r) FILTER (rank <= 1), 0) + coalesce(max(r) FILTER (rank <= 5), 0) + coalesce(max(r) FILTER (rank <= 20), 0) + coalesce(max(r) FILTER (rank <= 50), 0) + coalesce(max(r) FILTER (rank <= 100), 0)) / 5, 6) AS s FROM sc GROUP BY ALL),
ls AS (SELECT no, count(*) AS queries, round(avg(s), 6) AS score FROM fs GROUP BY no), sn AS (SELECT query_id % 64 AS no, count(*) FILTER (shown) AS pictures FROM jc GROUP BY ALL), en AS (SELECT max(score) FILTER (no = 0) AS b, max(score) FILTER (no = 2) AS o FROM ls)
SELECT level, queries, pictures, CAST(ceil(pictures / 8) AS BIGINT) AS batches, score, CASE WHEN b > 0 THEN round(100 * (score - b) / b, 4) END AS gain, CASE WHEN o > b THEN round(100 * (score - b) / (o - b), 4) ELSE 0 END AS reach FROM ls JOIN sn USING (no) JOIN lv USING (no), en""")
def hybrid_ceilings(spark, d):
    return ceilings.ceilings(candidates(spark, d), truth(spark, d), allocate.hybrid_rows)


@query("n25_coverage_ceilings")
def coverage_ceilings(spark, d):
    """The same by the coverage allocation, whose prior is the scores; of the candidates that it gets in an answer."""
    return ceilings.ceilings(candidates(spark, d, 400), truth(spark, d), allocate.coverage_rows)


_CAND400 = CAND.replace("WHERE rnk <= 60", "WHERE rnk <= 400")
_RADII = "(SELECT unnest([20, 60, 120, 240]) AS w)"


def _anchored(df, truth):
    """df's rows of every query with a truth, with off: the distance from the truth's middle, null in another video."""
    off = F.when(F.col("video_id") == F.col("truth"), F.abs(F.col("frame") - F.floor((F.col("lo") + F.col("hi")) / 2)))
    return df.join(truth, "query_id").withColumn("off", off)


@query("n19_pool_ceiling", f"""WITH {_CAND400}, {TRUTH}, b AS (SELECT query_id, w, min(pos) + 1 AS rank FROM cand JOIN tr USING (query_id), {_RADII} WHERE video_id = truth AND abs(frame_idx - (lo + hi) // 2) <= w GROUP BY ALL)
SELECT CAST(w AS BIGINT) AS w, count(*) AS found, count(*) FILTER (rank <= 20) AS first20, count(*) FILTER (rank <= 50) AS first50, count(*) FILTER (rank <= 100) AS first100, quantile_cont(rank, 0.5) AS median_rank FROM b GROUP BY w""")
def pool_ceiling(spark, d):
    """What no allocation of 400 candidates can exceed: queries with a candidate of the true video within w frames, and its place."""
    x = _anchored(candidates(spark, d, 400).withColumnRenamed("frame_idx", "frame"), truth(spark, d)).where("off is not null")
    x = x.withColumn("w", F.explode(F.array(*map(F.lit, (20, 60, 120, 240))))).where(F.col("off") <= F.col("w"))
    b = x.groupBy("query_id", "w").agg((F.min("pos") + 1).alias("rank"))
    within = lambda k: F.count_if(F.col("rank") <= k)
    return b.groupBy("w").agg(F.count("*").alias("found"), within(20).alias("first20"), within(50).alias("first50"), within(100).alias("first100"), F.percentile("rank", 0.5).alias("median_rank"))


@query("n19_failures_by_radius", f"""WITH {_CAND400}, {HYBRID}, {TRUTH}, an AS (SELECT query_id, min(CASE WHEN video_id = truth THEN abs(frame - (lo + hi) // 2) END) AS row_off FROM hr JOIN tr USING (query_id) WHERE rank <= 100 GROUP BY query_id),
cn AS (SELECT query_id, min(CASE WHEN video_id = truth THEN abs(frame_idx - (lo + hi) // 2) END) AS cand_off FROM cand JOIN tr USING (query_id) GROUP BY query_id),
cl AS (SELECT w, CASE WHEN row_off <= w THEN 'hit' WHEN cand_off IS NULL OR cand_off > w THEN 'no near candidate' WHEN row_off IS NULL THEN 'wrong video' ELSE 'placement' END AS failure, row_off FROM an JOIN cn USING (query_id), {_RADII})
SELECT CAST(w AS BIGINT) AS w, failure, count(*) AS queries, quantile_cont(row_off, 0.5) AS median_off FROM cl GROUP BY ALL""")
def failures_by_radius(spark, d):
    """Where a query's rows miss: a row is near, no candidate is, no row has the true video, or rows of it lie elsewhere."""
    c, t = candidates(spark, d, 400), truth(spark, d)
    rows = _anchored(allocate.hybrid_rows(c), t).groupBy("query_id").agg(F.min("off").alias("row_off"))
    near = _anchored(c.withColumnRenamed("frame_idx", "frame"), t).groupBy("query_id").agg(F.min("off").alias("cand_off"))
    x = rows.join(near, "query_id").withColumn("w", F.explode(F.array(*map(F.lit, (20, 60, 120, 240)))))
    kind = F.when(F.col("row_off") <= F.col("w"), "hit").when(F.col("cand_off").isNull() | (F.col("cand_off") > F.col("w")), "no near candidate").when(F.col("row_off").isNull(), "wrong video").otherwise("placement")
    return x.groupBy("w", kind.alias("failure")).agg(F.count("*").alias("queries"), F.percentile("row_off", 0.5).alias("median_off"))


@query("n23_saturation_table", f"""WITH {_CAND400}, {TRUTH}, o AS (SELECT query_id, abs(frame_idx - (lo + hi) // 2) AS off, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM cand JOIN tr USING (query_id) WHERE video_id = truth),
q AS (SELECT query_id, max(CASE WHEN r = 1 THEN off END) AS off, arg_min(r, off * 1000 + r) AS rank, count(*) AS pool FROM o GROUP BY query_id)
SELECT count(*) AS queries, round(quantile_cont(pool, 0.5), 6) AS median_pool, count(*) FILTER (off <= 6) AS within6, count(*) FILTER (off <= 10) AS within10, count(*) FILTER (off <= 20) AS within20, round(quantile_cont(off, 0.5), 6) AS off_median, round(quantile_cont(off, 0.75), 6) AS off_p75, round(quantile_cont(off, 0.9), 6) AS off_p90,
round(quantile_cont(rank, 0.5), 6) AS rank_median, count(*) FILTER (rank <= 3) AS first3, count(*) FILTER (rank <= 10) AS first10 FROM q""")
def saturation_table(spark, d):
    """In the true video: how far its best candidate lies from the answer, and the rank of the candidate nearest to the answer."""
    x = _anchored(candidates(spark, d, 400).withColumnRenamed("frame_idx", "frame"), truth(spark, d)).where("off is not null")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    q = x.groupBy("query_id").agg(F.max(F.when(F.col("r") == 1, F.col("off"))).alias("off"), F.min_by("r", F.struct("off", "r")).alias("rank"), F.count("*").alias("pool"))
    mid = lambda x, p=0.5: F.round(F.percentile(x, p), 6)
    return q.agg(
        F.count("*").alias("queries"), mid("pool").alias("median_pool"), *[F.count_if(F.col("off") <= w).alias(f"within{w}") for w in (6, 10, 20)], mid("off").alias("off_median"), mid("off", 0.75).alias("off_p75"),
        mid("off", 0.9).alias("off_p90"), mid("rank").alias("rank_median"), F.count_if(F.col("rank") <= 3).alias("first3"), F.count_if(F.col("rank") <= 10).alias("first10"),
    )


#: A grid of allocations: flat candidates and depth costs.
_FLATS, _DEPTHS = (0, 15, 30, 60), (0.25, 0.5, 1.0)
_COMBOS = ", ".join(f"({i * 8 + j}, {f}, CAST({c} AS DOUBLE))" for i, c in enumerate(_DEPTHS) for j, f in enumerate(_FLATS))
_COST = "(CASE " + " ".join(f"WHEN query_id % 64 // 8 = {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(_DEPTHS)) + " END)"


@query("n15_marginals", f"""WITH {CAND}, {TRUTH}, gd AS (SELECT * FROM (VALUES {_COMBOS}) AS t(no, flat, cost)), gc AS (SELECT query_id * 64 + no AS query_id, pos, video_id, frame_idx, score, last_frame, flat FROM cand, gd), {_hybrid("flat", p="g_", cand="gc").replace("CAST(0.5 AS DOUBLE)", _COST)},
sc AS (SELECT h.query_id // 64 AS query_id, h.query_id % 64 AS no, rank, CASE WHEN video_id = truth AND frame BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END AS r FROM g_hr h JOIN tr ON h.query_id // 64 = tr.query_id WHERE rank <= 100),
fs AS (SELECT query_id, no, round((coalesce(max(r) FILTER (rank <= 1), 0) + coalesce(max(r) FILTER (rank <= 5), 0) + coalesce(max(r) FILTER (rank <= 20), 0) + coalesce(max(r) FILTER (rank <= 50), 0) + coalesce(max(r) FILTER (rank <= 100), 0)) / 5, 6) AS s FROM sc GROUP BY ALL),
cs AS (SELECT flat, cost, round(avg(s), 6) AS s FROM fs JOIN gd USING (no) GROUP BY ALL)
SELECT parameter, value, count(*) AS combinations, round(avg(s), 6) AS mean, max(s) AS best FROM (SELECT 'flat' AS parameter, CAST(flat AS DOUBLE) AS value, s FROM cs UNION ALL SELECT 'depth cost', cost, s FROM cs) GROUP BY ALL""")
def marginals(spark, d):
    """A sweep of allocations scored by query, and for each value of a parameter the mean and the best over all combinations that have it."""
    c = candidates(spark, d)
    rows = []
    for i, cost in enumerate(_DEPTHS):
        flats = F.explode(F.array(*[F.struct(F.lit(i * 8 + j).alias("no"), F.lit(f).alias("flat")) for j, f in enumerate(_FLATS)])).alias("g")
        x = c.select("*", flats).select((F.col("query_id") * 64 + F.col("g.no")).alias("query_id"), "pos", "video_id", "frame_idx", "score", "last_frame", "g.flat")
        rows.append(allocate.hybrid_rows(x, flat=F.col("flat"), depth=cost))
    rows = joins.gathered(rows, ["query_id"])
    no = F.pmod("query_id", F.lit(64)).cast("int")
    s = rows.select(no.alias("no"), F.floor(F.col("query_id") / 64).alias("query_id"), "rank", "video_id", "frame")
    s = evaluate.final_score(scored(spark, d, s), ["query_id", "no"], "r", "rank").groupBy("no").agg(F.round(F.avg("final_score"), 6).alias("s"))
    of = lambda name, values, place: F.struct(F.lit(name).alias("parameter"), F.element_at(F.array(*map(F.lit, values)), place + 1).cast("double").alias("value"))
    each = F.explode(F.array(of("flat", _FLATS, F.col("no") % 8), of("depth cost", _DEPTHS, F.floor(F.col("no") / 8).cast("int")))).alias("x")
    return s.select("s", each).groupBy("x.parameter", "x.value").agg(F.count("*").alias("combinations"), F.round(F.avg("s"), 6).alias("mean"), F.max("s").alias("best"))


_TOP, _HI = "least(greatest(frame_idx, lo), greatest(lo + 1, hi) - 1)", "greatest(lo + 1, hi)"
_IN = f"least(greatest(CAST(trunc({{}}) AS BIGINT), lo), {_HI} - 1)"


@query("n5_draw_kinds", f"""WITH {_CELL}, cf AS (SELECT ce.*, frame_idx FROM ce JOIN k USING (gid)), du AS (SELECT *, {_DRAW.format(seed=7, key="gid || chr(58) || draw")} AS u, {_DRAW.format(seed=8, key="gid || chr(58) || draw")} AS v FROM cf, (SELECT unnest(range(1, 5)) AS draw)),
dt AS (SELECT *, {_TOP} AS top, {_HI} AS h FROM du) SELECT gid, draw, CAST(lo + floor(u * (h - lo)) AS BIGINT) AS uniform, {_IN.format("CASE WHEN u * (h - lo) < top - lo THEN lo + sqrt(u * (h - lo) * (top - lo)) ELSE h - sqrt((1 - u) * (h - lo) * (h - top)) END")} AS triangular,
{_IN.format("frame_idx + 12 * (sqrt(-2 * ln(greatest(u, 1e-12::DOUBLE))) * cos(2 * pi() * v))")} AS normal, CAST(top + floor(u * (h - top)) AS BIGINT) AS after FROM dt""")
def draw_kinds(spark, d):
    """Four draws of a moment in every item's cell, by each assumption of where in it the moment lies."""
    k = keyframes(spark, d)
    c = evaluate.moment_cells(k).select("gid", "lo", "hi").join(k.select("gid", "frame_idx"), "gid").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4))))
    kinds = evaluate.drawn_frames(F.col("lo"), F.col("hi"), F.col("frame_idx"), evaluate.draw(7, "gid", "draw"), evaluate.draw(8, "gid", "draw"))
    return c.select("gid", "draw", *[x.cast("long").alias(n) for n, x in kinds.items()])


@query("d18_profile_blend", f"""{ORACLE["d12_profiles"].rpartition("SELECT query_id")[0]}, pf AS (SELECT query_id, video_id, round(list_inner_product(p, qv) / greatest(sqrt(list_inner_product(p, p)), 1e-6), 6) AS profile FROM p, qv),
di AS (SELECT query_id, video_id, max(round(list_inner_product(v, qv), 6)) AS direct FROM k, qv GROUP BY ALL), la AS (SELECT vec_id // 50 AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS right_video FROM embeddings WHERE vec_id % 50 = 0),
bl AS (SELECT query_id, video_id, c.channel, round(a * direct + b * profile, 6) AS s FROM di JOIN pf USING (query_id, video_id), (VALUES ('direct', 1, 0::DOUBLE), ('direct + 0.25 profile', 1, 0.25::DOUBLE), ('direct + 0.5 profile', 1, 0.5::DOUBLE), ('direct + profile', 1, 1::DOUBLE), ('profile', 0, 1::DOUBLE)) AS c(channel, a, b)),
ow AS (SELECT bl.* FROM bl JOIN la ON bl.query_id = la.query_id AND video_id = right_video), rk AS (SELECT ow.query_id, channel, 1 + count(*) FILTER (bl.s > ow.s) AS rank FROM ow JOIN bl USING (query_id, channel) GROUP BY ALL)
SELECT channel, count(*) AS queries, count(*) FILTER (rank = 1) AS first, count(*) FILTER (rank <= 5) AS top5 FROM rk GROUP BY channel""")
def profile_blend(spark, d):
    """How often the right video is first, and among five, by its best item, by its profile, and by both."""
    direct = scores(spark, d).groupBy("query_id", "video_id").agg(F.max("score").alias("direct"))
    x = direct.join(scan_queries.profiles(spark, d).withColumnRenamed("score", "profile"), ["query_id", "video_id"])
    right = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), F.format_string("V%03d", "label").alias("right_video"))
    kinds = (("direct", 1.0, 0.0), ("direct + 0.25 profile", 1.0, 0.25), ("direct + 0.5 profile", 1.0, 0.5), ("direct + profile", 1.0, 1.0), ("profile", 0.0, 1.0))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.round(a * F.col("direct") + b * F.col("profile"), 6).alias("s")) for n, a, b in kinds])).alias("x")
    s = x.join(right, "query_id").select("query_id", "video_id", "right_video", each).select("query_id", "video_id", "right_video", "x.*")
    own = F.max(F.when(F.col("video_id") == F.col("right_video"), F.col("s"))).over(Window.partitionBy("query_id", "channel"))
    r = s.withColumn("own", own).where("own is not null").groupBy("query_id", "channel").agg((F.count_if(F.col("s") > F.col("own")) + 1).alias("rank"))
    return r.groupBy("channel").agg(F.count("*").alias("queries"), F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("rank") <= 5).alias("top5"))


_JITTER = _DRAW.format(seed=31, key="query_id || chr(58) || gid")


@query("n26_rerun_flips", f"""WITH {S}, {TRUTH}, t1 AS (SELECT query_id, video_id, frame_idx FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) = 1), sj AS (SELECT query_id, gid, video_id, frame_idx, round(score + 0.5::DOUBLE * ({_JITTER} - 0.5::DOUBLE), 6) AS score FROM s),
t2 AS (SELECT query_id, video_id, frame_idx FROM sj QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) = 1), x AS (SELECT query_id, t1.video_id = truth AND abs(t1.frame_idx - (lo + hi) // 2) <= 1100 AS a, t2.video_id = truth AND abs(t2.frame_idx - (lo + hi) // 2) <= 1100 AS b FROM t1 JOIN t2 USING (query_id) JOIN tr USING (query_id)),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY {_DRAW.format(seed=17, key="query_id")}, query_id) <= 20) SELECT count(*) FILTER (a) AS sampled_right, count(*) FILTER (NOT a) AS sampled_wrong, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (NOT a AND b) AS won FROM y""")
def rerun_flips(spark, d):
    """How many of 20 right and 20 wrong first items (in the true video, within 1,100 frames) turn when the same search is run with its scores shaken by up
    to a quarter."""
    shaken = F.round(F.col("score") + 0.5 * (evaluate.draw(31, "query_id", "gid") - 0.5), 6)
    runs = vector.top_shaken(keyframes(spark, d), query_vectors(spark, d), "v", "qv", shaken, 0.25)

    def right(best):
        top = best.join(keyframes(spark, d).select("gid", "video_id", F.col("frame_idx").alias("frame")), "gid").select("query_id", "video_id", "frame")
        return _anchored(top, truth(spark, d)).select("query_id", F.coalesce(F.col("off") <= 1100, F.lit(False)).alias("right"))

    return evaluate.rerun_flips(*map(right, runs), "query_id", 20, 17)


@query("k8_chain_rerank", f"""WITH {_FR.partition("tp AS")[0]}ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS r FROM bs QUALIFY r <= 5), ch AS (SELECT ct.query_id, ct.video_id, r, i - 1 AS event_idx, k.n FROM (SELECT *, unnest(gids) AS g, generate_subscripts(gids, 1) AS i FROM ct) ct JOIN k ON k.gid = g),
ve AS (SELECT user_id % greatest({N_QUERIES} // 4, 1) AS query_id, event_id // 7 % 4 AS event_idx, k.video_id, k.n, max(value) / 100 AS conf FROM events JOIN k ON k.gid = event_id % {N_ITEMS} WHERE event_type = 'signup' GROUP BY ALL),
b AS (SELECT ch.query_id, ch.video_id, r, ch.event_idx, ch.n AS own, max({{'c': coalesce(conf, 0), 'm': -ve.n}}) AS b FROM ch LEFT JOIN ve ON ch.query_id = ve.query_id AND ch.event_idx = ve.event_idx AND ch.video_id = ve.video_id AND ve.n BETWEEN ch.n - 3 AND ch.n + 3 GROUP BY ALL),
p AS (SELECT query_id, video_id, r, round(avg(b.c), 6) AS verdict, list(own ORDER BY event_idx) AS own, list(coalesce(-b.m, own) ORDER BY event_idx) AS picks FROM b GROUP BY ALL), q AS (SELECT *, picks[1] < picks[2] AND picks[2] < picks[3] AND picks[3] < picks[4] AS accepted FROM p)
SELECT query_id, video_id, r AS rnk, verdict, accepted, CASE WHEN accepted THEN picks ELSE own END AS items, row_number() OVER (PARTITION BY query_id ORDER BY verdict DESC, r) AS new_rank FROM q""")
def chain_rerank(spark, d):
    """The five best alignments of every query by the verdicts near their items; a better item is taken over if the chain still rises."""
    best = align.best_videos(align.chain(events(spark, d), EVENTS, 0.01, 2), 5).select("query_id", "video_id", "rnk", F.posexplode("gids").alias("event_idx", "gid"))
    k = keyframes(spark, d).select("gid", F.col("video_id").alias("v"), "n")
    chains = best.join(k, "gid").select("query_id", "video_id", "rnk", "event_idx", "n")
    e = dealt(table(spark, d, "events"), spark, d).where("event_type = 'signup'").select((F.col("user_id") % F.greatest(F.floor(F.col("_queries") / EVENTS), F.lit(1))).alias("query_id"), (F.floor(F.col("event_id") / 7) % EVENTS).alias("event_idx"), (F.col("event_id") % F.col("_items")).alias("gid"), "value")
    verdicts = e.join(k, "gid").groupBy("query_id", "event_idx", F.col("v").alias("video_id"), "n").agg((F.max("value") / 100).alias("conf"))
    return fusion.rerank_chains(chains, verdicts)
