"""Queries of sources, filters and vectors (A, C, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.operators import topk, vector
from keymoment.operators.joins import priority_rows

from . import corpus
from .corpus import QV, H, K, S, hits, keyframes, query_vectors, scores, table
from .registry import query


@query("a3_unit_vectors", "SELECT vec_id, round(list_inner_product(e, e), 5) AS length, round(e[1] / l, 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0 THEN 1 ELSE sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) END AS l FROM embeddings)")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(vector.dot(F.col("e"), F.col("e")), 5).alias("length"), F.round(vector.unit(F.col("e"))[0], 6).alias("first"))


@query("a4_keyframe_table", f"WITH {K} SELECT gid, video_id, n, frame_idx, pts_time FROM k")
def keyframe_table(spark, d):
    return keyframes(spark, d).select("gid", "video_id", "n", "frame_idx", "pts_time")


@query("a5_bundle_check", f"""WITH {K}, r AS (SELECT *, row_number() OVER (ORDER BY video_id, n) - 1 AS g FROM k)
SELECT video_id, min(g) AS s, max(g) AS e, count(*) AS items, max(g) - min(g) + 1 = count(*) AS contiguous FROM r GROUP BY video_id""")
def bundle_check(spark, d):
    from keymoment.sources.items import remap, ranges

    return ranges(remap(keyframes(spark, d)))


@query("a6_index_join", "SELECT o_orderkey, row_no, l_partkey FROM (SELECT l_orderkey AS o_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS row_no FROM lineitem) JOIN (SELECT o_orderkey FROM orders) USING (o_orderkey) WHERE row_no <= 3")
def index_join(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.row_number().over(w).alias("row_no")).where("row_no <= 3")
    return rows.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "row_no", "l_partkey")


@query("a9_first_source_wins", "SELECT CAST(c_nationkey AS BIGINT) AS video, arg_min(c_custkey, (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) * 1000000000 + c_custkey) AS kept FROM customer GROUP BY 1")
def first_source_wins(spark, d):
    c = table(spark, d, "customer").withColumn("source", F.when(F.col("c_acctbal") < 0, 1).otherwise(0))
    return priority_rows(c, ["c_nationkey"], [F.asc("source"), F.asc("c_custkey")]).select(F.col("c_nationkey").alias("video"), F.col("c_custkey").alias("kept"))


_DET = "d AS (SELECT event_id, user_id AS video, (event_id // 4) AS frame, event_type AS cls, round(value / 100, 4) AS conf FROM events)"


def detections(spark, d):
    """event_id, video, frame, cls, conf: events seen as detections in frames."""
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("video"), F.floor(F.col("event_id") / 4).alias("frame"), F.col("event_type").alias("cls"), F.round(F.col("value") / 100, 4).alias("conf"))


@query("a11_detection_lookup", f"WITH {_DET}, {K} SELECT gid, coalesce(c, 0) AS found FROM k LEFT JOIN (SELECT frame, count(*) AS c FROM d GROUP BY frame) ON gid = frame")
def detection_lookup(spark, d):
    c = detections(spark, d).groupBy(F.col("frame").alias("gid")).agg(F.count("*").alias("c"))
    return keyframes(spark, d).join(c, "gid", "left").select("gid", F.coalesce("c", F.lit(0)).alias("found"))


@query("a12_detection_index", f"WITH {_DET}, m AS (SELECT cls, frame, round(max(conf), 2) AS conf FROM d WHERE conf >= 0.35 AND length(cls) >= 2 GROUP BY ALL) SELECT cls, count(*) AS frames, list(frame ORDER BY conf DESC, frame)[1:5] AS first_frames FROM m GROUP BY cls")
def detection_index(spark, d):
    from keymoment.sources.items import detection_postings

    p = detection_postings(detections(spark, d).withColumnRenamed("frame", "gid"), 0.35)
    w = Window.partitionBy("cls").orderBy(F.desc("conf"), "gid")
    top = p.withColumn("r", F.row_number().over(w))
    return top.groupBy("cls").agg(F.count("*").alias("frames"), F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "gid")))), lambda x: x["gid"]).alias("first_frames"))


@query("a15_sidecar_override", "SELECT item_id, CASE WHEN trim(coalesce(side, '')) = '' THEN text ELSE trim(side) END AS prompt FROM (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN ' ' WHEN item_id % 3 = 1 THEN ' en ' || item_id END AS side FROM benchmark)")
def sidecar_override(spark, d):
    b = table(spark, d, "benchmark")
    side = b.where("item_id % 3 < 2").select("item_id", F.when(F.col("item_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" en "), F.col("item_id").cast("string"))).alias("side"))
    return b.join(side, "item_id", "left").select("item_id", F.coalesce(F.nullif(F.trim("side"), F.lit("")), "text").alias("prompt"))


@query("a16_query_files", "SELECT url FROM pages WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, '[.](en|vi)[.]txt$') AND NOT regexp_matches(url, '/fr/')")
def query_files(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").where(u.rlike("^https://") & ~u.rlike("[.](en|vi)[.]txt$") & ~u.rlike("/fr/")).select("url")


@query("a20_frame_window", f"WITH {K}, o AS (SELECT unnest(range(-2, 3)) AS o), l AS (SELECT *, max(frame_idx) OVER (PARTITION BY video_id) AS last FROM k) SELECT gid, o, frame_idx + o * 10 AS frame FROM l, o WHERE frame_idx + o * 10 BETWEEN 0 AND last")
def frame_window(spark, d):
    k = keyframes(spark, d).withColumn("last", F.max("frame_idx").over(Window.partitionBy("video_id"))).withColumn("o", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    return k.withColumn("frame", F.col("frame_idx") + F.col("o") * 10).where("frame >= 0 and frame <= last").select("gid", "o", "frame")


@query("a21_picks", "SELECT c_custkey AS id, split_part(p, '=', 1) AS query, split_part(split_part(p, '=', 2), ':', 1) AS video, CAST(split_part(split_part(p, '=', 2), ':', 2) AS BIGINT) AS frame FROM (SELECT c_custkey, unnest(string_split(regexp_replace('q' || c_custkey || '=V' || c_nationkey || ':' || c_custkey * 3 || ';q' || c_custkey || 'b=V1:7 # note; x=1', '#.*$', ''), ';')) AS p FROM customer)")
def picks(spark, d):
    from keymoment.sources.items import parse_picks

    c = table(spark, d, "customer")
    line = F.concat(F.lit("q"), F.col("c_custkey"), F.lit("=V"), F.col("c_nationkey"), F.lit(":"), F.col("c_custkey") * 3, F.lit(";q"), F.col("c_custkey"), F.lit("b=V1:7 # note; x=1"))
    return parse_picks(c.select(F.col("c_custkey").alias("id"), line.alias("line"))).select("id", "query", "video", F.col("frames")[0].alias("frame"))


@query("a23_secrets", """WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]{20,}')) AS token FROM documents),
ch AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT doc_id, token FROM c)),
f AS (SELECT doc_id, token, ch, count(*) AS n, CAST(length(token) AS DOUBLE) AS l FROM ch GROUP BY ALL)
SELECT doc_id, token, round(-sum(n / l * log2(n / l)), 6) AS entropy FROM f GROUP BY doc_id, token HAVING round(-sum(n / l * log2(n / l)), 6) >= 3.5""")
def secrets(spark, d):
    from keymoment.functions.text import entropy

    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]{20,}"), F.lit(0))).alias("token")).distinct()
    return t.withColumn("entropy", F.round(entropy(F.col("token")), 6)).where("entropy >= 3.5")


# --- filters


@query("c1_opening_mask", f"WITH {K} SELECT gid FROM k WHERE n > 2")
def opening_mask(spark, d):
    return keyframes(spark, d).where("n > 2").select("gid")


@query("c2_blank_items", f"WITH {K} SELECT gid FROM k WHERE gid NOT IN (SELECT o_orderkey * 3 FROM orders)")
def blank_items(spark, d):
    blank = table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("gid"))
    return keyframes(spark, d).join(blank, "gid", "left_anti").select("gid")


@query("c3_one_video", f"WITH {H} SELECT query_id, gid, score FROM s WHERE video_id = 'V003' AND n > 2")
def one_video(spark, d):
    return scores(spark, d).where("video_id = 'V003' and n > 2").select("query_id", "gid", "score")


@query("c4_allowed_documents", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowed_documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("c5_prefixes", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'src7')")
def prefixes(spark, d):
    from keymoment.functions.text import any_prefix

    return table(spark, d, "documents").where(any_prefix(F.col("source"), "src1, src7")).select("doc_id", "source")


@query("c6_confidence", f"WITH {_DET} SELECT event_id, conf >= 0.35 AS ocr, conf > 0.4 AS detection, conf >= 0.25 AS answer, conf >= 0.3 AS subject FROM d WHERE conf >= 0.12")
def confidence(spark, d):
    c = F.col("conf")
    return detections(spark, d).where(c >= 0.12).select("event_id", (c >= 0.35).alias("ocr"), (c > 0.4).alias("detection"), (c >= 0.25).alias("answer"), (c >= 0.3).alias("subject"))


@query("c7_dull_classes", f"WITH {_DET} SELECT event_id, cls FROM d WHERE cls NOT IN ('view', 'click')")
def dull_classes(spark, d):
    return detections(spark, d).where(~F.col("cls").isin("view", "click")).select("event_id", "cls")


@query("c8_masked_after_fusion", f"WITH {S} SELECT query_id, gid, CASE WHEN n > 2 THEN z ELSE -1e9 END AS z FROM (SELECT *, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6), 5) AS z FROM s WINDOW w AS (PARTITION BY query_id))")
def masked_after_fusion(spark, d):
    from keymoment.operators.fusion import row_zscore

    return row_zscore(scores(spark, d), ["query_id"], "score", "z", 5).select("query_id", "gid", F.when(F.col("n") > 2, F.col("z")).otherwise(-1e9).alias("z"))


@query("c10_image_gates", "SELECT vec_id, round(sd, 6) AS sd, sd >= 0.12 AS kept FROM (SELECT vec_id, list_stddev_pop(CAST(embedding AS DOUBLE[])) AS sd FROM embeddings)")
def image_gates(spark, d):
    from keymoment.functions.arrays import deviation

    e = table(spark, d, "embeddings").select("vec_id", deviation(F.col("embedding").cast("array<double>")).alias("sd"))
    return e.select("vec_id", F.round("sd", 6).alias("sd"), (F.col("sd") >= 0.12).alias("kept"))


@query("c11_uncertain", f"""WITH {H}, t AS (SELECT query_id, max(score) AS s1, stddev_pop(score) AS sd FROM h GROUP BY query_id),
f AS (SELECT query_id, arg_max(video_id, -rnk) AS v FROM h GROUP BY query_id),
o AS (SELECT h.query_id, max(score) AS s2 FROM h JOIN f ON h.query_id = f.query_id AND h.video_id <> f.v GROUP BY h.query_id)
SELECT query_id, round((s1 - s2) / (sd + 1e-6), 5) AS margin, round((s1 - s2) / greatest(abs(s1), 1e-6), 5) AS relative,
 round((s1 - s2) / (sd + 1e-6), 5) <= 0.8 OR round((s1 - s2) / greatest(abs(s1), 1e-6), 5) <= 0.02 AS uncertain FROM t JOIN o USING (query_id)""")
def uncertain(spark, d):
    from keymoment.operators.fusion import margin

    return margin(hits(spark, d)).withColumn("uncertain", (F.col("margin") <= 0.8) | (F.col("relative") <= 0.02))


@query("c12_two_scenes", "SELECT item_id, position('. ' IN text) > 0 AND length(trim(substr(text, position('. ' IN text) + 2))) > 0 AS two_scenes FROM benchmark")
def two_scenes(spark, d):
    at = F.instr("text", ". ")
    return table(spark, d, "benchmark").select("item_id", ((at > 0) & (F.length(F.trim(F.expr("substr(text, instr(text, '. ') + 2)"))) > 0)).alias("two_scenes"))


@query("c13_trust_tiers", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'trusted' ELSE 'check' END AS tier FROM labels WHERE NOT (quality = 0 AND toxic = 1)")
def trust_tiers(spark, d):
    t = table(spark, d, "labels").where(~((F.col("quality") == 0) & (F.col("toxic") == 1)))
    return t.select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "trusted").otherwise("check").alias("tier"))


# --- vectors


@query("d1_similarities", f"WITH {S} SELECT gid, score FROM s WHERE query_id = 3")
def one_query(spark, d):
    return vector.similarities(keyframes(spark, d), query_vectors(spark, d).where("query_id = 3"), "v", "qv").select("gid", "score")


@query("d2_visual_scores", f"WITH {S} SELECT query_id, gid, score FROM s")
def visual_scores(spark, d):
    return scores(spark, d).select("query_id", "gid", "score")


@query("d3_prompt_ensemble", f"WITH {QV} SELECT query_id, round(qv[1], 6) AS first, round(qv[64], 6) AS last, round(list_inner_product(qv, qv), 6) AS length FROM qv")
def prompt_ensemble(spark, d):
    q = F.col("qv")
    return query_vectors(spark, d).select("query_id", F.round(q[0], 6).alias("first"), F.round(q[63], 6).alias("last"), F.round(vector.dot(q, q), 6).alias("length"))


@query("d4_two_prompts", "SELECT a.vec_id // 50 AS query_id, round(0.8 * list_inner_product(x, x) + 0.2 * list_inner_product(x, y), 6) AS blend FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 50 = 0) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id % 50 = 1) b ON b.vec_id = a.vec_id + 1")
def two_prompts(spark, d):
    p = corpus.prompts(spark, d)
    x = p.where("prompt_no = 0").select("query_id", F.col("v").alias("x"))
    y = p.where("prompt_no = 1").select("query_id", F.col("v").alias("y"))
    b = F.transform(F.arrays_zip("x", "y"), lambda z: 0.8 * z["x"] + 0.2 * z["y"])
    return x.join(y, "query_id").select("query_id", F.round(vector.dot(b, F.col("x")), 6).alias("blend"))


for _how, _f in (("mean", "avg"), ("max", "max")):

    @query(f"d5_chunks_{_how}", f"WITH {S} SELECT query_id // 4 AS query_id, gid, round({_f}(score), 8) AS score FROM s GROUP BY ALL")
    def chunks(spark, d, how=_how):
        return vector.combine_chunks(scores(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 4)), ["query_id", "gid"], how)


@query("d6_exemplars", f"""WITH {QV}, i AS (SELECT vec_id // 50 AS query_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 50 < 4),
m AS (SELECT query_id, list(x ORDER BY i) AS m FROM (SELECT query_id, i, avg(x) AS x FROM i GROUP BY ALL) GROUP BY query_id),
u AS (SELECT query_id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-6)) AS m FROM m),
b AS (SELECT query_id, list_transform(list_zip(qv, m), lambda p: 0.6 * p[1] + 0.4 * p[2]) AS b FROM u JOIN qv USING (query_id))
SELECT query_id, round(b[1] / greatest(sqrt(list_inner_product(b, b)), 1e-6), 6) AS first, round(list_inner_product(b, b), 6) AS raw FROM b""")
def exemplars(spark, d):
    p = corpus.prompts(spark, d)
    m = vector.vector_sum(p, ["query_id"], "v", F.lit(0.25), "m").withColumn("m", vector.unit(F.col("m"), 1e-6))
    b = query_vectors(spark, d).join(m, "query_id").withColumn("b", F.zip_with("qv", "m", lambda x, y: 0.6 * x + 0.4 * y))
    return b.select("query_id", F.round(vector.unit(F.col("b"), 1e-6)[0], 6).alias("first"), F.round(vector.dot(F.col("b"), F.col("b")), 6).alias("raw"))


@query("d7_late_interaction", f"""WITH {K}, t AS (SELECT vec_id // 50 AS query_id, vec_id AS token, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 < 4),
p AS (SELECT query_id, token, video_id, max(round(list_inner_product(v, q), 8)) AS m FROM t, k GROUP BY ALL) SELECT query_id, video_id, round(avg(m), 6) AS score FROM p GROUP BY ALL""")
def late_interaction(spark, d):
    """Tokens of a query are its prompts, patches of a video its items, all of them."""
    t = corpus.prompts(spark, d).select("query_id", (F.col("query_id") * corpus.EVERY + F.col("prompt_no")).alias("token"), F.col("v").alias("q"))
    pairs = vector.similarities(keyframes(spark, d), t, "v", "q", digits=8)
    return vector.max_sim(pairs, ["query_id", "video_id"], "token", F.col("score"))


@query("d9_cut_scores", f"""WITH {K}, c AS (SELECT gid, video_id, n, coalesce(1 - list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))), 0) AS cut FROM (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY n) AS p FROM k))
SELECT gid, round(cut, 6) AS cut, round((row_number() OVER (PARTITION BY video_id ORDER BY round(cut, 6), n) - 1) / greatest(count(*) OVER (PARTITION BY video_id) - 1, 1), 6) AS percentile FROM c""")
def cut_scores(spark, d):
    c = vector.adjacent_cosine(keyframes(spark, d), "video_id", "n", "v").withColumn("cut", F.round(F.coalesce(1 - F.col("cosine"), F.lit(0.0)), 6))
    w = Window.partitionBy("video_id")
    place = F.row_number().over(w.orderBy("cut", "n")) - 1
    return c.select("gid", "cut", F.round(place / F.greatest(F.count("*").over(w) - 1, F.lit(1)), 6).alias("percentile"))


@query("d11_hubness", f"""WITH {S.replace("s AS (", "s AS MATERIALIZED (")}, b AS (SELECT gid, avg(score) AS bias FROM s GROUP BY gid), z AS (SELECT gid, (bias - avg(bias) OVER ()) / (stddev_pop(bias) OVER () + 1e-6) AS z FROM b),
r AS (SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS r FROM s),
n AS (SELECT query_id, gid, r AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(r + 5 * z, 4), r) AS new_rank FROM r JOIN z USING (gid)) SELECT * FROM n WHERE new_rank <= 400""")
def hubness(spark, d):
    from keymoment.operators.fusion import hub_corrected

    return hub_corrected(scores(spark, d), 5.0).select("query_id", "gid", "old_rank", "new_rank")


@query("d10_rocchio", f"""WITH {S.replace("s AS (", "s AS MATERIALIZED (").replace("k AS (", "k AS MATERIALIZED (", 1)}, r AS MATERIALIZED (SELECT query_id, gid, video_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rk FROM s WHERE n > 2),
t AS (SELECT query_id, video_id AS top_video FROM r WHERE rk = 1),
f AS MATERIALIZED (SELECT * FROM (SELECT r.query_id, r.gid, row_number() OVER (PARTITION BY r.query_id ORDER BY rk) AS m FROM r JOIN t ON r.query_id = t.query_id AND r.video_id <> t.top_video) WHERE m <= 5),
c AS (SELECT query_id, i, avg(x) AS x FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM f JOIN k USING (gid)) GROUP BY ALL),
cv AS MATERIALIZED (SELECT query_id, list(x ORDER BY i) AS c FROM c GROUP BY query_id)
SELECT s.query_id, s.gid, round(score + CAST(0.3 AS DOUBLE) * list_inner_product(c, v), 5) AS score FROM s JOIN cv USING (query_id) JOIN k USING (gid)""")
def rocchio(spark, d):
    from keymoment.operators.fusion import rocchio as apply

    return apply(keyframes(spark, d), query_vectors(spark, d), 5, 0.3)


@query("d12_profiles", f"""WITH {K}, {QV}, x AS (SELECT video_id, i, avg(x) AS x FROM (SELECT video_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k) GROUP BY ALL),
p AS (SELECT video_id, list(x ORDER BY i) AS p FROM x GROUP BY video_id)
SELECT query_id, video_id, round(list_inner_product(p, qv) / greatest(sqrt(list_inner_product(p, p)), 1e-6), 6) AS score FROM p, qv""")
def profiles(spark, d):
    k = keyframes(spark, d)
    n = k.groupBy("video_id").agg(F.count("*").alias("n_all"))
    p = vector.vector_sum(k.join(n, "video_id"), ["video_id"], "v", 1 / F.col("n_all"), "p").withColumn("p", vector.unit(F.col("p"), 1e-6))
    return vector.similarities(p.select("video_id", "p"), query_vectors(spark, d), "p", "qv").select("query_id", "video_id", "score")


@query("d13_ensemble_models", f"WITH {S} SELECT query_id, gid, round(0.5 * score + 0.5 / (1 + exp(-least(greatest(10 * score - 5, -50), 50))), 6) AS score FROM s")
def ensemble_models(spark, d):
    from keymoment.functions.arrays import sigmoid

    return scores(spark, d).select("query_id", "gid", F.round(0.5 * F.col("score") + 0.5 * sigmoid(10 * F.col("score") - 5), 6).alias("score"))


@query("d14_norm_check", "SELECT count(*) AS items, round(min(l), 5) AS low, round(max(l), 5) AS high, bool_and(abs(l - 1) <= 0.05) AS normal FROM (SELECT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings)")
def norm_check(spark, d):
    length = vector.norm(F.col("v"))
    return keyframes(spark, d).select(length.alias("l")).agg(F.count("*").alias("items"), F.round(F.min("l"), 5).alias("low"), F.round(F.max("l"), 5).alias("high"), F.bool_and(F.abs(F.col("l") - 1) <= 0.05).alias("normal"))


@query("d15_suppress_similar", f"""WITH {H}, hv AS (SELECT h.query_id, h.gid, h.score, list_transform(v, lambda c: c / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u FROM h JOIN (SELECT gid, v FROM k) k USING (gid) WHERE rnk <= 100),
g AS (SELECT query_id, list(struct_pack(gid := gid, score := score, u := u) ORDER BY score DESC, gid) AS g FROM hv GROUP BY query_id),
f AS (SELECT query_id, list_reduce(g, lambda a, x: CASE WHEN len(a) < 50 AND len(list_filter(a[greatest(len(a) - 199, 1):], lambda y: list_inner_product(y.u, x.u) >= 0.9)) = 0 THEN list_append(a, x) ELSE a END, g[1:0]) AS kept FROM g)
SELECT query_id, u.gid, u.score FROM (SELECT query_id, unnest(kept) AS u FROM f)""")
def suppress_similar(spark, d):
    h = hits(spark, d, 100).join(keyframes(spark, d).select("gid", "v"), "gid")
    return topk.suppress_similar(h, ["query_id"], "v").select("query_id", "gid", "score")


for _lag in (1, 2, 5, 10, 20, 50):

    @query(f"d17_lag_{_lag}", f"""WITH {K}, c AS (SELECT video_id, list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))) AS c FROM (SELECT *, lag(v, {_lag}) OVER (PARTITION BY video_id ORDER BY n) AS p FROM k))
SELECT video_id, count(c) AS pairs, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, count(c) FILTER (round(c, 9) < 0.5) AS low FROM c GROUP BY video_id""")
    def lag_cosine(spark, d, lag=_lag):
        c = vector.adjacent_cosine(keyframes(spark, d), "video_id", "n", "v", lag)
        return c.groupBy("video_id").agg(F.count("cosine").alias("pairs"), F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.percentile("cosine", 0.5), 6).alias("median"), F.count_if(F.round("cosine", 9) < 0.5).alias("low"))


@query("d18_separation", f"""WITH {S}, b AS (SELECT query_id, video_id, max(score) AS s FROM s GROUP BY ALL), l AS (SELECT vec_id // 50 AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS right_video FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT b.query_id, s AS good FROM b JOIN l ON b.query_id = l.query_id AND video_id = right_video), r AS (SELECT b.query_id, s AS bad FROM b JOIN l ON b.query_id = l.query_id AND video_id <> right_video)
SELECT p.query_id, round(avg(CASE WHEN good > bad THEN 1.0::DOUBLE WHEN good = bad THEN 0.5 ELSE 0 END), 6) AS auc, 1 + count(*) FILTER (bad > good) AS rank FROM p JOIN r USING (query_id) GROUP BY p.query_id""")
def separation(spark, d):
    from keymoment.operators.evaluate import separation_auc

    best = scores(spark, d).groupBy("query_id", "video_id").agg(F.max("score").alias("s"))
    right = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), F.format_string("V%03d", "label").alias("right_video"))
    return separation_auc(best, right)
