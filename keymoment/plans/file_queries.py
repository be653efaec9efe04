"""Queries of readers, writers and plugged-in parts: test tables are written as files of each format to the shared folder and read back (A, B, P, Q)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from keymoment import engine
from keymoment.operators import allocate, evaluate, vector
from keymoment.sources import data_sources, items, pictures, sinks
from keymoment.sources.files import shared_folder, write_files
from keymoment.streaming import flows

from .answer_queries import CAND, FINAL, HYBRID, candidates, truth
from .corpus import H, K, N_ITEMS, SKIP, dealt, keyframes, prompts, query_vectors, table
from .registry import query
from .scan_queries import _DET, detections


@query("a1_json_items", f"WITH {K} SELECT video_id, n - 1 AS gid, n, frame_idx, pts_time FROM k")
def json_items(spark, d):
    """A JSON array for each video; an item's place in its array is its gid."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", "video_id", "frame_idx", "pts_time"))), lambda x: x)
    folder = shared_folder(spark, "items")
    write_files(keyframes(spark, d).groupBy("video_id").agg(F.to_json(rows).alias("content")).select(F.concat("video_id", F.lit(".json")).alias("name"), "content"), folder)
    return items.read_items(spark, f"{folder}/*.json").select("video_id", "gid", "n", "frame_idx", "pts_time")


_MATRIX_SQL = f"WITH {K} SELECT video_id || '.npy' AS file, n - 1 AS gid, round(v[1], 6) AS first, round(v[64], 6) AS last FROM k"


def _matrices(spark, d):
    """The folder of a matrix for each video, written here."""
    import io

    import numpy as np

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.array(pdf.sort_values("n")["v"].tolist(), np.float32))
        return pd.DataFrame({"name": [pdf["video_id"].iloc[0] + ".npy"], "content": [out.getvalue()]})

    folder = shared_folder(spark, "matrices")
    write_files(keyframes(spark, d).select("video_id", "n", "v").groupBy("video_id").applyInPandas(save, "name string, content binary"), folder)
    return folder


@query("a2_npy_rows", _MATRIX_SQL)
def npy_rows(spark, d):
    """A matrix for each video, read back in ranges of a few rows."""
    m = items.read_npy(spark, f"{_matrices(spark, d)}/*.npy", 4096)
    return m.select("file", "gid", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[63].cast("double"), 6).alias("last"))


@query("a2_npy_source", f"{_MATRIX_SQL} WHERE n > 11 AND n <= 40")
def npy_source(spark, d):
    """The same matrices by spark.read; the filter reaches the reader, which reads the matching rows' bytes only."""
    data_sources.register(spark)
    m = spark.read.format("npy").option("rows", 16).option("pushdown", True).load(_matrices(spark, d)).where("gid >= 11 and gid < 40")
    return m.select("file", "gid", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("a10_media_info", "SELECT 'N' || n_nationkey AS video_id, n_name AS title, 'Region ' || r_name AS description, [n_name, r_name] AS keywords FROM nation JOIN region ON n_regionkey = r_regionkey")
def media_info(spark, d):
    """Even nations as loose files with keywords as a list, odd ones in ZIPs with keywords as text."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("n_nationkey") % 2 == 0
    x = n.select("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("name"), F.col("n_name").alias("title"), F.concat(F.lit("Region "), "r_name").alias("description"), F.col("r_name").alias("r"))
    loose = x.where(even).select("name", F.to_json(F.struct("title", "description", F.array("title", "r").alias("keywords"))).alias("content"))
    packed = x.where(~even).select(F.col("n_nationkey").alias("pos"), "name", F.to_json(F.struct("title", "description", F.concat_ws(", ", "title", "r").alias("keywords"))).alias("content"))
    folder = shared_folder(spark, "media-info")
    write_files(loose.withColumn("content", F.col("content").cast("binary")).unionByName(sinks.packages(packed, 4)), folder)
    return items.read_media_info(spark, folder).select("video_id", "title", "description", "keywords")


_PICTURE = """CASE WHEN n % 5 = 0 THEN 'cover' || n ELSE lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END || CASE n % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' ELSE '.Jpeg' END"""


def _png(grey) -> bytes:
    """An 8 x 8 picture of greys as PNG."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(int(x) for x in grey[i : i + 8]) for i in range(0, 64, 8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _greys(contents: list[bytes]):
    """The greys of pictures by _png, NaN for other contents: what stands in for an encoder."""
    import zlib

    import numpy as np

    def read(c: bytes):
        if not c.startswith(b"\x89PNG"):
            return np.full(64, np.nan)
        size = int.from_bytes(c[33:37], "big")
        return np.frombuffer(zlib.decompress(c[41 : 41 + size]), np.uint8).reshape(8, 9)[:, 1:].ravel()

    return np.array([read(c) for c in contents], np.float64)


def _picture_folder(spark, d):
    """A folder for each video: an item's first 64 numbers as a picture, every seventh a file that is none, and a note beside them."""

    def draw(batches):
        for x in batches:
            yield pd.DataFrame({"name": x["name"], "content": [b"no picture" if n % 7 == 0 else _png(g) for n, g in zip(x["n"], x["g"], strict=True)]})

    grey = F.transform(F.slice("v", 1, 64), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(128 + 100 * x).cast("int"))))
    stem = F.when(F.col("n") % 5 == 0, F.concat(F.lit("cover"), F.col("n").cast("string"))).otherwise(F.format_string("%04d", "n"))
    end = F.element_at(F.array(F.lit(".png"), F.lit(".PNG"), F.lit(".Jpeg")), (F.col("n") % 3 + 1).cast("int"))
    k = keyframes(spark, d).select("n", "video_id", F.concat("video_id", F.lit("/"), stem, end).alias("name"), grey.alias("g"))
    folder = shared_folder(spark, "pictures")
    notes = k.select(F.concat("video_id", F.lit("/notes.txt")).alias("name"), F.lit("n").cast("binary").alias("content")).distinct()
    write_files(k.select("n", "name", "g").mapInPandas(draw, "name string, content binary").unionByName(notes), folder)
    return folder


@query("a7_picture_scan", f"WITH {K}, p AS (SELECT video_id, {_PICTURE} AS frame_filename, CASE WHEN n % 5 = 0 THEN 0 ELSE n END AS frame_idx FROM k) SELECT video_id, frame_filename, frame_idx, video_id || '/' || frame_filename AS rel_path, row_number() OVER (PARTITION BY video_id ORDER BY frame_filename) AS n FROM p")
def picture_scan(spark, d):
    return pictures.scan_pictures(spark, _picture_folder(spark, d)).select("video_id", "frame_filename", "frame_idx", "rel_path", "n")


@query("a7_picture_vectors", f"""WITH {K}, g AS (SELECT video_id || '/' || {_PICTURE} AS rel_path, n, list_transform(v[1:64], lambda x: least(255, greatest(0, round(128 + 100 * x)))) AS g FROM k), m AS (SELECT *, sqrt(list_inner_product(g, g)) AS norm FROM g)
SELECT rel_path, CASE WHEN n % 7 > 0 THEN round(CAST(CAST(g[1] / norm AS FLOAT) AS DOUBLE), 6) END AS first, CASE WHEN n % 7 > 0 THEN round(CAST(CAST(g[64] / norm AS FLOAT) AS DOUBLE), 6) END AS last FROM m""")
def picture_vectors(spark, d):
    """Pictures read with their contents and encoded, 64 at a time; a file that is no picture has no vector."""
    v = pictures.encode_pictures(pictures.scan_pictures(spark, _picture_folder(spark, d), content=True), _greys)
    return v.select("rel_path", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[63].cast("double"), 6).alias("last"))


_READ = "rd AS (SELECT 'V' || video % 10 AS video_id, frame, cls, conf, event_id FROM d)"


#: A number at three places by its exact binary value, halves to the even digit.
_THREE = "(SELECT (k + CASE WHEN e > 0 THEN 1 WHEN e < 0 THEN 0 ELSE k % 2 END) / 1000 FROM (SELECT k, (hi * 1000 - (k + 0.5::DOUBLE)) + (x - hi) * 1000 AS e FROM (SELECT floor(conf * 1000) AS k, CAST(CAST(conf AS FLOAT) AS DOUBLE) AS hi, conf AS x)))"


@query("a13_text_cache", f"WITH {_DET}, {_READ}, o AS (SELECT video_id, frame, cls || ' 1' AS text, {_THREE} AS confidence FROM rd WHERE event_id % 3 = 0), t AS (SELECT video_id, frame, cls || ' 2' AS text, {_THREE} AS confidence FROM rd WHERE event_id % 3 <> 2 AND (video_id, frame) NOT IN (SELECT video_id, frame FROM o)) SELECT video_id, frame AS frame_idx, text, confidence FROM (SELECT * FROM o UNION ALL SELECT * FROM t) WHERE confidence >= 0.35")
def text_cache(spark, d):
    """A first reading writes caches, a second adds the frames they miss; frames read twice keep the first reading."""
    e = detections(spark, d).withColumn("video_id", F.concat(F.lit("V"), (F.col("video") % 10).cast("string")))
    found = lambda x, no: x.groupBy("video_id", F.col("frame").alias("frame_idx")).agg(F.collect_list(F.struct(F.concat_ws(" ", "cls", F.lit(no)).alias("text"), F.col("conf").alias("confidence"))).alias("found"))
    one, two = shared_folder(spark, "texts"), shared_folder(spark, "texts")
    items.extend_text_cache(found(e.where("event_id % 3 = 0"), "1"), one)
    items.extend_text_cache(found(e.where("event_id % 3 <> 2"), "2"), two, f"{one}/*.json")
    new = items.read_text_cache(spark, f"{two}/*.json")
    kept = items.read_text_cache(spark, f"{one}/*.json").join(new.select("video_id").distinct(), "video_id", "left_anti")  # videos without a new frame aren't written again
    return new.unionByName(kept)


@query("a14_query_files", "SELECT 'q' || item_id || '.txt' AS name, text || ' đã thấy' AS text FROM benchmark")
def query_files(spark, d):
    """Texts in three codecs beside translations that aren't queries."""
    b = table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" đã thấy")).alias("text"))
    code = F.col("item_id") % 3
    mark = F.unhex(F.lit("EFBBBF"))
    content = F.when(code == 0, F.encode("text", "UTF-8")).when(code == 1, F.concat(mark, F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    name = F.concat(F.lit("q"), F.col("item_id").cast("string"))
    folder = shared_folder(spark, "queries")
    files = b.select(F.concat(name, F.lit(".txt")).alias("name"), content.alias("content"))
    write_files(files.unionByName(b.select(F.concat(name, F.lit(".en.txt")).alias("name"), F.encode(F.lit("english"), "UTF-8").alias("content"))), folder)
    return items.read_query_files(spark, folder)


@query("a17_caption_cues", "SELECT 'C' || conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, round(turn * CAST(1234 AS DOUBLE) / 1000, 2) AS start, trim(text) AS text FROM conversations QUALIFY trim(text) <> ''")
def caption_cues(spark, d):
    """Conversations as caption files: two segments an event, and an event without text at the end."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.struct(F.substring(F.col("text"), F.lit(1), half).alias("utf8")), F.struct(F.substring(F.col("text"), half + 1, F.length("text")).alias("utf8")))
    e = F.struct("turn", "role", "text", F.struct((F.col("turn") * 1234).alias("tStartMs"), parts.alias("segs")).alias("e"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(e)), lambda x: x["e"]).alias("events"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("tStartMs"), F.array(F.struct(F.lit("\n").alias("utf8"))).alias("segs")))
    files = c.select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("video_id"), F.to_json(F.struct(F.concat("events", none).alias("events"))).alias("content"))
    return items.caption_cues(files)


def _answer_files(spark, d):
    r = allocate.hybrid_rows(candidates(spark, d))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", sinks.answer_line(F.col("video_id"), F.array("frame")).alias("line")))), lambda x: x["line"])
    return r.groupBy("query_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content")).select(F.col("query_id").alias("pos"), F.concat(F.lit("query-"), F.col("query_id").cast("string"), F.lit(".csv")).alias("name"), "content")


@query("a22_answer_files", f"WITH {CAND}, {HYBRID} SELECT 'query-' || query_id || '.csv' AS file, rank - 1 AS pos, video_id, frame, CASE WHEN query_id % 2 = 0 THEN 'two, words' END AS answer FROM hr WHERE rank <= 100")
def answer_files(spark, d):
    """Answer files with a byte order mark and CRLF; every other one has answers with a comma."""
    f = _answer_files(spark, d)
    text = F.when(F.col("pos") % 2 == 0, F.regexp_replace("content", "\n", ",two, words\n")).otherwise(F.col("content"))
    folder = shared_folder(spark, "answers")
    write_files(f.select("name", F.concat(F.lit("﻿"), F.regexp_replace(text, "\n", "\r\n")).alias("content")), folder)
    return items.read_answers(spark, f"{folder}/*.csv")


@query("b4_packages", f"WITH {CAND}, {HYBRID} SELECT 'query-' || query_id || '.csv' AS file, rank - 1 AS pos, video_id || ',' || frame AS line FROM hr WHERE rank <= 100")
def packages(spark, d):
    """Answer files in ZIPs of four, written, and read back."""
    folder = shared_folder(spark, "packages")
    write_files(sinks.packages(_answer_files(spark, d), 4), folder)
    return sinks.zip_lines(spark.read.format("binaryFile").load(f"{folder}/*.zip"))


@query("b4_zip_source", f"WITH {CAND}, {HYBRID} SELECT 'submission/query-' || query_id || '.csv' AS name, count(*) AS lines, min(video_id || ',' || frame) AS least FROM hr WHERE rank <= 100 GROUP BY query_id")
def zip_source(spark, d):
    """Answer files in one archive a task, committed together, and read back as members."""
    data_sources.register(spark)
    folder = shared_folder(spark, "archives")
    _answer_files(spark, d).select("name", "content").repartition(4, "name").write.format("zip_files").option("prefix", "submission/").mode("append").save(folder)
    lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")
    return spark.read.format("zip_files").load(folder).select("name", F.size(lines).alias("lines"), F.array_min(lines).alias("least"))


@query("p2_cache_upsert", "WITH a AS (SELECT event_id, user_id, 1 AS run FROM events WHERE event_id % 4 < 2), b AS (SELECT event_id, user_id, 2 AS run FROM events WHERE event_id % 4 > 0) SELECT event_id, user_id, CAST(run AS BIGINT) AS run FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE event_id NOT IN (SELECT event_id FROM a))")
def cache_upsert(spark, d):
    """Two runs whose rows overlap: the second adds what the first didn't leave. The second is run twice, as after a lost commit."""
    e = table(spark, d, "events").select("event_id", "user_id")
    folder = shared_folder(spark, "cache")
    sink = flows.batch_sink(folder, ["event_id"])
    first, second = e.where("event_id % 4 < 2").withColumn("run", F.lit(1)), e.where("event_id % 4 > 0").withColumn("run", F.lit(2))
    for no, rows in ((0, first), (1, second), (1, second)):
        sink(rows, no)
    return flows.read_batches(spark, folder)


_LATE = H.replace("vec_id % 50 < 4", "vec_id % 50 < 4 AND NOT (vec_id % 50 = 3 AND vec_id // 50 % 3 = 0)")


@query("p1_query_stream", f"""WITH {_LATE}, pn AS (SELECT query_id, count(DISTINCT w0) AS prompts FROM (SELECT vec_id // 50 AS query_id, vec_id AS w0 FROM embeddings WHERE vec_id % 50 < 4 AND NOT (vec_id % 50 = 3 AND vec_id // 50 % 3 = 0)) GROUP BY ALL)
SELECT query_id, prompts, prompts = 4 AS complete, gid, score, rnk FROM h JOIN pn USING (query_id) WHERE rnk <= 10""")
def query_stream(spark, d):
    """Files of prompts as a stream: a query is searched when its four prompts are there, or without those that haven't come when the round's end passes its
    timer; the last prompt of every third query comes after that and changes nothing. Each of the three arrivals is a run that goes on where the one before ended."""
    p = prompts(spark, d).withColumn("at", F.timestamp_seconds(1704067200 + F.col("prompt_no")))
    late = (F.col("prompt_no") == 3) & (F.col("query_id") % 3 == 0)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit(None).cast("long").alias("prompt_no"), F.lit(None).cast("double").alias("weight"), F.array().cast("array<double>").alias("v"), F.timestamp_seconds(F.lit(1704067200 + 86400)).alias("at"))
    folder, found, checkpoint = (shared_folder(spark, x) for x in ("prompts", "found", "prompt-stream"))
    k = keyframes(spark, d).where(F.col("n") > SKIP).select("gid", "v")

    def search(gathered):
        q = gathered.select("query_id", "prompts", "complete", F.explode("items").alias("x")).select("query_id", "prompts", "complete", "x.weight", "x.v")
        qv = vector.ensemble(q.select("query_id", "weight", "v"), ["query_id"], "v", "weight", "qv")
        return vector.top_similar(k, qv, "v", "qv", 10).join(gathered.select("query_id", "prompts", "complete"), "query_id").select("query_id", "prompts", "complete", "gid", "score", "rnk")

    sink = flows.batch_sink(found, ["query_id"], search)
    for i, rows in enumerate((p.where(~late), end, p.where(late))):
        name = F.concat(F.floor(F.col("query_id") / 16).cast("string"), F.lit(".jsonl")).alias("name")
        line = F.to_json(F.struct("query_id", "prompt_no", "weight", "v", "at"))
        write_files(rows.groupBy(name).agg(F.array_join(F.collect_list(line), "\n").alias("content")), f"{folder}/run-{i}")
        stream = spark.readStream.schema(p.select("query_id", "prompt_no", "weight", "v", "at").schema).option("maxFilesPerTrigger", 16).json(f"{folder}/run-?")
        flows.run_available(flows.gather_prompts(stream, 4, "1 hour"), sink, checkpoint)
    return flows.read_batches(spark, found)


# --- plugged-in parts


def _engine(spark, d, providers=()):
    named = query_vectors(spark, d).select(F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("text"), "qv")
    queries = named.select(F.substring("text", 7, 20).cast("long").alias("query_id"), "text")
    return engine.Engine(keyframes(spark, d), engine.vector_table(named), providers), queries


@query("q1_encoder", f"WITH {H} SELECT query_id, gid, score, rnk FROM h")
def encoder(spark, d):
    e, q = _engine(spark, d)
    return e.search(q).select("query_id", "gid", "score", "rnk")


_FOUND = f"pf AS (SELECT query_id, event_id % {N_ITEMS} AS gid, max(value) AS s FROM qv JOIN events ON user_id % 10 = query_id % 10 AND event_type = 'purchase' GROUP BY ALL)"


@query("q2_hit_provider", f"WITH {H}, {_FOUND}, pz AS (SELECT query_id, gid, round((s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-6), 6) AS z FROM pf WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, gid, round(score + CAST(0.1 AS DOUBLE) * coalesce(z, 0), 8) AS score FROM h LEFT JOIN pz USING (query_id, gid)) SELECT query_id, gid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rnk FROM f")
def hit_provider(spark, d):
    """A provider of scores by event, beside the vectors."""

    def found(queries):
        e = dealt(table(spark, d, "events"), spark, d).where("event_type = 'purchase'").select((F.col("user_id") % 10).alias("m"), (F.col("event_id") % F.col("_items")).alias("gid"), F.col("value").alias("score"))
        return engine.Shared(queries.select("query_id", (F.col("query_id") % 10).alias("m")), e)

    e, q = _engine(spark, d, [(0.1, found)])
    return e.search(q).select("query_id", "gid", "score", "rnk")


@query("q3_plugged_decomposer", """SELECT item_id, CASE WHEN length(text) % 3 = 0 OR len(p) = 0 THEN [text] ELSE p END AS events FROM (SELECT item_id, text, list_filter(string_split(text, '. '), lambda x: x <> '') AS p FROM benchmark)""")
def plugged_decomposer(spark, d):
    """A decomposer of the caller's own that cuts sentences and fails on every third length: those texts stay one event."""

    def ask(x: str) -> list[str]:
        if len(x) % 3 == 0:
            raise ValueError("no answer")
        return [p for p in x.split(". ") if p]

    b = table(spark, d, "benchmark")
    return b.select("item_id", engine.within(ask, 2.0, lambda t: F.array(t))(F.col("text")).alias("events"))


@query("q5_answer_matcher", "SELECT item_id, CASE WHEN length(text) = length(lower(text)) AND starts_with(lower(text), substr(lower(text), 1, 3)) THEN 1.0::DOUBLE ELSE 0 END AS r FROM benchmark")
def answer_matcher(spark, d):
    """A matcher of the caller's own: the answer begins with the truth."""
    b = table(spark, d, "benchmark")
    begins = lambda a, t: F.lower(a).startswith(F.lower(t))
    return b.select("item_id", evaluate.answer_score(F.lit(1.0), F.col("text"), F.substring("text", 1, 3), begins).alias("r"))


@query("q6_key_mapper", f"WITH {H}, t AS (SELECT 'V' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') || '/' || lpad(CAST(event_id % 40 + 1 AS VARCHAR), 3, '0') AS key, count(*) AS found FROM events GROUP BY 1) SELECT query_id, gid, key, coalesce(found, 0) AS found FROM (SELECT *, video_id || '/' || lpad(CAST(n AS VARCHAR), 3, '0') AS key FROM h) LEFT JOIN t USING (key)")
def key_mapper(spark, d):
    e, q = _engine(spark, d)
    k = engine.stem_of(F.format_string("V%03d", F.col("user_id") % 10), F.col("event_id") % 40 + 1)
    t = table(spark, d, "events").groupBy(k.alias("key")).agg(F.count("*").alias("found"))
    return e.joined(e.search(q), t).select("query_id", "gid", "key", F.coalesce("found", F.lit(0)).alias("found"))


@query("b13_round", f"WITH {FINAL} SELECT query_id, final_score FROM fs")
def whole_round(spark, d):
    """Search, allocation, export and score through the engine; the rows read back from the ZIP are those scored."""
    e, q = _engine(spark, d)
    rows = e.rows(e.search(q).where("rnk <= 60"), "hybrid")
    folder = shared_folder(spark, "round")
    e.export(rows, q.select("query_id", F.concat(F.lit("query-"), F.col("query_id").cast("string"), F.lit(".txt")).alias("name")), folder)
    back = sinks.zip_lines(spark.read.format("binaryFile").load(f"{folder}/*.zip"))
    parts = F.split("line", ",")
    read = back.select(F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("query_id"), (F.col("pos") + 1).alias("rank"), parts[0].alias("video_id"), parts[1].cast("long").alias("frame"))
    return e.score(read, truth(spark, d))
