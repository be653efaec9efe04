"""Queries of sinks, scalar functions and event-time windows (B, O, P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions import arrays, text
from keymoment.operators import allocate
from keymoment.sources import sinks
from keymoment.streaming import flows

from .answer_queries import CAND, HYBRID, candidates
from .corpus import H, N_QUERIES, S, dealt, hits, keyframes, scores, table
from .lexical_queries import _tok
from .registry import query
from .relational_queries import segments


def _san(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[,\\r\\n\"]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("b1_sanitised", f"SELECT doc_id, {_san('text')} AS field FROM documents")
def sanitised(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitise(F.col("text")).alias("field"))


@query("b2_answer_rows", f"WITH {CAND}, {HYBRID} SELECT query_id, string_agg(video_id || ',' || frame, chr(10) ORDER BY rank) || chr(10) AS csv FROM hr WHERE rank <= 100 GROUP BY query_id")
def answer_rows(spark, d):
    r = allocate.hybrid_rows(candidates(spark, d))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "video_id", "frame"))), lambda x: F.concat_ws(",", x["video_id"], x["frame"]))
    return r.groupBy("query_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("csv"))


@query("b3_csv_names", "SELECT page_id, regexp_replace(url, '[.][^.]*$', '') || '.csv' AS name FROM pages")
def csv_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.csv_name(F.col("url")).alias("name"))


_LINES = "li AS (SELECT source || CASE WHEN doc_id % 3 = 0 THEN '-qa.csv' WHEN doc_id % 3 = 1 THEN '-trake.csv' ELSE '-kis.csv' END AS file, doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'V1' WHEN doc_id % 7 = 1 THEN 'V1.mp4,12' WHEN doc_id % 7 = 2 THEN 'V1,x' WHEN doc_id % 7 = 3 THEN 'V1,5,ans' WHEN doc_id % 7 = 4 THEN 'V1,5,\"a\"' WHEN doc_id % 7 = 5 THEN 'V1,5, ' ELSE 'V2,8,9,10' END AS line FROM documents)"


def _lines(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "-qa.csv").when(i % 3 == 1, "-trake.csv").otherwise("-kis.csv")
    line = F.element_at(F.array(*map(F.lit, ("V1", "V1.mp4,12", "V1,x", "V1,5,ans", 'V1,5,"a"', "V1,5, ", "V2,8,9,10"))), (i % 7 + 1).cast("int"))
    return table(spark, d, "documents").select(F.concat("source", kind).alias("file"), i.alias("pos"), line.alias("line"))


@query("b5_verifier", f"""WITH {_LINES}, x AS (SELECT *, len(string_split(line, ',')) AS w, CASE WHEN file LIKE '%qa%' THEN 'qa' WHEN file LIKE '%trake%' THEN 'trake' ELSE 'kis' END AS task FROM li),
r AS (SELECT file, unnest(list_filter([CASE WHEN w < 2 THEN 'few fields' END, CASE WHEN w >= 2 AND NOT regexp_matches(split_part(line, ',', 2), '^-?[0-9]+$') THEN 'frame' END, CASE WHEN contains(line, '.mp4') THEN 'suffix' END, CASE WHEN contains(line, '"') THEN 'quote' END, CASE WHEN task = 'qa' AND (w < 3 OR trim(split_part(line, ',', 3)) = '') THEN 'no answer' END, CASE WHEN task = 'trake' AND w = 2 THEN 'one event' END], lambda p: p IS NOT NULL)) AS problem FROM x),
f AS (SELECT file, count(*) AS n, min(w) <> max(w) AS uneven, min(task) AS task FROM x GROUP BY file)
SELECT file, problem, 'error' AS severity, count(*) AS n FROM r GROUP BY file, problem UNION ALL SELECT file, 'fewer rows than allowed', 'note', n FROM f WHERE n < 100 UNION ALL SELECT file, 'too many rows', 'error', n FROM f WHERE n > 100 UNION ALL SELECT file, 'uneven width', 'error', n FROM f WHERE uneven AND task = 'trake'""")
def verifier(spark, d):
    return sinks.row_problems(_lines(spark, d))


@query("b5_file_names", f"WITH {_LINES}, g AS (SELECT DISTINCT file FROM li), w AS (SELECT DISTINCT source || '-kis.csv' AS file FROM documents WHERE source <> 'src3' UNION SELECT 'other.csv') SELECT file, 'missing' AS problem FROM w WHERE file NOT IN (SELECT file FROM g) UNION ALL SELECT file, 'extra' FROM g WHERE file NOT IN (SELECT file FROM w)")
def file_names(spark, d):
    t = table(spark, d, "documents").where("source <> 'src3'").select(F.concat("source", F.lit("-kis.txt")).alias("name"))
    other = spark.createDataFrame([("other.txt",)], "name string")
    return sinks.name_problems(_lines(spark, d), t.unionByName(other))


@query("b6_qa_files", "SELECT page_id, regexp_matches(lower(url), 'qa|en') AS qa FROM pages")
def qa_files(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower("url").rlike("qa|en").alias("qa"))


@query("b7_lines", f"WITH {H} SELECT query_id, gid, video_id || ',' || frame_idx || ',' || (frame_idx + 55) || CASE WHEN gid % 2 = 0 THEN ',a b' ELSE '' END AS line FROM h WHERE score > 0.1")
def lines(spark, d):
    h = hits(spark, d).where("score > 0.1")
    return h.select("query_id", "gid", sinks.answer_line(F.col("video_id"), F.array("frame_idx", F.col("frame_idx") + 55), F.when(F.col("gid") % 2 == 0, F.lit('a,"b"'))).alias("line"))


@query("b8_short_answers", "SELECT turn, conv_id, text, substr(regexp_replace(trim(regexp_replace(regexp_replace(trim('Answer: \"' || text || '\".'), '^(?i)(the answer is|answer|đáp án|trả lời)\\s*[:\\-]?\\s*', ''), '^[\"''“”]+|[\"''“”]+$', '', 'g')), '[.]+$', ''), 1, 200) AS short FROM conversations")
def short_answers(spark, d):
    x = F.concat(F.lit('Answer: "'), "text", F.lit('".'))
    return table(spark, d, "conversations").select("turn", "conv_id", "text", text.short_answer(x).alias("short"))


@query("b9_batches", f"WITH {H}, b AS (SELECT query_id, (rnk - 1) // 8 AS batch, rnk, gid FROM h WHERE rnk <= 30) SELECT query_id, batch, '[' || string_agg('{{\"gid\":' || gid || ',\"rnk\":' || rnk || '}}', ',' ORDER BY rnk) || ']' AS rows FROM b GROUP BY ALL")
def batches(spark, d):
    return sinks.ndjson_batches(hits(spark, d, 30).select("query_id", "gid", "rnk"), ["query_id"], "rnk", 8)


@query("b10_stamped", f"WITH {H}, an AS (SELECT item_id % {N_QUERIES} AS query_id, item_id AS pos, CASE WHEN item_id < 20 THEN ' ' ELSE text END AS answer FROM benchmark), f AS (SELECT query_id, arg_min(answer, pos) AS answer FROM an WHERE trim(answer) <> '' GROUP BY query_id) SELECT h.query_id, gid, answer FROM h LEFT JOIN f USING (query_id) WHERE rnk <= 20")
def stamped(spark, d):
    a = dealt(table(spark, d, "benchmark"), spark, d).select((F.col("item_id") % F.col("_queries")).alias("query_id"), F.col("item_id").alias("pos"), F.when(F.col("item_id") < 20, F.lit(" ")).otherwise(F.col("text")).alias("answer"))
    return sinks.stamped_answers(hits(spark, d, 20).select("query_id", "gid"), a)


# --- scalar functions


@query("o1_folded", "SELECT doc_id, lower(nfc_normalize(text)) AS folded FROM documents")
def folded(spark, d):
    return table(spark, d, "documents").select("doc_id", text.folded(F.col("text")).alias("folded"))


@query("o2_without_marks", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def without_marks(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_marks(F.col("text")).alias("plain"))


@query("o3_tokens", f"SELECT item_id, {_tok('text')} AS tokens FROM benchmark")
def tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("tokens"))


_META = ", ".join(f"'{w}'" for w in text.METADATA_STOP_WORDS)
_COMP = ("of the", "in the", "to the", "it is")


@query("o4_metadata_tokens", f"WITH w AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[0-9a-zà-ỹ]+') AS w, lower(nfc_normalize(text)) AS t FROM benchmark), l AS (SELECT item_id, list_concat(list_filter(w, lambda x: x NOT IN ({_META}) AND length(x) >= 3), list_transform(list_filter({list(_COMP)}, lambda p: contains(t, p)), lambda p: replace(p, ' ', '_'))) AS l FROM w) SELECT item_id, list_sort(list_distinct(l)) AS tokens FROM l")
def metadata_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sort_array(text.metadata_tokens(F.col("text"), _COMP)).alias("tokens"))


@query("o5_compounds", f"SELECT doc_id, list_transform(list_filter({list(_COMP)}, lambda p: contains(lower(text), p)), lambda p: replace(p, ' ', '_')) AS found FROM documents")
def compounds(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compound_phrases(F.col("text"), _COMP).alias("found"))


@query("o6_chunks")
def chunks(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.chunks_of("text").alias("chunks"))


@query("o7_reduced", "SELECT item_id, CASE WHEN len(string_split(y, ' ')) < 3 THEN x ELSE y END AS query FROM (SELECT item_id, x, trim(regexp_replace(replace(replace(lower(x), 'a scene of', ' '), 'there is', ' '), '\\s+', ' ', 'g')) AS y FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'A scene of ' || text ELSE 'There is it' END AS x FROM benchmark))")
def reduced(spark, d):
    x = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("A scene of "), "text")).otherwise("There is it")
    return table(spark, d, "benchmark").select("item_id", text.reduced_query(x, ("a scene of", "there is")).alias("query"))


@query("o8_events")
def events(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.events_of("text").alias("events"))


@query("o9_decomposed", """WITH h AS (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS t, length(text) // 2 AS n, text FROM benchmark), p AS (SELECT item_id, unnest([substr(text, 1, n), substr(text, n + 1)]) AS part, unnest([1, 2]) AS i FROM h), c AS (SELECT item_id, i, trim(regexp_replace(part, '\\s+', ' ', 'g'), ' ,;.') AS e FROM p)
SELECT item_id, list(e ORDER BY i) AS events FROM c WHERE e <> '' GROUP BY item_id""")
def decomposed(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    x = F.concat(F.lit("E1: "), F.substring(F.col("text"), F.lit(1), half), F.lit(" E2: "), F.substring(F.col("text"), half + 1, F.length("text")))
    return table(spark, d, "benchmark").select("item_id", text.events_of(x).alias("events"))


@query("o10_first_time", "SELECT conv_id, turn, role, regexp_matches(lower(text), 'first time|for the first|lần đầu|đầu tiên') AS first FROM conversations")
def first_time(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.first_time(F.col("text")).alias("first"))


@query("o11_questions", "SELECT doc_id, trim(regexp_extract(text || '? no', '([^.!?]*[?])[^?]*$', 1)) AS question FROM documents")
def questions(spark, d):
    return table(spark, d, "documents").select("doc_id", text.question_of(F.concat("text", F.lit("? no"))).alias("question"))


@query("o12_tasks", "SELECT page_id, CASE WHEN contains(lower(url), 'trake') THEN 'trake' WHEN regexp_matches(lower(url), 'qa|q&a|vqa') THEN 'qa' ELSE 'kis' END AS task FROM pages")
def tasks(spark, d):
    return table(spark, d, "pages").select("page_id", text.task_of(F.col("url")).alias("task"))


@query("o13_colours", f"SELECT p_partkey, list_filter({list(text.COLOURS)}, lambda c: list_contains(regexp_extract_all(lower(p_name || ' red Blue'), '[0-9a-zà-ỹ]+'), c)) AS colours FROM part")
def colours(spark, d):
    return table(spark, d, "part").select("p_partkey", text.colours_in(F.concat("p_name", F.lit(" red Blue"))).alias("colours"))


_RGB = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 37 % 256 AS r, l_orderkey * 59 % 256 AS g, l_linenumber * 83 % 256 AS b FROM lineitem)"


@query("o14_colour_classes", f"""WITH {_RGB}, y AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp FROM x), z AS (SELECT *, hi / CAST(255 AS DOUBLE) AS v, CASE WHEN hi = 0 THEN 0 ELSE sp / CAST(hi AS DOUBLE) END AS s, CASE WHEN sp = 0 THEN 0 WHEN hi = r THEN 60 * ((((g - b) / CAST(sp AS DOUBLE)) + 6) - 6 * floor((((g - b) / CAST(sp AS DOUBLE)) + 6) / 6)) WHEN hi = g THEN 60 * ((b - r) / CAST(sp AS DOUBLE) + 2) ELSE 60 * ((r - g) / CAST(sp AS DOUBLE) + 4) END AS h FROM y)
SELECT CASE WHEN v < 0.2 THEN 'black' WHEN s < 0.15 AND v > 0.85 THEN 'white' WHEN s < 0.15 THEN 'gray' WHEN h < 15 OR h >= 345 THEN 'red' WHEN h < 40 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 170 THEN 'green' WHEN h < 260 THEN 'blue' WHEN h < 300 THEN 'purple' ELSE 'pink' END AS colour, count(*) AS n FROM z GROUP BY 1""")
def colour_classes(spark, d):
    x = table(spark, d, "lineitem")
    c = text.colour_class(F.col("l_partkey") * 37 % 256, F.col("l_orderkey") * 59 % 256, F.col("l_linenumber") * 83 % 256)
    return x.groupBy(c.alias("colour")).agg(F.count("*").alias("n"))


@query("o15_counted_terms", "SELECT conv_id, turn, role, CASE WHEN NOT regexp_matches(lower(t), '(^|[^a-z])car') THEN 0 ELSE coalesce(CASE WHEN m = 'two' THEN 2 WHEN m = 'three' THEN 3 WHEN m = '' THEN NULL ELSE TRY_CAST(m AS BIGINT) END, 1) END AS cars FROM (SELECT *, regexp_extract(lower(t), '([0-9]+|one|two|three|four|five|six)(?: [a-z]+)? car', 1) AS m FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN text || ' two red cars' WHEN turn % 3 = 1 THEN '12 cars' ELSE text END AS t FROM conversations))")
def counted_terms(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" two red cars"))).when(F.col("turn") % 3 == 1, F.lit("12 cars")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.term_count(t, "car").alias("cars"))


@query("o16_tolerant_json", "SELECT item_id, '{\"a\": ' || item_id || '}' AS object FROM benchmark")
def tolerant_json(spark, d):
    x = F.concat(F.lit("Sure: ```json\n{\"a\": "), F.col("item_id").cast("string"), F.lit(", }\n``` done"))
    return table(spark, d, "benchmark").select("item_id", text.json_object(x).alias("object"))


@query("o17_verdicts", "SELECT event_id, round(least(greatest(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0), 100) / 100, 4) AS score FROM events")
def verdicts(spark, d):
    k = F.from_json("props", "k double")["k"]
    return table(spark, d, "events").select("event_id", F.round(F.least(F.greatest(k, F.lit(0.0)), F.lit(100.0)) / 100, 4).alias("score"))


@query("o18_payload_shapes", "SELECT event_id, coalesce(json_extract_string(p, '$.class'), json_extract_string(p, '$.label'), json_extract_string(p, '$.k')) AS cls FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"class\":\"c' || event_id || '\"}' WHEN event_id % 3 = 1 THEN '{\"label\":\"l\"}' ELSE props END AS p FROM events)")
def payload_shapes(spark, d):
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"class":"c'), F.col("event_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.lit('{"label":"l"}')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(*[F.get_json_object(p, f"$.{k}") for k in ("class", "label", "k")]).alias("cls"))


@query("o19_times", "SELECT conv_id, turn, role, CAST(floor(turn * 37.5 * 25) AS BIGINT) AS frame, CAST(floor(turn * 37.5 / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(turn * 37.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, 'https://x/y' || '&t=' || greatest(CAST(floor(turn * 37.5) AS BIGINT) - 2, 0) || 's' AS link FROM conversations")
def times(spark, d):
    s = F.col("turn") * 37.5
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.floor(s * 25).alias("frame"), text.minutes(s).alias("clock"), text.deep_link(F.lit("https://x/y"), s).alias("link"))


@query("o20_maths", f"WITH {H} SELECT query_id, gid, round(exp(score / 0.02) / sum(exp(score / 0.02)) OVER (PARTITION BY query_id), 6) AS softmax, round(exp(-0.5 * pow((frame_idx - 500) / 30.0, 2)), 6) AS gauss, round(floor(score / 1e-3 + 0.5) * 1e-3, 6) AS quantised, round(tanh(score), 6) AS tanh, round(1 / (1 + exp(-score)), 6) AS sigmoid, round(log2(1 + rnk), 6) AS log2 FROM h WHERE rnk <= 50")
def maths(spark, d):
    w = Window.partitionBy("query_id")
    e = F.exp(F.col("score") / 0.02)
    h = hits(spark, d, 50)
    return h.select("query_id", "gid", F.round(e / F.sum(e).over(w), 6).alias("softmax"), F.round(arrays.gaussian(F.col("frame_idx"), F.lit(500), 30.0), 6).alias("gauss"), F.round(arrays.quantise(F.col("score"), 1e-3), 6).alias("quantised"), F.round(F.tanh("score"), 6).alias("tanh"), F.round(arrays.sigmoid(F.col("score")), 6).alias("sigmoid"), F.round(F.log2(F.col("rnk") + 1), 6).alias("log2"))


@query("o20_entropy", f"WITH {S}, p AS (SELECT query_id, video_id, exp(score) / sum(exp(score)) OVER (PARTITION BY query_id, video_id) AS p FROM s) SELECT query_id, video_id, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p GROUP BY ALL")
def entropy(spark, d):
    s = scores(spark, d).groupBy("query_id", "video_id").agg(F.sort_array(F.collect_list("score")).alias("a"))
    return s.select("query_id", "video_id", F.round(arrays.entropy_of(arrays.softmax(F.col("a"))), 6).alias("entropy"))


@query("o21_keys", "SELECT item_id, substr(sha1('m' || chr(10) || text), 1, 16) AS key, md5(text) AS md5 FROM benchmark")
def keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring(F.sha1(F.concat(F.lit("m\n"), "text")), 1, 16).alias("key"), F.md5("text").alias("md5"))


@query("o22_context", "SELECT user_id, 'Visible text: ' || string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) || '; Objects: x: ' || count(*) AS line FROM events GROUP BY user_id")
def context(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"), F.count("*").alias("n"))
    return g.select("user_id", text.context_line(F.col("t"), F.array(F.concat(F.lit("x: "), F.col("n").cast("string")))).alias("line"))


@query("o23_video_keys", "SELECT page_id, regexp_extract(u, '(?:v=|/)([0-9A-Za-z_-]{11})(?:[?&#]|$)', 1) AS key FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://watch.example/w?v=' || substr(md5(url), 1, 11) || '&t=3' ELSE url END AS u FROM pages)")
def video_keys(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://watch.example/w?v="), F.substring(F.md5("url"), 1, 11), F.lit("&t=3"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.video_key(u).alias("key"))


@query("o24_quota_errors", "SELECT event_id, event_id % 4 < 2 AS quota FROM events")
def quota_errors(spark, d):
    e = F.element_at(F.array(*map(F.lit, ("HTTP 429", "RESOURCE_EXHAUSTED: daily quota", "timeout", "bad request"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.quota_error(e).alias("quota"))


@query("o25_arrays", "SELECT vec_id, list_position(e, list_max(e)) - 1 AS argmax, CAST(len(list_distinct(list_transform(e, lambda x: floor(x * 10)))) AS BIGINT) AS kinds FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)".replace("list_position(e, list_max(e)) - 1", "CAST(list_position(e, list_max(e)) - 1 AS BIGINT)"))
def array_functions(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", arrays.argmax(e).alias("argmax"), F.size(arrays.distinct_in_order(F.transform(e, lambda x: F.floor(x * 10)))).alias("kinds"))


@query("o26_maps", "SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events GROUP BY user_id")
def maps(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m"))
    return c.select("user_id", F.coalesce(F.col("m")["view"], F.lit(0)).alias("views"), F.size(F.map_filter("m", lambda k, v: v > 0)).alias("kinds"))


# --- event time (extras)


@query("p3_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.event_counts(e).withColumn("start", F.unix_seconds("start"))


@query("p3_sliding", "SELECT CAST(epoch(b) AS BIGINT) + o AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events), (SELECT unnest([0, -3600]) AS o) GROUP BY ALL")
def sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.sliding_counts(e).withColumn("start", F.unix_seconds("start"))


@query("p3_sessions", "WITH t AS (SELECT user_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS new FROM t), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, s".replace("GROUP BY user_id, s", "GROUP BY user_id, s.s"))
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.sessions(e).select("user_id", F.unix_micros("start").alias("start"), "n")


@query("q8_evidence", f"WITH {H}, sp AS (SELECT conv_id, min(turn) AS turn, min(text) AS text FROM conversations GROUP BY conv_id) SELECT h.query_id, h.gid, k.gid AS neighbour FROM h JOIN k ON k.video_id = h.video_id AND abs(k.n - h.n) <= 2 WHERE rnk = 1")
def evidence(spark, d):
    h = hits(spark, d, 1).withColumn("n", F.explode(F.array(*[F.col("n") + i for i in (-2, -1, 0, 1, 2)]))).select("query_id", "gid", "video_id", "n")
    return h.join(keyframes(spark, d).select("video_id", "n", F.col("gid").alias("neighbour")), ["video_id", "n"]).select("query_id", "gid", "neighbour")
