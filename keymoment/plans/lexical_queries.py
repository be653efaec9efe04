"""Queries of lexical retrieval and fusion (J, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions import arrays, text
from keymoment.operators import fusion, lexical, postings, topk, vector
from keymoment.sources.files import shared_folder

from .corpus import H, K, N_ITEMS, N_QUERIES, S, dealt, hits, keyframes, query_vectors, scores, table
from .registry import query
from .relational_queries import _SEG, segments
from .scan_queries import _DET, detections

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _tok(col: str) -> str:
    """The tokenizer in DuckDB's SQL, as a list expression over a column."""
    w = f"list_filter(regexp_extract_all(lower(nfc_normalize({col})), '[0-9a-zà-ỹ]+'), lambda t: length(t) > 1)"
    return f"list_concat(list_filter({w}, lambda t: t NOT IN ({_STOP})), list_transform(list_filter(list_zip({w}[:-2], {w}[2:]), lambda p: NOT (p[1] IN ({_STOP}) AND p[2] IN ({_STOP}))), lambda p: p[1] || '_' || p[2]))"


#: Documents have no title column: their first 60 letters stand in for one and count three times more, beside the whole text. Queries: every item of the benchmark.
POST = f"""dt AS (SELECT doc_id, unnest({_tok("substr(text, 1, 60) || ' . ' || substr(text, 1, 60) || ' . ' || substr(text, 1, 60) || ' . ' || text")}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id), fr AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tok("text")}) AS term FROM benchmark) GROUP BY ALL)"""
BM = """bm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (0.25 + 0.75 * dl / avg_dl))) AS score, count(*) AS matched FROM post JOIN qt USING (term) JOIN fr USING (term) JOIN dl USING (doc_id), st WHERE IDFGATE GROUP BY ALL)"""


def documents(spark, d):
    t = table(spark, d, "documents")
    title = F.substring("text", 1, 60)
    return t.select("doc_id", "source", "lang", F.concat_ws(" . ", title, title, title, "text").alias("body"), "text")


def doc_postings(spark, d):
    return lexical.postings(documents(spark, d), "doc_id", text.tokens(F.col("body")))


def bench_terms(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.query_terms(q, text.tokens(F.col("text")))


@query("g3_term_statistics", f"WITH {POST} SELECT term, df FROM fr")
def term_statistics(spark, d):
    return lexical.frequencies(doc_postings(spark, d))


@query("g3_document_lengths", f"WITH {POST} SELECT doc_id, CAST(dl AS BIGINT) AS dl, round(avg_dl, 4) AS avg_dl FROM dl, st")
def document_lengths(spark, d):
    dl = lexical.lengths(doc_postings(spark, d), "doc_id")
    return dl.join(F.broadcast(lexical.collection(dl))).select("doc_id", "dl", F.round("avg_dl", 4).alias("avg_dl"))


@query("j1_bm25", f"WITH {POST}, {BM.replace('K1', '1.2').replace('IDFGATE', 'true')} SELECT query_id, doc_id, round(score, 5) AS score FROM bm")
def bm25(spark, d):
    return lexical.bm25_documents(documents(spark, d), "doc_id", text.tokens(F.col("body")), bench_terms(spark, d)).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("j1_bm25_postings", f"WITH {POST}, {BM.replace('K1', '1.2').replace('IDFGATE', 'true')} SELECT query_id, doc_id, round(score, 5) AS score FROM bm")
def bm25_postings(spark, d):
    docs, terms, tokens = documents(spark, d), bench_terms(spark, d), text.tokens(F.col("body"))
    s = lexical.bm25(lexical.postings(docs, "doc_id", tokens, terms), "doc_id", terms, dl=lexical.text_lengths(docs, "doc_id", tokens))
    return s.select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("j3_metadata_bm25", f"WITH {POST}, p2 AS (SELECT doc_id, term, 1 AS tf FROM post), {BM.replace('K1', '1.5').replace('IDFGATE', 'ln(1 + (n_docs - df + 0.5) / (df + 0.5)) > 1').replace('FROM post', 'FROM p2')}, g AS (SELECT * FROM bm WHERE matched >= 2) SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 5) AS score FROM g".replace("dl AS (SELECT doc_id, sum(tf) AS dl FROM post", "dl AS (SELECT doc_id, count(*) AS dl FROM post"))
def metadata_bm25(spark, d):
    once = F.array_distinct(text.tokens(F.col("body")))  # every frequency is 1
    s = lexical.bm25_documents(documents(spark, d), "doc_id", once, bench_terms(spark, d), 1.5, 0.75, 1.0, 2)
    return s.select("query_id", "doc_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 5).alias("score"))


@query("c9_idf_gate", f"WITH {POST}, g AS (SELECT query_id, doc_id, count(DISTINCT term) AS terms FROM post JOIN qt USING (term) JOIN fr USING (term), st WHERE ln(1 + (n_docs - df + 0.5) / (df + 0.5)) > 1 GROUP BY ALL) SELECT * FROM g WHERE terms >= 2")
def idf_gate(spark, d):
    s = lexical.bm25_documents(documents(spark, d), "doc_id", text.tokens(F.col("body")), bench_terms(spark, d), idf_over=1.0, least_terms=2)
    return s.select("query_id", "doc_id", F.col("matched").alias("terms"))


@query("j4_idf_sum", f"WITH {POST} SELECT query_id, doc_id, round(tanh(CAST(0.15 AS DOUBLE) * sum(ln(1 + CAST(n_docs AS DOUBLE) / (1 + df)))), 6) AS score FROM post JOIN qt USING (term) JOIN fr USING (term), st GROUP BY ALL")
def idf_sum(spark, d):
    docs, terms, tokens = documents(spark, d), bench_terms(spark, d), text.tokens(F.col("body"))
    n = lexical.text_lengths(docs, "doc_id", tokens).agg(F.count("*").alias("n_docs"))
    return lexical.idf_sum(lexical.postings(docs, "doc_id", tokens, terms), "doc_id", terms, n=n)


#: Stored indexes by (application, tables, kind): built at first use, read by all later searches of the session.
_INDEXES: dict[tuple[str, str, str], postings.Index] = {}


def text_index(spark, d, kind):
    """kind: words (frequencies count), gated (a word counts once) or sums (a word counts once, whatever the length)."""
    at = (spark.sparkContext.applicationId, d, kind)
    if at not in _INDEXES:
        docs = documents(spark, d).withColumn("body", text.folded(F.col("body")))
        tokens, k1 = text.folded_tokens(F.col("body")), {"words": 1.2, "gated": 1.5, "sums": 0.0}[kind]
        _INDEXES[at] = postings.build(docs, "doc_id", tokens if kind == "words" else F.array_distinct(tokens), shared_folder(spark, "text-index"), ["lang"], k1)
    return _INDEXES[at]


def _best(score: str, rows: str) -> str:
    return f"SELECT query_id, doc_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk FROM (SELECT query_id, doc_id, round({score}, 5) AS score FROM {rows})) WHERE rnk <= 100"


_P2 = "p2 AS (SELECT doc_id, term, 1 AS tf FROM post)"


@query("j1_top", f"WITH {POST}, {BM.replace('K1', '1.2').replace('IDFGATE', 'true')} {_best('score', 'bm')}")
def bm25_top(spark, d):
    return postings.search(spark, text_index(spark, d, "words"), bench_terms(spark, d)).top.withColumnRenamed("doc", "doc_id")


@query("j3_top", f"WITH {POST}, {_P2}, {BM.replace('K1', '1.5').replace('IDFGATE', 'ln(1 + (n_docs - df + 0.5) / (df + 0.5)) > 1').replace('FROM post', 'FROM p2')}, g AS (SELECT * FROM bm WHERE matched >= 2) {_best('score', 'g')}".replace("dl AS (SELECT doc_id, sum(tf) AS dl FROM post", "dl AS (SELECT doc_id, count(*) AS dl FROM post"))
def metadata_top(spark, d):
    return postings.search(spark, text_index(spark, d, "gated"), bench_terms(spark, d), idf_over=1.0, least_terms=2).top.withColumnRenamed("doc", "doc_id")


@query("j4_top", f"WITH {POST}, g AS (SELECT query_id, doc_id, sum(ln(1 + CAST(n_docs AS DOUBLE) / (1 + df))) AS total FROM post JOIN qt USING (term) JOIN fr USING (term), st GROUP BY ALL), b AS ({_best('total', 'g')}) SELECT query_id, doc_id, round(tanh(CAST(0.15 AS DOUBLE) * score), 6) AS score, rnk FROM b")
def idf_sum_top(spark, d):
    idf = lambda n, df: F.log(1 + n / (1 + df))
    terms = bench_terms(spark, d).withColumn("qtf", F.lit(1))
    return postings.search(spark, text_index(spark, d, "sums"), terms, idf=idf).top.select("query_id", F.col("doc").alias("doc_id"), F.round(F.tanh(0.15 * F.col("score")), 6).alias("score"), "rnk")


@query("j2_best_passage", f"""WITH {_SEG}, u AS (SELECT video, turn, min(start) AS start, min(text) AS text FROM seg GROUP BY video, turn), t AS (SELECT video, turn, start, unnest({_tok('text')}) AS term FROM u), cd AS (SELECT term, count(DISTINCT video) AS df FROM t GROUP BY term), cn AS (SELECT count(DISTINCT video) AS n FROM t),
ci AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM cd, cn), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT video, turn, start, term, count(*) AS tf FROM t GROUP BY ALL), w AS (SELECT query_id, video, first, term, sum(tf) AS tf, max(qtf) AS qtf, max(idf) AS idf, min(start) AS start FROM (SELECT *, unnest(range(greatest(turn - 4, 0), turn + 1)) AS first FROM hit JOIN qt USING (term) JOIN ci USING (term)) GROUP BY ALL),
v AS (SELECT query_id, video, first, round(sum(idf * least(tf, 3) * qtf), 6) AS value, min(start) AS start FROM w GROUP BY ALL)
SELECT query_id, video, first, start, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY value DESC, first) AS r FROM v) WHERE r = 1""")
def best_passage(spark, d):
    s = segments(spark, d).groupBy("video", "turn").agg(F.min("start").alias("start"), F.min("text").alias("text"))
    post = s.select("video", F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    n = F.broadcast(post.agg(F.countDistinct("video").alias("n")))
    idf = post.groupBy("term").agg(F.count("*").alias("df")).join(n).select("term", lexical.bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    return lexical.best_passage(s, bench_terms(spark, d), idf, text.tokens(F.col("text")))


@query("j5_ngram_boost", f"""WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
g AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w)
SELECT query_id, doc_id, round(tanh(CAST(0.02 AS DOUBLE) * sum(CASE WHEN len(string_split(g, ' ')) = 3 THEN CAST(4.0 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END)) * CAST(0.035 AS DOUBLE), 8) AS boost FROM g, documents WHERE contains(lower(text), g) GROUP BY ALL""")
def ngram_boost(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    n = F.size("w")
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))).otherwise(F.array())
    g = q.select("query_id", F.explode(F.concat(grams(2), grams(3))).alias("phrase")).distinct()
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    x = lexical.contained(low, "doc_id", "low", g).join(g, "phrase")
    weight = F.when(F.size(F.split("phrase", " ")) == 3, 4.0).otherwise(2.0)
    return x.groupBy("query_id", "doc_id").agg(F.round(F.tanh(0.02 * F.sum(weight)) * 0.035, 8).alias("boost"))


@query("j6_title_channel", f"WITH t AS (SELECT doc_id, unnest({_tok('substr(text, 1, 60)')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark) SELECT query_id, doc_id, count(*) AS matched FROM p JOIN qt USING (term) GROUP BY ALL")
def title_channel(spark, d):
    p = lexical.postings(table(spark, d, "documents").withColumn("title", F.substring("text", 1, 60)), "doc_id", text.tokens(F.col("title")))
    return p.join(bench_terms(spark, d).select("query_id", "term"), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("matched"))


@query("j7_joined_channels", f"WITH {_SEG}, x AS (SELECT doc_id, text || ' ' || coalesce(spoken, '') AS body FROM documents LEFT JOIN (SELECT video, string_agg(text, ' ' ORDER BY start, turn, text) AS spoken FROM seg GROUP BY video) ON video = doc_id), t AS (SELECT doc_id, unnest({_tok('body')}) AS term FROM x), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS terms FROM p GROUP BY doc_id")
def joined_channels(spark, d):
    spoken = segments(spark, d).groupBy(F.col("video").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "turn", "text"))), lambda x: x["text"]), " ").alias("spoken"))
    x = table(spark, d, "documents").join(spoken, "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", F.coalesce("spoken", F.lit(""))).alias("body"))
    return lexical.postings(x, "doc_id", text.tokens(F.col("body"))).groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("terms"))


_PH = "ph AS (SELECT item_id AS query_id, string_split(lower(text), ' ')[1] || ' ' || string_split(lower(text), ' ')[2] || ' ' || string_split(lower(text), ' ')[3] AS phrase FROM benchmark)"


@query("j8_phrase_search", f"WITH {_PH}, x AS (SELECT query_id, doc_id, CAST(list_sum(list_transform(list_filter(regexp_split_to_array(phrase, '\\s+'), lambda t: t <> ''), lambda t: CASE WHEN contains(lower(text), t) THEN 1.0::DOUBLE ELSE 0 END)) AS DOUBLE) + CASE WHEN contains(lower(text), phrase) THEN 10 ELSE 0 END AS score FROM documents, ph) SELECT * FROM x WHERE score > 0")
def phrase_search(spark, d):
    w = F.split(F.lower("text"), " ")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", w[0], w[1], w[2]).alias("phrase"))
    return lexical.phrase_search(table(spark, d, "documents").select("doc_id", "text"), "doc_id", q)


@query("j9_term_find", "SELECT doc_id, CAST(len(list_filter(string_split('the erer anth in of tion', ' '), lambda t: length(t) > 2 AND contains(lower(text), t))) AS BIGINT) AS found FROM documents")
def term_find(spark, d):
    terms = F.filter(F.split(F.lit("the erer anth in of tion"), " "), lambda t: F.length(t) > 2)
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(terms, lambda t: F.contains(F.lower("text"), t))).alias("found"))


@query("j10_passage_search")
def passage_search(spark, d):
    """Windows of five cues with a query's terms; of two less than 25 seconds apart in a video the better stays."""
    s = segments(spark, d).groupBy("video", "turn").agg(F.min("start").alias("start"), F.min("text").alias("text"))
    hit = s.select("video", "turn", "start", F.explode(text.tokens(F.col("text"))).alias("term")).join(bench_terms(spark, d), "term")
    first = hit.select("query_id", "video", "term", F.explode(F.sequence(F.greatest(F.col("turn") - 4, F.lit(0)), F.col("turn"))).alias("n"))
    win = first.groupBy("query_id", "video", "n").agg(F.countDistinct("term").cast("double").alias("score")).withColumn("gid", F.col("n")).withColumn("pts_time", F.col("n") * 3.0)
    return topk.nms(win, ["query_id", "video"], 8, None, seconds=False).select("query_id", "video", F.col("n").alias("turn"), "score")


@query("j11_phrases", "SELECT item_id, list_distinct(list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda p: length(p) > 3)) AS p FROM benchmark".replace("list_distinct(list_filter", "list_sort(list_distinct(list_filter").replace("> 3)) AS p", "> 3))) AS p"))
def phrases(spark, d):
    p = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.sort_array(F.array_distinct(F.filter(p, lambda x: F.length(x) > 3))).alias("p"))


@query("j12_speech_decay", f"""WITH {_SEG}, c AS (SELECT video, start, round(length(text) / CAST(max(length(text)) OVER () AS DOUBLE), 6) AS s FROM seg), p AS (SELECT event_id AS hit, user_id AS video, CAST(event_id % 30 AS DOUBLE) AS att FROM events),
m AS (SELECT hit, min({{'d': abs(att - start), 'b': start, 's': s}}) AS m FROM p JOIN c USING (video) GROUP BY hit) SELECT hit, round(m.s * exp(-m.d / 20), 6) AS bonus FROM m""")
def speech_decay(spark, d):
    c = segments(spark, d).withColumn("l", F.length("text"))
    top = F.broadcast(c.agg(F.max("l").alias("top")))
    c = c.join(top).select("video", "start", F.round(F.col("l") / F.col("top"), 6).alias("s"))
    p = table(spark, d, "events").select(F.col("event_id").alias("hit"), F.col("user_id").alias("video"), (F.col("event_id") % 30).cast("double").alias("at"))
    return lexical.speech_decay(p, c, 20.0)


_PLAIN = "array_to_string(regexp_extract_all(lower(nfc_normalize({})), '[0-9a-zà-ỹ]+'), ' ')"
_QSTOP, _FSTOP = (", ".join(f"'{w}'" for w in x) for x in (text.FIELD_QUERY_STOP_WORDS, text.FIELD_STOP_WORDS))


def _runs(w: str) -> str:
    """Runs of one to three words of a list, in SQL."""
    one = lambda n: f"list_transform(range(1, len({w}) - {n - 2}), lambda i: {{'size': {n}, 'run': array_to_string({w}[i:i + {n - 1}], ' ')}})"
    return f"list_concat({one(1)}, {one(2)}, {one(3)})"


_FIELD = " ".join(f"WHEN size = {n} AND contains({f}, phrase) THEN CAST({w * (3 if f == 'f2' else 1)!r} AS DOUBLE)" for n, ws in lexical.FIELD_WEIGHTS.items() for f, w in zip(("f0", "f1", "f2"), ws, strict=True))


@query("j5_field_boost", f"""WITH pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), ' ') AS g, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS b FROM pages),
fd AS (SELECT page_id, {_PLAIN.format("t")} AS t0, {_PLAIN.format("g")} AS t1, {_PLAIN.format("b")} AS t2 FROM pg), qw AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(translate(lower(text), ',.;', '   '), '\\S+'), lambda w: length(w) >= 2 AND w NOT IN ({_QSTOP})) AS w FROM benchmark),
qg AS (SELECT query_id, g.size AS size, g.run AS run, CASE WHEN g.size = 1 THEN ' ' || g.run || ' ' ELSE g.run END AS phrase, count(*) AS times FROM (SELECT query_id, unnest({_runs("w")}) AS g FROM qw) GROUP BY ALL),
fw AS (SELECT page_id, list_filter(string_split(t0 || ' ' || t1 || ' ' || t2, ' '), lambda w: w <> '') AS w FROM fd), fg AS (SELECT DISTINCT page_id, g.size AS size, g.run AS run FROM (SELECT page_id, unnest({_runs("w")}) AS g FROM fw)),
fi AS (SELECT size, run, ln(1 + ((SELECT count(*) FROM pages) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM fg WHERE size > 1 OR (length(run) >= 2 AND run NOT IN ({_FSTOP})) GROUP BY ALL),
mt AS (SELECT query_id, page_id, coalesce(idf, 1) * times AS w, CASE {_FIELD} END AS part FROM (SELECT page_id, ' ' || t0 || ' ' AS f0, ' ' || t1 || ' ' AS f1, ' ' || t2 || ' ' AS f2 FROM fd), qg LEFT JOIN fi USING (size, run))
SELECT query_id, page_id, round(tanh(CAST(0.02 AS DOUBLE) * sum(w * part)) * CAST(0.035 AS DOUBLE), 8) AS boost FROM mt WHERE part IS NOT NULL GROUP BY ALL""")
def field_boost(spark, d):
    """Pages by the runs of words that they share with the benchmark's items: title, links as tags, article as description."""
    html = lambda p: F.regexp_extract("html", p, 1)
    tags = F.array_join(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1)), " ")
    article = F.regexp_replace(html("(?s)<article>(.*)</article>"), "<[^>]*>", " ")
    p = table(spark, d, "pages").select("page_id", *[text.plain_words(x).alias(n) for n, x in zip(lexical.FIELDS, (html("<title>([^<]*)</title>"), tags, article), strict=True)])
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.field_query_words(F.col("text")).alias("words"))
    return lexical.field_boost(p, "page_id", q, text.FIELD_STOP_WORDS)


#: Conversations are the videos' speech, and benchmark items the queries' texts, dealt to them by the remainders of their numbers.
_SPOKEN = f"""cu AS (SELECT 'V' || lpad(CAST(conv_id % (SELECT count(DISTINCT label) FROM embeddings) AS VARCHAR), 3, '0') AS video_id, turn, turn * CAST(3.0 AS DOUBLE) AS start, text FROM conversations), ct AS (SELECT video_id, turn, start, unnest({_tok("text")}) AS term FROM cu),
post AS (SELECT video_id AS doc_id, term, count(*) AS tf FROM ct GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id), fr AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id % {N_QUERIES} AS query_id, unnest({_tok("text")}) AS term FROM benchmark) GROUP BY ALL), {BM.replace("K1", "1.2").replace("IDFGATE", "true")},
hi AS (SELECT video_id, turn, start, term, count(*) AS tf FROM ct GROUP BY ALL), wn AS (SELECT query_id, video_id, first, term, sum(tf) AS tf, max(qtf) AS qtf, max(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS idf, min(start) AS start FROM (SELECT *, unnest(range(greatest(turn - 4, 0), turn + 1)) AS first FROM hi JOIN qt USING (term) JOIN fr USING (term), st) GROUP BY ALL),
vl AS (SELECT query_id, video_id, first, round(sum(idf * least(tf, 3) * qtf), 6) AS value, min(start) AS start FROM wn GROUP BY ALL), pa AS (SELECT query_id, video_id, start FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY value DESC, first) AS r FROM vl) WHERE r = 1)"""


@query("j13_transcript_bonus", f"""WITH {H}, {_SPOKEN}, sv AS (SELECT query_id, doc_id AS video_id, round(score, 6) AS s FROM bm), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM sv),
sp AS (SELECT query_id, max(s) AS top, coalesce(round((max(s) - max(s) FILTER (r = 2)) / max(s), 6), 0) AS spread FROM sr GROUP BY query_id), sn AS (SELECT query_id, video_id, s / top AS share FROM sv JOIN sp USING (query_id) WHERE top > 0 AND spread >= 0.02),
hb AS (SELECT h.query_id, gid, rnk, h.score, coalesce(share, 0) AS n, coalesce(share * exp(-abs(pts_time - pa.start) / 20), 0) AS t FROM h LEFT JOIN sn USING (query_id, video_id) LEFT JOIN pa USING (query_id, video_id)),
md AS (SELECT query_id, gid, rnk AS o, unnest(['video', 'gate', 'time', 'both']) AS mode, unnest([round(score + CAST(0.05 AS DOUBLE) * n, 6), round(score + CAST(0.05 AS DOUBLE) * CASE WHEN n > 0.5 THEN 1 ELSE 0 END, 6), round(score + CAST(0.05 AS DOUBLE) * t, 6), round(score + CAST(0.05 AS DOUBLE) * (n + t), 6)]) AS score FROM hb)
SELECT query_id, mode, gid, score, row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, o) AS rnk FROM md""")
def transcript_bonus(spark, d):
    videos = table(spark, d, "embeddings").agg(F.countDistinct("label").alias("_videos"))  # one row
    said = table(spark, d, "conversations").join(F.broadcast(videos)).select(F.format_string("V%03d", F.col("conv_id") % F.col("_videos")).alias("video"), "turn", (F.col("turn") * 3.0).alias("start"), "text")
    q = dealt(table(spark, d, "benchmark"), spark, d).select((F.col("item_id") % F.col("_queries")).alias("query_id"), "text")
    terms = lexical.query_terms(q, text.tokens(F.col("text")))
    post = said.select("video", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("video", "term").agg(F.count("*").alias("tf"))
    s = lexical.bm25(post, "video", terms).select("query_id", F.col("video").alias("video_id"), F.round("score", 6).alias("s"))
    n = F.broadcast(post.agg(F.countDistinct("video").alias("n")))  # one row
    idf = lexical.frequencies(post).join(n).select("term", lexical.bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    where = lexical.best_passage(said, terms, idf, text.tokens(F.col("text"))).withColumnRenamed("video", "video_id")
    return lexical.transcript_bonus(hits(spark, d), s, where, 0.05, 0.02)


@query("j13_spread_gate", f"WITH {POST}, {BM.replace('K1', '1.2').replace('IDFGATE', 'true')}, r AS (SELECT *, round(score, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm), t AS (SELECT query_id, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM r GROUP BY query_id) SELECT query_id, round((s1 - s2) / s1, 5) AS spread, round((s1 - s2) / s1, 5) >= 0.1 AS open FROM t")
def spread_gate(spark, d):
    s = lexical.bm25_documents(documents(spark, d), "doc_id", text.tokens(F.col("body")), bench_terms(spark, d)).withColumn("s", F.round("score", 6))
    t = topk.top_per_group(s, ["query_id"], [F.desc("s"), F.asc("doc_id")], 2, "r").groupBy("query_id").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("s2"))
    x = F.round((F.col("s1") - F.col("s2")) / F.col("s1"), 5)
    return t.select("query_id", x.alias("spread"), (x >= 0.1).alias("open"))


@query("j14_said_evidence", f"WITH {_SEG}, q AS (SELECT item_id AS query_id, list_distinct({_tok('text')}) AS q FROM benchmark), u AS (SELECT video, turn, list_distinct({_tok('min(text)')}) AS t FROM seg GROUP BY video, turn), m AS (SELECT query_id, video, turn, CAST(len(list_intersect(t, q)) AS BIGINT) AS matched FROM u, q) SELECT query_id, video, turn, matched FROM m WHERE matched >= 2")
def said_evidence(spark, d):
    return _common_terms(spark, d, "matched").where("matched >= 2")


def _common_terms(spark, d, name):
    """(query_id, video, turn, name): how many distinct terms a cue shares with a query, where it shares any."""
    s = segments(spark, d).groupBy("video", "turn").agg(F.min("text").alias("text"))
    hit = s.select("video", "turn", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).join(bench_terms(spark, d).select("query_id", "term"), "term")
    return hit.groupBy("query_id", "video", "turn").agg(F.count("*").alias(name))


@query("j15_speech_extras", f"""WITH {H}, sp AS (SELECT 'V' || lpad(CAST(conv_id % 10 AS VARCHAR), 3, '0') AS video_id, sum(length(text)) AS s FROM conversations GROUP BY 1), q AS (SELECT DISTINCT query_id FROM h), seen AS (SELECT DISTINCT query_id, video_id FROM h WHERE rnk <= 5),
n AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS r FROM q, sp WHERE (query_id, video_id) NOT IN (SELECT query_id, video_id FROM seen)), f AS (SELECT gid, video_id FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY video_id) // 6) AS step FROM k) WHERE (n - 1) % step = 0 AND n - 1 < 6 * step)
SELECT query_id, gid FROM n JOIN f USING (video_id) WHERE r <= 2""")
def speech_extras(spark, d):
    sp = table(spark, d, "conversations").groupBy(F.format_string("V%03d", F.col("conv_id") % 10).alias("video_id")).agg(F.sum(F.length("text")).alias("s"))
    h = hits(spark, d)
    q = h.select("query_id").distinct()
    fresh = q.join(F.broadcast(sp)).join(h.where("rnk <= 5").select("query_id", "video_id").distinct(), ["query_id", "video_id"], "left_anti")  # sp: a row for each of ten videos
    top = topk.top_per_group(fresh, ["query_id"], [F.desc("s"), F.asc("video_id")], 2, "r")
    return top.join(topk.even_sample(keyframes(spark, d), "video_id", "n", 6).select("gid", "video_id"), "video_id").select("query_id", "gid")


@query("j16_answer_in_text", f"WITH {_SEG}, a AS (SELECT video, turn, text, lag(text) OVER w AS p, lead(text) OVER w AS q FROM (SELECT video, turn, min(text) AS text FROM seg GROUP BY video, turn) WINDOW w AS (PARTITION BY video ORDER BY turn)), x AS (SELECT video, turn, lower(concat_ws(' ', p, text, q)) AS t FROM a) SELECT video, turn, contains(t, 'that the') AS phrase, contains(t, 'that') AND contains(t, 'the') AND contains(t, 'was') AS words FROM x")
def answer_in_text(spark, d):
    s = segments(spark, d).groupBy("video", "turn").agg(F.min("text").alias("text"))
    w = Window.partitionBy("video").orderBy("turn")
    t = F.lower(F.concat_ws(" ", F.lag("text").over(w), "text", F.lead("text").over(w)))
    has = lambda x: F.contains(F.col("t"), F.lit(x))
    return s.withColumn("t", t).select("video", "turn", has("that the").alias("phrase"), (has("that") & has("the") & has("was")).alias("words"))


@query("j17_cue_overlap", f"WITH {_SEG}, q AS (SELECT item_id AS query_id, list_distinct({_tok('text')}) AS q FROM benchmark), m AS (SELECT query_id, video, turn, CAST(len(list_intersect(list_distinct({_tok('text')}), q)) AS BIGINT) AS common FROM (SELECT video, turn, min(text) AS text FROM seg GROUP BY video, turn), q) SELECT query_id, video, turn, common FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY common DESC, turn) AS r FROM m WHERE common > 0) WHERE r <= 2")
def cue_overlap(spark, d):
    return topk.top_per_group(_common_terms(spark, d, "common"), ["query_id", "video"], [F.desc("common"), F.asc("turn")], 2, "r").select("query_id", "video", "turn", "common")


@query("j18_new_words", f"WITH t AS (SELECT item_id, list_distinct({_tok('text')}) AS t FROM benchmark) SELECT a.item_id, round(1 - len(list_intersect(a.t, b.t)) / CAST(len(b.t) AS DOUBLE), 6) AS fresh FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def new_words(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    n = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(n, "item_id").select("item_id", F.round(F.size(F.array_except("u", "t")) / F.size("u"), 6).alias("fresh"))


# --- normalisation and fusion


@query("k1_zscore", f"WITH {S} SELECT query_id, gid, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6), 5) AS z FROM s WINDOW w AS (PARTITION BY query_id)")
def zscore(spark, d):
    return fusion.row_zscore(scores(spark, d), ["query_id"], "score", "z", 5).select("query_id", "gid", "z")


CH = f"""{S}, tx AS (SELECT user_id % {N_QUERIES} AS query_id, event_id % {N_ITEMS} AS gid, max(value) AS t FROM events WHERE event_type = 'purchase' GROUP BY ALL), sp AS (SELECT conv_id % {N_QUERIES} AS query_id, turn * 7 AS gid, max(length(text)) AS p FROM conversations GROUP BY ALL),
c AS (SELECT query_id, gid, score, coalesce(t, 0) AS t, CAST(coalesce(p, 0) AS DOUBLE) AS p FROM s LEFT JOIN tx USING (query_id, gid) LEFT JOIN sp USING (query_id, gid)),
z AS (SELECT query_id, gid, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6) AS zs, (t - avg(t) OVER w) / (stddev_pop(t) OVER w + 1e-6) AS zt, (p - avg(p) OVER w) / (stddev_pop(p) OVER w + 1e-6) AS zp, stddev_pop(score) OVER w > 1e-6 AS sa, stddev_pop(t) OVER w > 1e-6 AS ta, stddev_pop(p) OVER w > 1e-6 AS pa, p, t FROM c WINDOW w AS (PARTITION BY query_id))"""


def channels(spark, d):
    """score, t, p of all pairs: a dense visual channel and two sparse ones."""
    tx = dealt(table(spark, d, "events"), spark, d).where("event_type = 'purchase'").groupBy((F.col("user_id") % F.col("_queries")).alias("query_id"), (F.col("event_id") % F.col("_items")).alias("gid")).agg(F.max("value").alias("t"))
    sp = dealt(table(spark, d, "conversations"), spark, d).groupBy((F.col("conv_id") % F.col("_queries")).alias("query_id"), (F.col("turn") * 7).alias("gid")).agg(F.max(F.length("text")).alias("p"))
    items = keyframes(spark, d)
    for c, rows in (("t", tx), ("p", sp)):  # dealt to items, so pairs aren't shuffled
        items = items.join(rows.groupBy("gid").agg(F.collect_list(F.struct("query_id", F.col(c).cast("double"))).alias(c)), "gid", "left")
    return vector.products(fusion.kept(items, "channels"), query_vectors(spark, d), "v", {"score": "qv"}, sparse=("t", "p"))


@query("k2_channel_rows", f"WITH {CH} SELECT query_id, gid, t, p FROM c")
def channel_rows(spark, d):
    return channels(spark, d).select("query_id", "gid", "t", "p")


@query("k3_sparse_cap", f"WITH {CH} SELECT query_id, gid, round(CASE WHEN sum(CASE WHEN p <> 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w / count(*) OVER w < 0.5 AND max(zp) OVER w > 2 THEN zp * 2 / max(zp) OVER w ELSE zp END, 5) AS z, pa AS active FROM z WINDOW w AS (PARTITION BY query_id)")
def sparse_cap(spark, d):
    c = fusion.row_zscore(channels(spark, d), ["query_id"], "p", "z", 12).withColumn("raw", F.col("p"))
    return fusion.cap_sparse(c, ["query_id"], "z", 0.5, 2.0).select("query_id", "gid", F.round("z", 5).alias("z"), "active")


for _mode, _w in fusion.MODES.items():
    _n = " + ".join(f"CASE WHEN {a} THEN CAST({w} AS DOUBLE) ELSE 0 END * {z}" for w, a, z in zip(_w, ("sa", "ta", "pa"), ("zs", "zt", "zp"), strict=True))
    _d = " + ".join(f"CASE WHEN {a} THEN CAST({w} AS DOUBLE) ELSE 0 END" for w, a in zip(_w, ("sa", "ta", "pa"), strict=True))

    @query(f"k4_fuse_{_mode}", f"WITH {CH}, x AS (SELECT query_id, gid, ({_n}) / ({_d}) AS x FROM z) SELECT query_id, gid, round(least(1.2, 1) * x + greatest(CAST(1.2 AS DOUBLE) - 1, 0) * greatest(x, 0), 4) AS fused FROM x")
    def fuse(spark, d, weights=_w):
        c = fusion.row_zscores(channels(spark, d), ["query_id"], {"zs": "score", "zt": "t", "zp": "p"}, 12)
        return c.select("query_id", "gid", F.round(fusion.fuse(c, ["zs", "zt", "zp"], list(weights), F.lit(1.2)), 4).alias("fused"))


@query("k5_video_boost", f"WITH {H}, {_DET}, m AS (SELECT frame, count(DISTINCT cls) AS m FROM d WHERE conf > 0.4 AND cls IN ('purchase', 'error') GROUP BY frame) SELECT query_id, gid, round(score + CAST(0.01 AS DOUBLE) * coalesce(max(m) OVER (PARTITION BY query_id, video_id), 0), 6) AS boosted FROM h LEFT JOIN m ON frame = gid")
def video_boost(spark, d):
    m = detections(spark, d).where(F.col("conf") > 0.4).where(F.col("cls").isin("purchase", "error")).groupBy(F.col("frame").alias("gid")).agg(F.countDistinct("cls").alias("m"))
    return fusion.video_bonus(hits(spark, d).join(m, "gid", "left"), ["query_id", "video_id"], "m", 0.01).select("query_id", "gid", "boosted")


@query("k5b_object_modes", f"WITH {H}, {_DET}, m AS (SELECT frame, count(DISTINCT cls) AS kinds, count(*) AS n FROM d WHERE conf > 0.4 AND cls IN ('purchase', 'error') GROUP BY frame), x AS (SELECT query_id, gid, score, coalesce(kinds, 0) AS kinds, coalesce(m.n, 0) AS n FROM h LEFT JOIN m ON frame = gid) SELECT query_id, gid, round(score + CAST(0.05 AS DOUBLE) * kinds, 6) AS by_match, round(score + CAST(0.05 AS DOUBLE) * least(n, 3), 6) AS by_count, round(score + CAST(0.05 AS DOUBLE) * (kinds + least(n, 3)), 6) AS by_both, kinds > 0 AS passes FROM x")
def object_modes(spark, d):
    m = detections(spark, d).where(F.col("conf") > 0.4).where(F.col("cls").isin("purchase", "error")).groupBy(F.col("frame").alias("gid")).agg(F.countDistinct("cls").alias("kinds"), F.count("*").alias("n_objects"))
    x = hits(spark, d).join(m, "gid", "left").fillna(0, ["kinds", "n_objects"])
    kinds, n = F.col("kinds"), F.least("n_objects", F.lit(3))
    add = lambda b: F.round(F.col("score") + 0.05 * b, 6)
    return x.select("query_id", "gid", add(kinds).alias("by_match"), add(n).alias("by_count"), add(kinds + n).alias("by_both"), (kinds > 0).alias("passes"))


@query("k6_margin", f"""WITH {H}, t AS (SELECT query_id, max(score) AS s1, stddev_pop(score) AS sd FROM h GROUP BY query_id), f AS (SELECT query_id, arg_min(video_id, rnk) AS v FROM h GROUP BY query_id),
o AS (SELECT h.query_id, max(score) AS s2 FROM h JOIN f ON h.query_id = f.query_id AND h.video_id <> f.v GROUP BY h.query_id)
SELECT query_id, round((s1 - s2) / (sd + 1e-6), 5) AS margin, round((s1 - s2) / greatest(abs(s1), 1e-6), 5) AS relative FROM t JOIN o USING (query_id)""")
def margins(spark, d):
    return fusion.margin(hits(spark, d))


@query("k7_verdict_bonus", f"WITH {H}, v AS (SELECT event_id % {N_ITEMS} AS gid, max(value) / 100 AS conf FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT query_id, gid, round(score + CAST(0.02 AS DOUBLE) * coalesce(max(conf) OVER (PARTITION BY query_id, video_id), 0), 6) AS boosted FROM h LEFT JOIN v USING (gid)")
def verdict_bonus(spark, d):
    v = dealt(table(spark, d, "events"), spark, d).where("event_type = 'signup'").groupBy((F.col("event_id") % F.col("_items")).alias("gid")).agg((F.max("value") / 100).alias("conf"))
    return fusion.video_bonus(hits(spark, d).join(v, "gid", "left"), ["query_id", "video_id"], "conf", 0.02).select("query_id", "gid", "boosted")


_HEAD = f"""{H}, c AS (SELECT query_id, gid, rnk, score, (gid * 37 % 101) / CAST(100 AS DOUBLE) AS conf FROM h),
mm AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS norm FROM c WHERE rnk <= HEAD WINDOW w AS (PARTITION BY query_id))"""


def _head(spark, d, head):
    c = hits(spark, d).withColumn("conf", (F.col("gid") * 37 % 101) / 100.0)
    w = Window.partitionBy("query_id", F.col("rnk") <= head)
    return c.withColumn("norm", fusion.minmax(F.col("score"), w, 1.0))


for _name, _n, _wa, _wb in (("k9_verified_head", 3, 0.7, 0.3), ("k10_head_blend", 10, 0.35, 0.65), ("k11_late_blend", 20, 0.4, 0.6)):

    @query(_name, f"WITH {_HEAD.replace('HEAD', str(_n))}, b AS (SELECT query_id, gid, rnk, round(CAST({_wa} AS DOUBLE) * norm + CAST({_wb} AS DOUBLE) * conf, 6) AS blended FROM mm UNION ALL SELECT query_id, gid, rnk, NULL FROM c WHERE rnk > {_n}) SELECT query_id, gid, blended, row_number() OVER (PARTITION BY query_id ORDER BY rnk <= {_n} DESC, blended DESC NULLS LAST, rnk) AS new_rank FROM b")
    def head_blend(spark, d, n=_n, wa=_wa, wb=_wb):
        return fusion.head_blend(_head(spark, d, n), ["query_id"], n, F.col("norm"), F.col("conf"), wa, wb).select("query_id", "gid", "blended", "new_rank")


_R2 = f"{H}, a AS (SELECT query_id, gid, rnk FROM h WHERE rnk <= 100), b AS (SELECT query_id, gid, r2 AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gid * 7919 % 1009, gid) AS r2 FROM h) WHERE r2 <= 100), u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.gid, b.gid) AS gid, coalesce(a.rnk, 1000000) AS ra, coalesce(b.rnk, 1000000) AS rb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.gid = b.gid)"


def two_rankings(spark, d):
    from keymoment.operators.joins import outer_ranks

    h = hits(spark, d)
    other = h.drop("rnk").withColumn("o", F.col("gid") * 7919 % 1009)
    return outer_ranks(h.where("rnk <= 100"), topk.top_per_group(other, ["query_id"], [F.asc("o"), F.asc("gid")], 100), ["query_id", "gid"])


@query("k12_weighted_rrf", f"WITH {_R2}, f AS (SELECT query_id, gid, CAST(0.7 AS DOUBLE) / (60 + ra) + CAST(0.3 AS DOUBLE) / (60 + rb) AS x FROM u) SELECT query_id, gid, round(x / max(x) OVER (PARTITION BY query_id), 6) AS fused FROM f")
def weighted_rrf(spark, d):
    u = two_rankings(spark, d)
    x = u.withColumn("x", fusion.rrf(u, [0.7, 0.3]))
    return x.select("query_id", "gid", F.round(F.col("x") / F.max("x").over(Window.partitionBy("query_id")), 6).alias("fused"))


@query("k13_rrf", f"WITH {_R2} SELECT query_id, gid, round(CAST(1 AS DOUBLE) / (60 + ra) + CAST(1 AS DOUBLE) / (60 + rb), 8) AS rrf60, round(CAST(1 AS DOUBLE) / (1 + ra) + CAST(1 AS DOUBLE) / (1 + rb), 8) AS rrf1, round(CAST(0.5 AS DOUBLE) / (60 + ra) + least(greatest(gid / CAST(2000 AS DOUBLE), 0.2), 0.8) / (60 + rb), 8) AS by_length FROM u")
def rrf(spark, d):
    u = two_rankings(spark, d)
    alpha = F.least(F.greatest(F.col("gid") / 2000.0, F.lit(0.2)), F.lit(0.8))
    return u.select("query_id", "gid", F.round(fusion.rrf(u, [1.0, 1.0]), 8).alias("rrf60"), F.round(fusion.rrf(u, [1.0, 1.0], 1), 8).alias("rrf1"), F.round(fusion.rrf(u, [0.5, alpha]), 8).alias("by_length"))


_PAIR = f"{S}, ab AS (SELECT a.query_id, a.gid, a.video_id, a.n, greatest(a.score, 0) AS a, greatest(b.score, 0) AS b FROM s a JOIN s b ON b.query_id = a.query_id + 1 AND a.gid = b.gid WHERE a.query_id % 2 = 0)"


def twins(spark, d):
    """query_id, qv, qw: queries of an even number with the vector of the next one, whose scores are a and b."""
    q = query_vectors(spark, d)
    return q.where("query_id % 2 = 0").join(q.select((F.col("query_id") - 1).alias("query_id"), F.col("qv").alias("qw")), "query_id")


def pairs(spark, d):
    s = vector.products(keyframes(spark, d), twins(spark, d), "v", {"a": "qv", "b": "qw"})
    return s.select("query_id", "gid", "video_id", "n", *(F.greatest(c, F.lit(0.0)).alias(c) for c in "ab"))


for _how, _x in (("hm", "CASE WHEN a + m <= 1e-12 THEN 0 ELSE 2 * a * m / (a + m) END"), ("product", "a * m"), ("a", "a")):

    @query(f"k14_pairs_{_how}", f"WITH {_PAIR}, m AS (SELECT *, max(b) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS m FROM ab) SELECT query_id, gid, round(CASE WHEN m IS NULL THEN 0 ELSE {_x} END, 6) AS paired FROM m")
    def pair_scores(spark, d, how=_how):
        return fusion.pair_scores(keyframes(spark, d), twins(spark, d), 5, how).select("query_id", "gid", "paired")


@query("k15_rescale", f"WITH {_PAIR} SELECT query_id, gid, round(CAST(0.5 AS DOUBLE) * a + CAST(0.5 AS DOUBLE) * ((b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-6) * stddev_pop(a) OVER w + avg(a) OVER w), 5) AS rescaled FROM ab WINDOW w AS (PARTITION BY query_id)")
def rescale(spark, d):
    return fusion.rescale(pairs(spark, d), ["query_id"], "b", "a", 0.5).select("query_id", "gid", "rescaled")


_B = "(gid * 53 % 97) / CAST(96 AS DOUBLE)"


@query("k16_scene_permutation", f"""WITH {H}, tv AS (SELECT query_id, video_id FROM (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rnk)) AS vr FROM h GROUP BY query_id, video_id) WHERE vr <= 3),
j AS (SELECT query_id, video_id, gid, rnk, score, n, {_B} AS b FROM (SELECT h.*, row_number() OVER (PARTITION BY h.query_id, h.video_id ORDER BY rnk) AS fr FROM h JOIN tv USING (query_id, video_id)) WHERE fr <= 12),
nb AS (SELECT *, CASE WHEN max(b) OVER w - min(b) OVER w > 1e-12 THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END AS bn FROM j WINDOW w AS (PARTITION BY query_id, video_id)),
k2 AS (SELECT *, round(score + bn * (1 - CAST(0.5 AS DOUBLE) * coalesce(lag(bn) OVER (PARTITION BY query_id, video_id ORDER BY n), 0)), 6) AS key FROM nb),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY key DESC, rnk) AS kr, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, rnk) AS sr FROM k2)
SELECT a.query_id, a.gid, a.key, b.score AS permuted FROM r a JOIN r b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.kr = b.sr""")
def scene_permutation(spark, d):
    from keymoment.operators.windows import two_scene_locator

    h = hits(spark, d)
    v = topk.top_per_group(h.groupBy("query_id", "video_id").agg(F.min("rnk").alias("first")), ["query_id"], [F.asc("first")], 3, "vr")
    j = topk.top_per_group(h.join(v, ["query_id", "video_id"]), ["query_id", "video_id"], [F.asc("rnk")], 12, "fr").withColumn("b", F.col("gid") * 53 % 97 / 96.0)
    keys = ["query_id", "video_id"]
    j = j.withColumn("bn", fusion.minmax(F.col("b"), Window.partitionBy(*keys)))
    prev = F.coalesce(F.lag("bn").over(Window.partitionBy(*keys).orderBy("n")), F.lit(0.0))
    j = j.withColumn("key", F.round(F.col("score") + F.col("bn") * (1 - 0.5 * prev), 6))
    return fusion.permute_scores(j, keys, F.col("key")).select("query_id", "gid", "key", "permuted")


@query("k17_permutation", f"WITH {H}, r AS (SELECT query_id, gid, score, row_number() OVER (PARTITION BY query_id, video_id ORDER BY {_B} DESC, rnk) AS kr, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, rnk) AS sr, video_id FROM h) SELECT a.query_id, a.gid, b.score AS permuted FROM r a JOIN r b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.kr = b.sr")
def permutation(spark, d):
    return fusion.permute_scores(hits(spark, d), ["query_id", "video_id"], F.col("gid") * 53 % 97 / 96.0).select("query_id", "gid", "permuted")


@query("k18_scene_candidates", f"WITH {H}, base AS (SELECT query_id, gid, rnk AS pos FROM h WHERE rnk <= 50), b AS (SELECT query_id - 1 AS query_id, gid, rnk FROM h WHERE rnk <= 100 AND query_id > 0), f AS (SELECT b.* FROM b LEFT JOIN base USING (query_id, gid) WHERE pos IS NULL AND b.query_id IN (SELECT query_id FROM base)) SELECT * FROM base UNION ALL SELECT query_id, gid, 50 + row_number() OVER (PARTITION BY query_id ORDER BY rnk) FROM f")
def scene_candidates(spark, d):
    h = hits(spark, d)
    base = h.where("rnk <= 50").select("query_id", "gid", F.col("rnk").alias("pos"))
    b = h.where("rnk <= 100 and query_id > 0").select((F.col("query_id") - 1).alias("query_id"), "gid", "rnk")
    fresh = b.join(base, ["query_id", "gid"], "left_anti")
    return base.unionByName(fresh.select("query_id", "gid", (F.row_number().over(Window.partitionBy("query_id").orderBy("rnk")) + 50).cast("long").alias("pos")))


@query("k21_guaranteed", f"""WITH {H}, hd AS (SELECT query_id, gid, rnk FROM h WHERE rnk <= 60), e AS (SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, gid) AS rnk FROM h), f AS (SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY rnk, gid) AS i FROM e WHERE (query_id, gid) NOT IN (SELECT query_id, gid FROM hd WHERE rnk < 18)),
g AS (SELECT * FROM f WHERE i <= 3), rows AS (SELECT query_id, gid, CASE WHEN rnk < 18 THEN 0 ELSE 2 END AS p, rnk AS o FROM hd WHERE (query_id, gid) NOT IN (SELECT query_id, gid FROM g) UNION ALL SELECT query_id, gid, 1, i FROM g) SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY p, o) AS new_rank FROM rows""")
def guaranteed(spark, d):
    h = hits(spark, d)
    e = h.select("query_id", "gid", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "gid")).alias("rnk"))
    return fusion.insert_guaranteed(h.where("rnk <= 60").select("query_id", "gid", "rnk"), e, ["query_id"], "gid")


@query("k22_scopes", f"""WITH {H}, x AS (SELECT query_id, gid, video_id, rnk, round(score + {_B} / 10, 6) AS s, min(rnk) OVER (PARTITION BY query_id, video_id) AS vf FROM h)
SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rnk) AS all_rank, row_number() OVER (PARTITION BY query_id ORDER BY vf, s DESC, rnk) AS block_rank FROM x""")
def scopes(spark, d):
    w = Window.partitionBy("query_id")
    x = hits(spark, d).withColumn("s", F.round(F.col("score") + F.col("gid") * 53 % 97 / 96.0 / 10, 6)).withColumn("vf", F.min("rnk").over(Window.partitionBy("query_id", "video_id")))
    return x.select("query_id", "gid", F.row_number().over(w.orderBy(F.desc("s"), "rnk")).alias("all_rank"), F.row_number().over(w.orderBy("vf", F.desc("s"), "rnk")).alias("block_rank"))


@query("k23_judged_share", f"WITH {H} SELECT query_id, video_id, round(avg(CASE WHEN {_B} >= 0.6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM h GROUP BY ALL")
def judged_share(spark, d):
    return hits(spark, d).groupBy("query_id", "video_id").agg(F.round(F.avg(F.when(F.col("gid") * 53 % 97 / 96.0 >= 0.6, 1.0).otherwise(0.0)), 6).alias("share"))


@query("k24_consistent_answer", "WITH s AS (SELECT l_orderkey AS q, l_linenumber AS i, l_returnflag AS a FROM lineitem), c AS (SELECT s.q, s.i, s.a, count(*) FILTER (t.i <> s.i AND t.a = s.a) AS agree FROM s JOIN s t ON s.q = t.q GROUP BY s.q, s.i, s.a), f AS (SELECT q, min({'z': agree = 0, 'i': i, 'a': a}) AS m FROM c GROUP BY q) SELECT q, m.a AS answer FROM f")
def consistent_answer(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("a"))
    n = F.min("i").over(Window.partitionBy("q", "a")) != F.max("i").over(Window.partitionBy("q", "a"))  # another sample says the same
    c = s.withColumn("alone", ~n)
    return c.groupBy("q").agg(F.min(F.struct("alone", "i", "a")).alias("m")).select("q", F.col("m.a").alias("answer"))
