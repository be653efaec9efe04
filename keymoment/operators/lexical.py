"""Lexical retrieval over postings tables: BM25 and its relatives, passages, phrases.

Queries' terms are joined to postings on the term before anything is summed, so only the postings of query terms are
touched; a hot term's postings are split by adaptive execution and its sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Terms of queries that are sent to the tasks; more are joined by a shuffle.
MOST_TERMS = 1_000_000


def postings(docs: DataFrame, key: str, tokens: Column, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf) of documents; with terms(term) only theirs, so other words go before anything is shuffled."""
    from .vector import broadcast_if_small

    rows = docs.select(key, F.explode(tokens).alias("term"))
    if terms is not None:
        rows = rows.join(broadcast_if_small(terms.select("term").distinct(), MOST_TERMS), "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def text_lengths(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """lengths() straight from documents."""
    return docs.select(key, F.size(tokens).alias("dl")).where("dl > 0").groupBy(key).agg(F.sum("dl").alias("dl"))


def lengths(post: DataFrame, key: str) -> DataFrame:
    return post.groupBy(key).agg(F.sum("tf").alias("dl"))


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # counted by tf, so that this branch can share the postings' exchange


def collection(dl: DataFrame) -> DataFrame:
    """One row: how many documents, and their mean length."""
    return dl.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(post: DataFrame, key: str, terms: DataFrame, k1: float = 1.2, b: float = 0.75, idf_over: float | None = None, least_terms: int = 1, dl: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, matched) of terms(query_id, term, qtf) against postings; idf_over drops common terms. Postings of the terms
    alone need dl, the documents' lengths. Queries come to a document's postings, which are dealt by document, so what they hit isn't shuffled."""
    from .vector import broadcast_if_small

    dl = lengths(post, key) if dl is None else dl
    stats = F.broadcast(collection(dl))  # one row
    idf = frequencies(post).join(stats).withColumn("idf", bm25_idf(F.col("n_docs"), F.col("df"))).select("term", "idf", "avg_dl")
    if idf_over is not None:
        idf = idf.where(F.col("idf") > idf_over)
    q = terms.join(idf, "term")
    q = F.broadcast(q) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else q
    hit = post.join(dl.hint("merge"), key).join(q, "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    out = hit.groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return out.where(F.col("matched") >= least_terms)


def bm25_documents(docs: DataFrame, key: str, tokens: Column, terms: DataFrame, k1: float = 1.2, b: float = 0.75, idf_over: float | None = None, least_terms: int = 1) -> DataFrame:
    """bm25() straight from documents, for when postings aren't kept.

    Documents are read and cut into words once: each gives its query terms, other words go before anything is shuffled, and an empty
    term that carries its length to the collection's statistics. Both come from one exchange, as the condition that tells them apart is on
    an aggregate.
    """
    from .vector import broadcast_if_small

    t = docs.select(key, F.concat(F.array(F.lit("")), tokens).alias("_t")).withColumn("dl", F.size("_t") - 1)
    wanted = terms.select("term").distinct()
    wanted = broadcast_if_small(wanted.unionAll(wanted.sparkSession.createDataFrame([("",)], "term string")), MOST_TERMS)
    own = F.sum(F.when(F.col("term") == "", 0).otherwise(1))
    rows = t.select(key, "dl", F.explode("_t").alias("term")).join(wanted, "term", "left_semi").groupBy(key, "term").agg(own.alias("tf"), F.first("dl").alias("dl"))
    hit = rows.where("tf > 0")
    stats = F.broadcast(rows.where("tf = 0 and dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")))  # one row
    df = hit.groupBy("term").agg(F.count("dl").alias("df"))  # counted by dl, so this branch reads the same columns and shares the exchange
    idf = df.join(stats).withColumn("idf", bm25_idf(F.col("n_docs"), F.col("df"))).select("term", "idf", "avg_dl")
    if idf_over is not None:
        idf = idf.where(F.col("idf") > idf_over)
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    out = hit.join(terms.join(idf, "term"), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return out.where(F.col("matched") >= least_terms)


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def best_passage(cues: DataFrame, terms: DataFrame, idf: DataFrame, tokens: Column, width: int = 5, most: int = 3) -> DataFrame:
    """(query_id, video, start, passage, value): of each video the window of `width` cues with the largest sum of idf * min(tf, 3) *
    qtf, the earliest on ties; start is that of its first cue with a term. Needs cues(video, turn, start, text) and
    idf(term, idf). Term counts of a window are sums over its cues' hits, found by an equi-join on the term."""
    hit = cues.select("video", "turn", "start", F.explode(tokens).alias("term")).groupBy("video", "turn", "start", "term").agg(F.count("*").alias("tf"))
    q = terms.join(idf, "term")
    hit = hit.join(F.broadcast(q) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else q, "term")  # a common term is no single task
    first = F.explode(F.sequence(F.greatest(F.col("turn") - width + 1, F.lit(0)), F.col("turn"))).alias("first")
    win = hit.select("query_id", "video", "term", "qtf", "idf", "tf", "start", first).groupBy("query_id", "video", "first", "term").agg(F.sum("tf").alias("tf"), F.max("qtf").alias("qtf"), F.max("idf").alias("idf"), F.min("start").alias("start"))
    value = win.groupBy("query_id", "video", "first").agg(F.round(F.sum(F.col("idf") * F.least("tf", F.lit(most)) * F.col("qtf")), 6).alias("value"), F.min("start").alias("start"))
    w = Window.partitionBy("query_id", "video").orderBy(F.desc("value"), "first")
    return value.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "video", "first", "start", "value")


def phrase_search(texts: DataFrame, key: str, queries: DataFrame, weight: float = 10.0) -> DataFrame:
    """(query_id, key, score): weight if the whole phrase of queries(query_id, phrase) is in a text, plus 1 for each of its terms in it, above 0.

    Phrases and terms are found by contained(), each text read once; an empty phrase is in no text.
    """
    q = queries.select("query_id", F.lower("phrase").alias("phrase")).where("phrase <> ''")
    terms = q.select("query_id", F.explode(F.filter(F.split("phrase", r"\s+"), lambda t: t != "")).alias("phrase"), F.lit(1.0).alias("_w"))
    weights = terms.unionAll(q.withColumn("_w", F.lit(weight))).groupBy("query_id", "phrase").agg(F.sum("_w").alias("_w"))
    found = contained(texts.withColumn("_low", F.lower("text")), key, "_low", weights)
    return found.join(weights, "phrase").groupBy("query_id", key).agg(F.sum("_w").alias("score"))


def contained(texts: DataFrame, key: str, text: str, phrases: DataFrame, most: int = 100_000) -> DataFrame:
    """(key, phrase) of the phrases (a table with that column, no nulls) that stand anywhere in a text. Phrases go with the tasks in blocks
    of `most`, as counted; a text is read once for a block, by an automaton of all its phrases. A null text holds none."""
    import ahocorasick
    import pyarrow as pa

    from .vector import query_blocks

    schema = texts.select(key).schema.add("phrase", "string")
    found = None
    for block in query_blocks(phrases.select("phrase").where("phrase <> ''").distinct(), "phrase", most):
        held = [r[0] for r in block.collect()]

        def run(batches, held: list[str] = held):
            find = ahocorasick.Automaton()
            for p in held:
                find.add_word(p, p)
            find.make_automaton()
            for batch in batches:
                at, out = [], []
                for i, t in enumerate(batch.column(1).to_pylist() if held else ()):
                    own = {p for _, p in find.iter(t)} if t else ()
                    at += [i] * len(own)
                    out += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=[key, "phrase"])

        x = texts.select(key, text).mapInArrow(run, schema)
        found = x if found is None else found.unionAll(x)
    return found


#: The weights of three, two and one word in a title, in tags and in a description, and the description's factor.
FIELD_WEIGHTS = {3: (4.0, 2.5, 1.0), 2: (2.0, 1.2, 0.5), 1: (0.5, 0.25, 0.15)}
FIELDS, DESCRIPTION_FACTOR = ("title", "tags", "description"), 3.0


def word_runs(words: Column, n: int) -> Column:
    """The runs of n words of an array, with a blank between, repeats included; fewer words have none. A null array has none."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def field_boost(docs: DataFrame, key: str, queries: DataFrame, stop: tuple[str, ...] = (), scale: float = 0.02, top: float = 0.035) -> DataFrame:
    """(query_id, key, boost): tanh(scale * x) * top, above 0, where x sums over a query's runs of one to three words.

    A run counts in the first of title, tags and description (columns of docs, cleaned by text.plain_words; null: empty) that holds it, with
    the weight of its length and that field and its inverse frequency over docs; a run that is no run of whole words of any document counts as 1 there. Runs of two
    and three words may stand anywhere in a field, within words too; single words are whole words. queries has query_id and words;
    a run that a query repeats counts as often. `stop` are words without a frequency.
    """
    from keymoment.functions.text import let
    runs = lambda words: let(words, lambda w: F.concat(*[word_runs(w, n) for n in FIELD_WEIGHTS]))
    size = F.size(F.split("run", " ")).alias("size")
    asked = queries.select("query_id", F.explode(runs(F.col("words"))).alias("run")).groupBy("query_id", "run").agg(F.count("*").alias("times")).withColumn("size", size)
    asked = asked.withColumn("phrase", F.when(F.col("size") == 1, F.concat(F.lit(" "), "run", F.lit(" "))).otherwise(F.col("run")))
    filled = docs.select(key, *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])
    own = runs(F.filter(F.split(F.concat_ws(" ", *FIELDS), " "), lambda w: w != ""))
    held = filled.select(F.explode(F.array_distinct(own)).alias("run")).where(F.contains("run", F.lit(" ")) | ((F.length("run") >= 2) & ~F.col("run").isin(*stop)))
    df = held.join(asked.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    idf = df.join(n).select("run", bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    weights = F.array(*[F.array(*map(F.lit, FIELD_WEIGHTS[i])) for i in sorted(FIELD_WEIGHTS)])
    weighted = asked.join(idf, "run", "left").select("query_id", "phrase", (F.coalesce("idf", F.lit(1.0)) * F.col("times")).alias("_w"), F.element_at(weights, F.col("size")).alias("_by"))
    each = F.explode(F.array(*[F.struct(F.col(key).alias("key"), F.lit(i).alias("field"), F.concat(F.lit(" "), f, F.lit(" ")).alias("text")) for i, f in enumerate(FIELDS)])).alias("x")
    texts = filled.select(each).select(F.struct("x.key", "x.field").alias("at"), F.col("x.text").alias("text"))
    found = contained(texts, "at", "text", asked).groupBy(F.col("at.key").alias(key), "phrase").agg(F.min("at.field").alias("field"))
    part = F.col("_w") * F.element_at("_by", F.col("field") + 1) * F.when(F.col("field") == len(FIELDS) - 1, DESCRIPTION_FACTOR).otherwise(1.0)
    return found.join(weighted, "phrase").groupBy("query_id", key).agg(F.round(F.tanh(scale * F.sum(part)) * top, 8).alias("boost"))


def idf_sum(post: DataFrame, key: str, terms: DataFrame, scale: float = 0.15, n: DataFrame | None = None) -> DataFrame:
    """tanh(scale * sum of idf) over a query's terms in a document, idf = ln(1 + n / (1 + df)). Postings of the terms alone need n, a row with
    n_docs. Queries come to a document's postings, as in bm25()."""
    n = F.broadcast(post.agg(F.countDistinct(key).alias("n_docs")) if n is None else n)
    idf = frequencies(post).join(n).select("term", F.log(1 + F.col("n_docs") / (1 + F.col("df"))).alias("idf"))
    q = terms.select("query_id", "term").distinct().join(idf, "term")
    q = F.broadcast(q) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else q
    return post.repartition(key).join(q, "term").groupBy("query_id", key).agg(F.round(F.tanh(scale * F.sum("idf")), 6).alias("score"))


def speech_decay(hits: DataFrame, cues: DataFrame, halflife: float, weight: float = 1.0) -> DataFrame:
    """bonus of hits(video, at) from the nearest cue (video, start, s): weight * s * exp(-distance / halflife)."""
    from .joins import nearest

    n = nearest(hits, cues, ["video"], "at", "start", ["hit"], ["s"], 64 * halflife)
    return n.select("hit", F.round(weight * F.col("s") * F.exp(-F.col("distance") / halflife), 6).alias("bonus"))


#: How a transcript raises hits: by its video's score, by whether that is over half of the best, by the distance from its passage, by the first and the third.
TRANSCRIPT_MODES = ("video", "gate", "time", "both")


def transcript_bonus(hits: DataFrame, videos: DataFrame, passages: DataFrame, weight: float, least_spread: float = 0.0, halflife: float = 20.0) -> DataFrame:
    """(query_id, mode, gid, score, rnk): hits (query_id, gid, video_id, pts_time, score, rnk) raised in each of TRANSCRIPT_MODES and ranked anew, ties by rnk.

    videos(query_id, video_id, s) are the transcripts' scores, taken as shares of a query's best; passages(query_id, video_id, start) say where
    a video speaks of it. A query whose best two videos differ by less than `least_spread` of the best (one video: 0) keeps its scores, as
    does one without transcripts.
    """
    best = videos.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).where("_r <= 2")
    q = best.groupBy("query_id").agg(F.max("s").alias("_top"), F.max(F.when(F.col("_r") == 2, F.col("s"))).alias("_next")).where(F.col("_top") > 0)
    spread = F.when(F.col("_next").isNull(), 0.0).otherwise((F.col("_top") - F.col("_next")) / F.col("_top"))
    q = q.where(F.round(spread, 6) >= least_spread)
    share = videos.join(q, "query_id").select("query_id", "video_id", (F.col("s") / F.col("_top")).alias("_n"))
    x = hits.join(share, ["query_id", "video_id"], "left").join(passages.select("query_id", "video_id", "start"), ["query_id", "video_id"], "left")
    n = F.coalesce("_n", F.lit(0.0))
    near = F.coalesce(n * F.exp(-F.abs(F.col("pts_time") - F.col("start")) / halflife), F.lit(0.0))
    bonus = {"video": n, "gate": F.when(n > 0.5, 1.0).otherwise(0.0), "time": near, "both": n + near}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.round(F.col("score") + weight * bonus[m], 6).alias("score")) for m in TRANSCRIPT_MODES])).alias("x")
    x = x.select("query_id", "gid", F.col("rnk").alias("_o"), each).select("query_id", "x.mode", "gid", "x.score", "_o")
    return x.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("score"), "_o"))).drop("_o")
