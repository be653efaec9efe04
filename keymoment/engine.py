"""One object for a user's round: search, answers and export over tables, with the parts that models give plugged in as functions.

An encoder maps texts to query vectors, hit providers map queries to scores of items (from speech, text in pictures, ...), a matcher
judges answers, a key maps hits to the keys of other tables. All are functions of tables or columns; none is called with collected rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keymoment.functions.text import events_of
from keymoment.operators import align, allocate, evaluate, fusion, topk, vector
from keymoment.sources import sinks

Encoder = Callable[[DataFrame], DataFrame]  # (query_id, text) -> (query_id, qv)
Provider = Callable[[DataFrame], "DataFrame | Shared"]  # (query_id, text) -> (query_id, gid, score), or Shared


def vector_table(table: DataFrame) -> Encoder:
    """An encoder of vectors computed before: table(text, qv)."""
    known = table.groupBy("text").agg(F.min("qv").alias("qv"))
    return lambda queries: queries.join(known, "text").select("query_id", "qv")


def stem_of(video: Column, n: Column) -> Column:
    """The key of a hit in tables of detections and texts: its video and the number of its picture, of three digits or more."""
    return F.concat_ws("/", video, F.lpad(n.cast("string"), 3, "0"))


#: Confidences of items: of (query_id, event_idx, video_id, n, gid), the same rows or some of them with conf.
Verifier = Callable[[DataFrame], DataFrame]


def within(ask: Callable[[str], list[str]], seconds: float, fallback: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A decomposer by `ask`, such as a call of a model, and by `fallback` for a text to which it gives no answer in time, fails, or answers otherwise than with
    a list of texts that aren't blank. Each text has its own thread, so one that hangs holds up no other; it is left behind."""

    def answer(x: str) -> list[str] | None:
        import queue
        import threading

        said: queue.Queue = queue.Queue()

        def call() -> None:
            try:
                said.put(ask(x))
            except Exception:  # an answer that failed is none
                said.put(None)

        threading.Thread(target=call, daemon=True).start()
        try:
            parts = said.get(timeout=seconds)
        except queue.Empty:
            return None
        return parts if isinstance(parts, list) and parts and all(isinstance(p, str) and p.strip() for p in parts) else None

    @F.pandas_udf("array<string>")
    def answers(x: pd.Series) -> pd.Series:
        return x.map(answer, na_action="ignore")

    return lambda text: F.coalesce(answers(text), fallback(text))


class Shared(NamedTuple):
    """What a provider gives whose queries share their scores: members(query_id, m), one row for each query, and scores(m, gid, score) of what they share."""

    members: DataFrame
    scores: DataFrame


@dataclass
class Engine:
    """items: gid, video_id, n, frame_idx, v."""

    items: DataFrame
    encoder: Encoder
    providers: Sequence[tuple[float, Provider]] = ()
    decompose: Callable[[Column], Column] = events_of
    matcher: Callable[[Column, Column], Column] = evaluate.answers_match
    key: Callable[[Column, Column], Column] = stem_of
    verifier: Verifier | None = None
    skip: int = 2
    pool: int = 400
    _last: DataFrame = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._last = self.items.groupBy("video_id").agg(F.max("frame_idx").alias("last_frame"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, gid, video_id, n, frame_idx, score, rnk): the best `pool` items of each query(query_id, text), by the encoder's vectors and
        what providers add, each with its weight on its row of z-scores."""
        live = self.items.where(F.col("n") > self.skip)
        top = vector.top_similar(live, self.encoder(queries), "v", "qv", self.pool).drop("rnk")
        for weight, provider in self.providers:
            given = provider(queries)
            by, found = ("_m", given.scores) if isinstance(given, Shared) else ("query_id", given)
            found = found.groupBy(F.col("m" if by == "_m" else by).alias(by), "gid").agg(F.max("score").alias("_p"))
            z = fusion.row_zscore(found, [by], "_p", "_z").select(by, "gid", "_z")
            if by == "_m":
                top = top.join(given.members.select("query_id", F.col("m").alias("_m")), "query_id", "left")
            top = top.join(z, [by, "gid"], "left").drop("_m").withColumn("score", F.round(F.col("score") + weight * F.coalesce("_z", F.lit(0.0)), 8)).drop("_z")
        ranked = topk.top_per_group(top, ["query_id"], [F.desc("score"), F.asc("gid")], self.pool)
        return ranked.join(live.drop("v"), "gid")

    def sequences(self, queries: DataFrame, events: int = 8, k: int = 20, lam: float = 0.01, gap: int = 2) -> DataFrame:
        """(query_id, video_id, score, gids, rnk) of queries whose texts name events in order, `events` at most."""
        parts = queries.withColumn("_e", self.decompose(F.col("text"))).select("query_id", F.posexplode("_e").alias("event_idx", "text")).where(F.col("event_idx") < events)
        number = F.struct("query_id", "event_idx")
        named = parts.select(F.xxhash64(number).alias("query_id"), F.col("query_id").alias("_q"), "event_idx", "text")
        vectors = self.encoder(named.select("query_id", "text"))
        scores = vector.similarities(self.items.where(F.col("n") > self.skip), vectors, "v", "qv").join(named.select("query_id", "_q", "event_idx"), "query_id")
        rows = scores.select(F.col("_q").alias("query_id"), "video_id", "event_idx", "gid", F.col("n").alias("t"), "score")
        return align.best_videos(align.chain(rows, events, lam, gap), k)

    def verified(self, found: DataFrame, reach: int = 3) -> DataFrame:
        """What sequences() found, ranked anew by the verifier's verdicts on the items within `reach` of a chain's (fusion.rerank_chains). The verifier
        is asked once for each (query, event, item); its confidences are cut to [0, 1], and what it leaves out counts 0."""
        if self.verifier is None:
            raise ValueError("this engine has no verifier")
        items = self.items.select("gid", F.col("video_id").alias("_v"), "n")
        chains = found.select("query_id", "video_id", "rnk", F.posexplode("gids").alias("event_idx", "gid")).join(items, "gid").select("query_id", "video_id", "rnk", "event_idx", "n")
        near = F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("n")
        asked = chains.select("query_id", "event_idx", "video_id", near).distinct().join(items.withColumnRenamed("_v", "video_id"), ["video_id", "n"])
        v = self.verifier(asked).select("query_id", "event_idx", "video_id", "n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf"))).alias("conf"))
        return fusion.rerank_chains(chains, v, reach)

    def joined(self, hits: DataFrame, table: DataFrame) -> DataFrame:
        """Hits with the rows of table(key, ...) of their key."""
        return hits.withColumn("key", self.key(F.col("video_id"), F.col("n"))).join(table, "key", "left")

    def rows(self, hits: DataFrame, how: str = "coverage", budget: int = 100) -> DataFrame:
        """(query_id, rank, video_id, frame) within the budget."""
        c = hits.join(self._last, "video_id").select("query_id", (F.col("rnk") - 1).alias("pos"), "video_id", "frame_idx", "score", "last_frame")
        return allocate.allocate(c, how, budget)

    def score(self, rows: DataFrame, truth: DataFrame) -> DataFrame:
        """(query_id, final_score) of rows, with an answer column or not, against truth(query_id, truth, lo, hi[, answer])."""
        answered = "answer" in rows.columns and "answer" in truth.columns
        x = rows.join(truth.withColumnRenamed("answer", "_answer") if answered else truth, "query_id")
        r = evaluate.moment_score(F.col("video_id"), F.col("frame"), F.col("truth"), F.col("lo"), F.col("hi"))
        if answered:
            r = evaluate.answer_score(r, F.col("answer"), F.col("_answer"), self.matcher)
        return evaluate.final_score(x.withColumn("r", r), ["query_id"], "r", "rank")

    def export(self, rows: DataFrame, names: DataFrame, folder: str) -> DataFrame:
        """Writes ZIPs of answer files, a file for each query of names(query_id, name), and gives (name, bytes) of the ZIPs."""
        from keymoment.sources.files import write_files

        line = sinks.answer_line(F.col("video_id"), F.array("frame"), F.col("answer") if "answer" in rows.columns else None)
        files = rows.groupBy("query_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
        named = files.join(names, "query_id").select(F.col("query_id").alias("pos"), sinks.csv_name(F.col("name")).alias("name"), "content")
        return write_files(sinks.packages(named), folder)
