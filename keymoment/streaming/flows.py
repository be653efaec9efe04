"""Structured Streaming flows. Event-time windows, sessions and watermarks are extras beside batches and incremental caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery


def event_counts(events: DataFrame, every: str = "1 hour", late: str | None = None, ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling counts and sums by key; with `late` rows older than that are dropped once their window is closed."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str | None = None, ts: str = "ts") -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, batch by batch, and ends; a later run goes on where this one stopped."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def batch_sink(path: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of run_available() that adds what a cache at path doesn't hold: one row for each new value of keys, by `transform` if given, which
    keeps the keys and may give several rows or none for one.

    A batch has its own folder, `batch=<id>`, and counts when Spark has marked that folder as whole. A batch that is run again compares itself
    with earlier batches only and takes its own folder's place, so a run that was killed anywhere leaves the rows of one that wasn't. Of rows
    of a batch with equal keys any one stays; keys may be null, and null is a value like others.
    """

    def sink(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(keys)
        known = read_batches(spark, path, before=no)
        if known is not None:
            k = known.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
            same = [fresh[c].eqNullSafe(k[f"_k_{c}"]) for c in keys]
            fresh = fresh.join(k, same, "left_anti")
        (transform(fresh) if transform else fresh).write.mode("overwrite").parquet(f"{path}/batch={no:09d}")

    return sink


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of the whole batches at path, of those before a batch if it is given; None if there is none."""
    from pyarrow import fs

    from keymoment.sources.files import open_folder

    store, base = open_folder(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("batch="))
    whole = store.get_file_info([f"{base}/{n}/_SUCCESS" for n in names])
    names = [n for n, w in zip(names, whole, strict=True) if w.type == fs.FileType.File and (before is None or int(n.removeprefix("batch=")) < before)]
    return spark.read.parquet(*[f"{path}/{n}" for n in names]) if names else None


def gather_prompts(stream: DataFrame, need: int, late: str) -> DataFrame:
    """(query_id, prompts, complete, items) of a stream of prompts (query_id, prompt_no, weight, v, at), once for each query: when `need` prompts
    of it are there, or else when the watermark (the latest `at` less `late`) has passed its last prompt by `late`.

    items holds prompt_no, weight and v by prompt_no; of prompts with one number the first stays. Rows older than the watermark (which begins
    at 1970) are dropped, as are rows without a number, which only carry the time on (a mark of a round's end). A query that was given out and of which more comes
    within that time is given out anew: the sink knows its key.
    """
    item = "struct<prompt_no: long, weight: double, v: array<double>>"
    # one flat array of all vectors is kept: prompts have vectors of one length
    kept = "nos array<long>, weights array<double>, flat array<double>, due long"
    wait = _millis(late)

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        nos, weights, flat, due = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], [], 0)
        over = state.hasTimedOut
        for pdf in pdfs if not over else ():
            for no, weight, v, at in zip(pdf["prompt_no"], pdf["weight"], pdf["v"], pdf["ms"], strict=True):
                if not pd.isna(no) and int(no) not in nos:
                    nos.append(int(no))
                    weights.append(float(weight))
                    flat.extend(float(x) for x in v)
                    due = max(due, int(at) + wait)
        if nos and (over or len(nos) >= need):
            state.remove()
            n = len(flat) // len(nos)
            rows = sorted(zip(nos, weights, (flat[i * n : i * n + n] for i in range(len(nos))), strict=True))
            yield pd.DataFrame({"query_id": [key[0]], "prompts": [len(nos)], "complete": [len(nos) >= need], "items": [[dict(zip(("prompt_no", "weight", "v"), r, strict=True)) for r in rows]]})
        elif nos:
            state.update((nos, weights, flat, due))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    s = stream.select("query_id", "prompt_no", "weight", "v", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return s.groupBy("query_id").applyInPandasWithState(step, f"query_id long, prompts long, complete boolean, items array<{item}>", kept, "append", GroupStateTimeout.EventTimeTimeout)


def _millis(duration: str) -> int:
    """A length of time such as '1 hour' in milliseconds."""
    return int(pd.Timedelta(duration).total_seconds() * 1000)
