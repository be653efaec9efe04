"""What an answerer is shown for a query: its best item and the items around it, the best of other videos, and the speech near it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import band
from .topk import top_per_group


def evidence(ranked: DataFrame, items: DataFrame, speech: DataFrame, reach: int = 2, videos: int = 2, head: int = 24, seconds: float = 30.0) -> DataFrame:
    """(query_id, part, pos, video_id, gid, text) of ranked(query_id, gid, video_id, n, pts_time, rnk), items(video_id, n, gid) and speech(video_id, start, no, text).

    Part 1: the best item, then those within reach of it, the nearer first and of two the earlier. Part 2: the first item of each of the next `videos`
    other videos among the first `head`. Part 3: the text of the speech within `seconds` of the best item, in order of start, no and text; a query
    whose item has no speech near it has no such row. Each part meets by equality: place, rank, and (video, piece of time).
    """
    first = ranked.where("rnk = 1").select("query_id", "video_id", F.col("n").alias("_n"), "pts_time")
    steps = [0, *(s * d for d in range(1, reach + 1) for s in (-1, 1))]
    around = first.select("query_id", "video_id", "_n", F.posexplode(F.array(*map(F.lit, steps))).alias("pos", "step"))
    around = around.withColumn("n", F.col("_n") + F.col("step")).join(items.select("video_id", "n", "gid"), ["video_id", "n"])
    none = F.lit(None).cast("string").alias("text")
    frames = around.select("query_id", F.lit(1).alias("part"), "pos", "video_id", "gid", none)
    others = ranked.where(F.col("rnk") <= head).join(first.select("query_id", F.col("video_id").alias("_own")), "query_id").where("video_id <> _own")
    others = top_per_group(others, ["query_id", "video_id"], [F.asc("rnk")], 1, "_r")
    others = top_per_group(others, ["query_id"], [F.asc("rnk")], videos, "pos")
    rest = others.select("query_id", F.lit(2).alias("part"), F.col("pos") - 1, "video_id", "gid", none)
    near = band(first.select("query_id", "video_id", "pts_time"), speech.select("video_id", "start", "no", F.col("text").alias("_t")), ["video_id"], "pts_time", "start", seconds)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "no", "_t"))), lambda x: x["_t"]), " ")
    spoken = near.groupBy("query_id", "video_id").agg(said.alias("text")).select("query_id", F.lit(3).alias("part"), F.lit(0).alias("pos"), "video_id", F.lit(None).cast("long").alias("gid"), "text")
    return frames.unionAll(rest).unionAll(spoken)
