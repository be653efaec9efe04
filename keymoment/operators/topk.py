"""Sorts, limits, top-k by group, pooling, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rnk") -> DataFrame:
    """The first k rows of each group; the rank filter becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def pool_top3(hits: DataFrame, keys: list[str], weights: tuple[float, float, float] = (0.75, 0.20, 0.05)) -> DataFrame:
    """Convex pooling of a group's three best scores; two give 0.75 and 0.25, one stands alone."""
    top = top_per_group(hits, keys, [F.desc("score"), F.asc("gid")], 3, "_r")
    s = [F.max(F.when(F.col("_r") == i, F.col("score"))) for i in (1, 2, 3)]
    pooled = F.when(s[1].isNull(), s[0]).when(s[2].isNull(), 0.75 * s[0] + 0.25 * s[1]).otherwise(weights[0] * s[0] + weights[1] * s[1] + weights[2] * s[2])
    return top.groupBy(*keys).agg(F.round(pooled, 6).alias("pooled"))


def density_bonus(hits: DataFrame, keys: list[str], share: float = 0.91, most: int = 8, scale: float = 0.015 / 3) -> DataFrame:
    """log2(1 + how many of a group reach a share of its best, at most `most`) for groups of two or more."""
    best = hits.groupBy(*keys).agg(F.max("score").alias("_best"), F.count("*").alias("_n"))
    near = hits.join(best, keys).groupBy(*keys).agg(F.count_if(F.col("score") >= share * F.col("_best")).alias("near"), F.max("_n").alias("_n"))
    return near.select(*keys, "near", F.round(F.when(F.col("_n") >= 2, F.log2(1 + F.least("near", F.lit(most))) * scale).otherwise(0.0), 6).alias("bonus"))


def _in_order(hits: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group with its rows as an array (_g), in order of score, ties to the smaller gid; _i is a row's place."""
    row = F.struct((-F.col("score")).alias("_s"), F.col("gid").alias("_o"), *hits.columns)
    g = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_g"))
    return g.select(F.transform("_g", lambda x, i: x.withField("_i", i)).alias("_g"))


def _greedy(rows: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The rows that keep(kept so far, row) holds for, one after another; the kept ones are the state of one fold."""
    return F.aggregate(rows, F.filter(rows, lambda x: F.lit(False)), lambda kept, x: F.when(keep(kept, x), F.array_append(kept, x)).otherwise(kept))


def nms(hits: DataFrame, keys: list[str], gap: int, cap: int | None = None, seconds: bool = True) -> DataFrame:
    """Greedy suppression in score order within a group: a row goes if a kept one is within gap in n, or max(2 * gap, 10) in
    pts_time where seconds holds; cap bounds the kept ones. Groups are one query's rows of one video, bounded by its length."""

    def near(x: Column, y: Column) -> Column:
        by_place = F.abs(x["n"] - y["n"]) <= gap
        return by_place | (F.abs(x["pts_time"] - y["pts_time"]) <= max(2 * gap, 10)) if seconds else by_place

    def keep(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda y: near(x, y))
        return free if cap is None else (F.size(kept) < cap) & free

    return _in_order(hits, keys).select(F.explode(_greedy(F.col("_g"), keep)).alias("x")).select(*(F.col(f"x.{c}") for c in hits.columns))


def spread(hits: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    """Rows in score order; those within min_gap frames of a kept row of their video come after all kept ones. Adds pos."""
    apart = lambda kept, x: ~F.exists(kept, lambda y: (y["video_id"] == x["video_id"]) & (F.abs(x["frame_idx"] - y["frame_idx"]) < min_gap))
    g = _in_order(hits, keys).withColumn("_k", _greedy(F.col("_g"), apart)).withColumn("_p", F.transform("_k", lambda y: y["_i"]))
    later = F.filter("_g", lambda x: ~F.array_contains("_p", x["_i"]))
    return g.select(F.posexplode(F.concat("_k", later)).alias("p", "x")).select(*(F.col(f"x.{c}") for c in hits.columns), (F.col("p") + 1).cast("long").alias("pos"))


def suppress_similar(hits: DataFrame, keys: list[str], v: str, most: float = 0.90, memory: int = 200, top: int = 50) -> DataFrame:
    """Rows in score order without those whose cosine with one of the last `memory` kept ones reaches `most`; at most `top`."""
    from .vector import dot, unit

    last = lambda kept: F.slice(kept, F.greatest(F.size(kept) - memory + 1, F.lit(1)), memory)
    keep = lambda kept, x: (F.size(kept) < top) & ~F.exists(last(kept), lambda y: dot(y["_u"], x["_u"]) >= most)
    rows = _in_order(hits.withColumn("_u", unit(F.col(v), 1e-12)), keys)
    return rows.select(F.explode(_greedy(F.col("_g"), keep)).alias("x")).select(*(F.col(f"x.{c}") for c in hits.columns))


def expand_neighbours(hits: DataFrame, items: DataFrame, v: str, seeds: int = 10, seed_score: float = 0.16, reach: int = 4, least: float = 0.14, cosine: float = 0.55, per_seed: int = 2) -> DataFrame:
    """The best neighbours of each query's first hits: within reach items, scoring `least`, at a cosine of the seed of `cosine`;
    ordered by score + 0.04 * cosine, per_seed for each. One equi-join on the video with a bounded band."""
    from .vector import dot, norm

    seed = hits.where((F.col("rnk") <= seeds) & (F.col("score") >= seed_score)).select("query_id", "video_id", F.col("gid").alias("seed_gid"), F.col("n").alias("seed_n"), F.col("rnk").alias("seed_rank"))
    seed = seed.join(items.select(F.col("gid").alias("seed_gid"), F.col(v).alias("_sv")), "seed_gid").withColumn("n", F.explode(F.array([F.col("seed_n") + d for d in range(-reach, reach + 1) if d])))
    near = seed.join(items.select("video_id", "n", "gid", "frame_idx", F.col(v).alias("_nv")), ["video_id", "n"])
    near = near.withColumn("cosine", F.round(dot(F.col("_sv"), F.col("_nv")) / (norm(F.col("_sv")) * norm(F.col("_nv"))), 6)).where(F.col("cosine") >= cosine)
    own = hits.select("query_id", "gid", "score")
    near = near.join(own, ["query_id", "gid"]).where(F.col("score") >= least).withColumn("composite", F.round(F.col("score") + 0.04 * F.col("cosine"), 6))
    return top_per_group(near.drop("_sv", "_nv"), ["query_id", "seed_gid"], [F.desc("composite"), F.asc("gid")], per_seed, "place")


def even_sample(items: DataFrame, group: str, order: str, n: int = 6) -> DataFrame:
    """Every step-th item of a group, step = max(1, size // n), n at most."""
    w = Window.partitionBy(group)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n))
    i = F.row_number().over(w.orderBy(order)) - 1
    return items.withColumn("_i", i).withColumn("_s", step).where((F.col("_i") % F.col("_s") == 0) & (F.col("_i") < n * F.col("_s"))).drop("_i", "_s")


def batches(values: Iterator[int], size: int) -> Iterator[list[int]]:
    held: list[int] = []
    for x in values:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
