"""Scores of answers, matchers, draws, splits, bootstrap, comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 20, 50, 100)


def rank_bucket(r: Column) -> Column:
    return F.when(r <= 1, "1").when(r <= 5, "2-5").when(r <= 20, "6-20").when(r <= 50, "21-50").when(r <= 100, "51-100").otherwise("later")


def bucket_score(r: Column) -> Column:
    """The share of CUTS that a rank reaches; null: 0."""
    return F.coalesce(sum((F.when(r <= k, 1).otherwise(0) for k in CUTS), F.lit(0)) / len(CUTS), F.lit(0.0))


def r_at_k(df: DataFrame, keys: list[str], r: str, rank: str) -> DataFrame:
    """The largest score among the first k rows, for each k of CUTS; one aggregation."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col(rank) <= k, F.col(r))), F.lit(0.0)).alias(f"r{k}") for k in CUTS])


def final_score(df: DataFrame, keys: list[str], r: str, rank: str) -> DataFrame:
    x = r_at_k(df, keys, r, rank)
    return x.select(*keys, F.round(sum((F.col(f"r{k}") for k in CUTS), F.lit(0.0)) / len(CUTS), 6).alias("final_score"))


def moment_score(video: Column, frame: Column, truth: Column, s: Column, e: Column) -> Column:
    return F.when((video == truth) & frame.between(s, e), 1.0).otherwise(0.0)


def answer_score(moment: Column, answer: Column, truth: Column, matcher: Callable[[Column, Column], Column] | None = None) -> Column:
    """The moment's score where the answers match, by any matcher of two columns; answers_match() without one."""
    return moment * F.when((matcher or answers_match)(answer, truth), 1.0).otherwise(0.0)


def sequence_score(video: Column, frames: Column, truth: Column, spans: Column, strict: bool = False) -> Column:
    """The share of spans (arrays [s, e]) that the frame of their place hits; 0 in another video, and with strict if lengths differ."""
    hit = F.aggregate(F.zip_with(frames, spans, lambda f, w: F.when(f.between(w[0], w[1]), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    same = (video == truth) & ((F.size(frames) == F.size(spans)) if strict else F.lit(True))
    return F.when(same & (F.size(spans) > 0), hit / F.size(spans)).otherwise(0.0)


def answers_match(a: Column, b: Column) -> Column:
    """Equal after cleaning, or one within the other."""
    from keymoment.functions.text import clean_answer

    x, y = clean_answer(a), clean_answer(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | F.contains(x, y) | F.contains(y, x))


def token_subset(x: Column, y: Column) -> Column:
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def jaccard(x: Column, y: Column) -> Column:
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def separation_auc(best: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, auc, rank) of a query's right video among the others of best(query_id, video_id, s); ties count half."""
    x = best.join(right, "query_id")
    good = x.where("video_id = right_video").select("query_id", F.col("s").alias("good"))
    bad = x.where("video_id <> right_video").select("query_id", F.col("s").alias("bad")).join(good, "query_id")
    win = F.when(F.col("good") > F.col("bad"), 1.0).when(F.col("good") == F.col("bad"), 0.5).otherwise(0.0)
    return bad.groupBy("query_id").agg(F.round(F.avg(win), 6).alias("auc"), (F.count_if(F.col("bad") > F.col("good")) + 1).alias("rank"))


def summary(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.round(F.percentile(x, 0.5), 6).alias("median"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.max(x).alias("most"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys score better, the same or worse in b."""
    x = a.withColumnRenamed("score", "_a").join(b.withColumnRenamed("score", "_b"), keys)
    return x.groupBy(F.when(F.col("_b") > F.col("_a"), "better").when(F.col("_b") < F.col("_a"), "worse").otherwise("same").alias("verdict")).agg(F.count("*").alias("n"))


def strict_ranks(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank): one more than the items that score above the best one in truth(query_id, truth, lo, hi); queries without such an item have no row."""
    from .fusion import MOST_GROUPS, kept
    from .vector import broadcast_if_small

    # Both tables have a row for each query at most; the scores stay where they are.
    truth = broadcast_if_small(truth, MOST_GROUPS)
    own = kept(scores.join(truth, "query_id").where("video_id = truth and frame_idx between lo and hi").groupBy("query_id").agg(F.max("score").alias("_a")), "answers")
    return scores.join(broadcast_if_small(own, MOST_GROUPS), "query_id").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("_a")) + 1).alias("rank"))


def product_ranks(items: DataFrame, queries: DataFrame, truth: DataFrame, v: str, vectors: list[str], score: Callable[..., np.ndarray]) -> DataFrame:
    """strict_ranks() of scores that follow from products of items' v with queries' vectors, of each pair or of matrices: the answers alone are scored first, and items
    above them are counted where they are. Unlike the rows of scores, nothing that grows with the pairs is made."""
    from .fusion import MOST_GROUPS, kept
    from .vector import broadcast_if_small, counts_above, scores_of

    queries = kept(queries.select("query_id", *vectors), "queries")
    spans = broadcast_if_small(truth.select("truth", "lo", "hi").distinct(), MOST_GROUPS)  # queries share them
    inside = items.join(spans, (F.col("video_id") == F.col("truth")) & F.col("frame_idx").between(F.col("lo"), F.col("hi"))).select("truth", "lo", "hi", v)
    pairs = truth.join(inside, ["truth", "lo", "hi"]).join(queries, "query_id")
    own = kept(scores_of(pairs, v, vectors, score).groupBy("query_id").agg(F.max("score").alias("_a")), "answers")
    return counts_above(items, queries.join(own, "query_id"), v, vectors, score, "_a").select("query_id", (F.col("above") + 1).alias("rank"))


def rank_table(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: how many queries, their median rank, and how many have their answer first and among the first five."""
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("rank", 0.5).alias("median"), F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("rank") <= 5).alias("top5"))


def first_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, video_changed, row_changed) of the first rows of two runs of (query_id, rank, video_id, frame)."""
    x = a.where("rank = 1").select("query_id", F.col("video_id").alias("_v"), F.col("frame").alias("_f")).join(b.where("rank = 1"), "query_id")
    other = F.col("_v") != F.col("video_id")
    return x.select("query_id", other.alias("video_changed"), (other | (F.col("_f") != F.col("frame"))).alias("row_changed"))


def rerun_flips(a: DataFrame, b: DataFrame, key: str, sample: int = 20, seed: int = 0) -> DataFrame:
    """(sampled_right, sampled_wrong, lost, won): of `sample` answers that run a has right and as many that it has wrong (all, if there are
    fewer), how many another run b of the same thing turns. Runs are (key, right); an answer that b lacks is wrong there. Drawn by hashes of the key."""
    w = Window.partitionBy("right").orderBy(draw(seed, key), key)
    x = a.where("right is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    x = x.join(b.select(key, F.col("right").alias("_again")), key, "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    right, again = F.col("right"), F.col("_again")
    return x.agg(F.count_if(right).alias("sampled_right"), F.count_if(~right).alias("sampled_wrong"), F.count_if(right & ~again).alias("lost"), F.count_if(~right & again).alias("won"))


def missing_extra(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    a = wanted.join(got, key, "left_anti").select(key, F.lit("missing").alias("kind")).distinct()
    return a.unionAll(got.join(wanted, key, "left_anti").select(key, F.lit("extra").alias("kind")).distinct())


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by a hash of keys: the same in every run and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def moment_cells(items: DataFrame, edge: int = 30) -> DataFrame:
    """The frames nearest to each item of its video, [lo, hi): half way to its neighbours, `edge` at the ends."""
    w = Window.partitionBy("video_id").orderBy("n")
    f = F.col("frame_idx")
    lo = F.coalesce(F.floor((f + F.lag("frame_idx").over(w)) / 2), f - edge)
    hi = F.coalesce(F.floor((f + F.lead("frame_idx").over(w)) / 2), f + edge)
    return items.select("gid", "video_id", lo.alias("lo"), hi.alias("hi"))


def drawn_frames(lo: Column, hi: Column, at: Column, u: Column, v: Column, spread: float = 12.0) -> dict[str, Column]:
    """A moment's frame in its item's cell [lo, hi) by four assumptions, from uniform draws u and v in [0, 1): anywhere in the cell, near its
    item's frame `at` (a triangle with its top there), normally around it, or from it on. All stay in the cell, which has one frame at least."""
    hi = F.greatest(lo + 1, hi)
    top = F.least(F.greatest(at, lo), hi - 1)
    inside = lambda x: F.least(F.greatest(x.cast("long"), lo), hi - 1)
    rising = lo + F.sqrt(u * (hi - lo) * (top - lo))
    falling = hi - F.sqrt((1 - u) * (hi - lo) * (hi - top))
    normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.lit(math.pi) * v)
    return {
        "uniform": lo + F.floor(u * (hi - lo)), "triangular": inside(F.when(u * (hi - lo) < top - lo, rising).otherwise(falling)),
        "normal": inside(at + spread * normal), "after": top + F.floor(u * (hi - top)),
    }


def stratified_split(df: DataFrame, stratum: list[str], key: str, seed: int, share: float = 0.5) -> DataFrame:
    """tune for the first `share` of each stratum in hashed order, else test."""
    w = Window.partitionBy(*stratum)
    r = F.row_number().over(w.orderBy(draw(seed, key), key))
    return df.withColumn("part", F.when(r <= F.floor(F.count("*").over(w) * share), "tune").otherwise("test"))


def snake_split(df: DataFrame, block: list[str], score: str, key: str) -> DataFrame:
    """tune for places 0 and 3 modulo 4 of a block in order of score, else test."""
    i = (F.row_number().over(Window.partitionBy(*block).orderBy(F.desc(score), key)) - 1) % 4
    return df.withColumn("part", F.when(i.isin(0, 3), "tune").otherwise("test"))


def bootstrap(df: DataFrame, key: str, x: str, resamples: int, seed: int) -> DataFrame:
    """(mean, low, high, p_not_positive) of resampled means of x: each resample weights rows by Poisson(1) draws of a hash, so
    rows need no indexing and every resample is one grouped sum in the same pass."""
    u = draw(seed, key, "_b")
    k, p, cdf = F.lit(0), 0.36787944117144233, 0.0
    for i in range(0, 8):
        cdf += p
        k = k + F.when(u >= cdf, 1).otherwise(0)
        p /= i + 1
    r = df.select(key, x).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_w", k)
    m = r.groupBy("_b").agg((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias("m"))
    return m.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)), 6).alias("p_not_positive"))
