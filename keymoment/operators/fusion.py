"""Normalisation, fusion of channels, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import gathered
from .vector import broadcast_if_small, vector_sum

#: Weights of the visual, text and speech channels by mode.
MODES = {"visual": (1.0, 0.0, 0.0), "balanced": (0.70, 0.15, 0.15), "text_heavy": (0.40, 0.40, 0.20), "speech": (0.50, 0.10, 0.40)}


#: Groups whose aggregates go with the tasks; more are joined by a shuffle.
MOST_GROUPS = 500_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written while the plan is built, as it is read more than once; the caller's cluster clears the folder."""
    from keymoment.sources.files import shared_folder, swept

    path = shared_folder(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """df with aggregates of its groups as columns. The aggregates are combined in map tasks, written, counted, and joined back where the rows
    are, so a group of any size (all scores of a query) is neither gathered, as a window over it would be, nor shuffled."""
    return df.join(broadcast_if_small(kept(df.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items())), "stats"), MOST_GROUPS), keys)


def row_zscores(df: DataFrame, keys: list[str], columns: dict[str, str], digits: int = 6) -> DataFrame:
    """For each out: x of columns the z-score of x in its row as `out`, and whether x varies there as `out`_active; one aggregation for all."""
    stats = {f"_{k}_{out}": f(x) for out, x in columns.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))}
    d = with_stats(df, keys, **stats)
    z = [F.round((F.col(x) - F.col(f"_m_{out}")) / (F.col(f"_s_{out}") + 1e-6), digits).alias(out) for out, x in columns.items()]
    return d.select(*df.columns, *z, *((F.col(f"_s_{out}") > 1e-6).alias(f"{out}_active") for out in columns))


def row_zscore(df: DataFrame, keys: list[str], x: str, out: str, digits: int = 6) -> DataFrame:
    return row_zscores(df, keys, {out: x}, digits).drop(f"{out}_active")


def minmax(x: Column, w: Window, alone: float = 0.0) -> Column:
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo > 1e-12, (x - lo) / (hi - lo)).otherwise(alone)


def margin(hits: DataFrame) -> DataFrame:
    """margin: (best - best of other videos) / deviation; relative: the same over |best|. Two aggregations by query."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("s1"), F.stddev_pop("score").alias("sd"), F.min_by("video_id", "rnk").alias("v"))
    other = hits.join(top.select("query_id", "v"), "query_id").where(F.col("video_id") != F.col("v")).groupBy("query_id").agg(F.max("score").alias("s2"))
    gap = F.col("s1") - F.col("s2")
    return top.join(other, "query_id").select("query_id", F.round(gap / (F.col("sd") + 1e-6), 5).alias("margin"), F.round(gap / F.greatest(F.abs("s1"), F.lit(1e-6)), 5).alias("relative"))


def hub_corrected(scores: DataFrame, k: float, head: int = 400) -> DataFrame:
    """The first `head` items of each query by rank plus k times the z-score of an item's mean score over all queries: hubs go down.

    An item of old rank r has a key of r + k * (least z) or more, and `head` items have head + k * (largest z) or less, so only the first
    head + k * (largest z - least z) of each query by score can be among the result and are ranked anew.
    """
    from .topk import top_per_group

    bias = scores.groupBy("gid").agg(F.avg("score").alias("_b"))
    m = bias.agg(F.avg("_b").alias("_m"), F.stddev_pop("_b").alias("_s"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi")).first()
    if m["_m"] is None:
        return scores.withColumn("old_rank", F.lit(None).cast("long")).withColumn("new_rank", F.lit(None).cast("long"))
    deviation = m["_s"] + 1e-6
    reach = head + int(abs(k) * (m["_hi"] - m["_lo"]) / deviation) + 1
    r = top_per_group(scores, ["query_id"], [F.desc("score"), F.asc("gid")], reach, "old_rank").join(bias, "gid")
    key = F.round(F.col("old_rank") + k * (F.col("_b") - m["_m"]) / deviation, 4)
    return top_per_group(r.withColumn("_key", key), ["query_id"], [F.asc("_key"), F.asc("old_rank")], head, "new_rank").drop("_b", "_key")


def feedback(items: DataFrame, queries: DataFrame, m: int, skip: int = 2) -> DataFrame:
    """queries(query_id, qv) with centre: the mean of a query's best m items(gid, video_id, n, v) outside the video of its best one and outside the videos'
    openings. Queries without such an item go."""
    from .vector import top_similar

    flat = items.select("gid", "video_id", "n", "v")
    shown = flat.where(F.col("n") > skip)
    queries = kept(queries.select("query_id", "qv"), "queries")
    first = top_similar(shown, queries, "v", "qv", 1).join(flat.select("gid", "video_id"), "gid").select("query_id", F.col("video_id").alias("_out"))
    fed = top_similar(shown, kept(queries.join(first, "query_id"), "best"), "v", "qv", m, group="video_id", without="_out").select("query_id", "gid")
    n = fed.groupBy("query_id").agg(F.count("*").alias("_n"))
    c = kept(vector_sum(fed.join(n, "query_id").join(items.select("gid", "v"), "gid"), ["query_id"], "v", 1 / F.col("_n"), "centre"), "centres")
    return queries.join(c, "query_id")


def rocchio(items: DataFrame, queries: DataFrame, m: int, weight: float, skip: int = 2) -> DataFrame:
    """(query_id, gid, score): score + weight * (centre . v) of every item for queries, with the centres of feedback()."""
    from .vector import products

    both = products(items.select("gid", "v"), feedback(items, queries, m, skip), "v", {"_s": "qv", "_f": "centre"}, digits=None)
    return both.select("query_id", "gid", F.round(F.round("_s", 6) + weight * F.col("_f"), 5).alias("score"))


def cap_sparse(df: DataFrame, keys: list[str], x: str, share: float = 0.01, peak: float = 6.0) -> DataFrame:
    """A row of z-scores with fewer than `share` of non-zero raw values is scaled so that it peaks at `peak`, if it peaks higher. Needs raw."""
    d = with_stats(df, keys, _some=F.avg(F.when(F.col("raw") != 0, 1.0).otherwise(0.0)), _top=F.max(x), _sd=F.stddev_pop("raw"))
    capped = F.when((F.col("_some") < share) & (F.col("_top") > peak), F.col(x) * peak / F.col("_top")).otherwise(F.col(x))
    return d.withColumn(x, capped).withColumn("active", F.col("_sd") > 1e-6).drop("_some", "_top", "_sd")


def fuse(df: DataFrame, channels: list[str], weights: list[float], event_weight: Column | None = None) -> Column:
    """Weighted mean of the channels that are active (columns <channel> and <channel>_active), then the event's weight:
    under 1 it shrinks the row, over 1 it raises what is above zero."""
    on = [F.when(F.col(f"{c}_active"), F.lit(w)).otherwise(0.0) for c, w in zip(channels, weights, strict=True)]
    num, den = sum((o * F.col(c) for o, c in zip(on, channels, strict=True)), F.lit(0.0)), sum(on, F.lit(0.0))
    x = F.when(den > 0, num / den).otherwise(0.0)
    if event_weight is None:
        return x
    return F.least(event_weight, F.lit(1.0)) * x + F.greatest(event_weight - 1, F.lit(0.0)) * F.greatest(x, F.lit(0.0))


def rrf(ranks: DataFrame, weights: list[float], k0: int = 60, missing: int = 1_000_000) -> Column:
    """Reciprocal rank fusion of columns rank_a, rank_b, ..."""
    names = [c for c in ranks.columns if c.startswith("rank_")]
    return sum((w / (k0 + F.coalesce(F.col(c), F.lit(missing))) for w, c in zip(weights, names, strict=True)), F.lit(0.0))


def head_blend(df: DataFrame, keys: list[str], head: int, a: Column, b: Column, wa: float, wb: float) -> DataFrame:
    """blended: wa * a + wb * b for the first `head` ranks, the others' score below all of them; new_rank orders them."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("_h", F.col("rnk") <= head).withColumn("blended", F.round(F.when(F.col("_h"), wa * a + wb * b), 6))
    return x.withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("_h"), F.desc_nulls_last("blended"), "rnk"))).drop("_h")


def permute_scores(df: DataFrame, keys: list[str], key: Column, score: str = "score", pos: str = "rnk") -> DataFrame:
    """The scores of a group given out anew: the largest to the row with the largest key. Ties by position."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(key.desc(), F.col(pos)))).withColumn("_s", F.row_number().over(w.orderBy(F.desc(score), F.col(pos))))
    given = ranked.select(*keys, F.col("_s").alias("_k"), F.col(score).alias("permuted"))
    return ranked.join(given, [*keys, "_k"]).drop("_k", "_s")


def permute_judged(df: DataFrame, keys: list[str], key: Column, score: str = "score", pos: str = "rnk") -> DataFrame:
    """permuted: permute_scores among the rows of a group that have a key; rows without one keep their score."""
    x = permute_scores(df.withColumn("_judged", key.isNotNull()).withColumn("_key", F.coalesce(key, F.col(score))), [*keys, "_judged"], F.col("_key"), score, pos)
    return x.drop("_judged", "_key")


def video_bonus(df: DataFrame, keys: list[str], bonus: str, weight: float, out: str = "boosted") -> DataFrame:
    """The largest bonus of a query's items of a video, added to all of them."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.round(F.col("score") + weight * F.coalesce(F.max(bonus).over(w), F.lit(0)), 6))


def pair_score(df: DataFrame, keys: list[str], order: str, a: str, b: str, width: int, how: str = "hm") -> DataFrame:
    """paired: a with the best b among the next `width` rows of its group, by harmonic mean, product or a alone; none ahead: 0."""
    from keymoment.functions.arrays import harmonic

    ahead = F.max(b).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1, width))
    x = {"hm": harmonic(F.col(a), ahead), "product": F.col(a) * ahead, "a": F.col(a)}[how]
    return df.withColumn("paired", F.round(F.when(ahead.isNull(), 0.0).otherwise(x), 6))


#: Items of a part of a video.
PART = 4096


def pair_scores(items: DataFrame, queries: DataFrame, width: int, how: str = "hm") -> DataFrame:
    """(query_id, gid, paired): pair_score() by query and video of the products of items(gid, video_id, n, v), at least 0, with queries(query_id, qv, qw).

    Parts of videos are dealt to tasks, each with the `width` items after it, so items are shuffled and pairs aren't. n counts a video's items from 1.
    """
    import numpy as np
    import pyarrow as pa

    from keymoment.functions.arrays import harmonic

    from .vector import _matrix, query_blocks

    part = F.floor((F.col("n") - 1) / PART)
    parts = F.when((part > 0) & ((F.col("n") - 1) % PART < width), F.array(part, part - 1)).otherwise(F.array(part))
    dealt = items.where("v is not null").select("video_id", F.explode(parts).alias("part"), "n", F.col("gid").cast("long"), (part * PART).alias("_from"), F.col("v"))
    dealt = dealt.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "n")
    found = None
    for block in query_blocks(queries.select("query_id", "qv", "qw").where("qv is not null and qw is not null"), "query_id"):
        t = block.toArrow()
        ids = t.column("query_id").to_numpy()
        qa, qb = (_matrix(t.column(c)).T if t.num_rows else None for c in ("qv", "qw"))

        def run(batches, ids: np.ndarray = ids, qa: np.ndarray | None = qa, qb: np.ndarray | None = qb):
            def solved(rows: list[pa.RecordBatch]):
                x = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                own = x.column(1).to_numpy() * PART == x.column(4).to_numpy()
                n, gid, v = int(own.sum()), x.column(3).to_numpy(), _matrix(x.column(5))
                for j in range(0, len(ids), 256):
                    a, b = (np.maximum(np.round(v @ q[:, j : j + 256], 6) + 0.0, 0.0) for q in (qa, qb))
                    ahead = np.full((n, a.shape[1]), np.nan)
                    for k in range(1, width + 1):
                        m = min(n, len(b) - k)
                        if m > 0:
                            ahead[:m] = np.fmax(ahead[:m], b[k : k + m])
                    for i in range(a.shape[1]):
                        last = pa.array(ahead[:, i], from_pandas=True)  # none ahead: null
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[j + i])), pa.array(gid[:n]), pa.array(np.ascontiguousarray(a[:n, i])), last], names=["query_id", "gid", "a", "ahead"])

            held: list[pa.RecordBatch] = []
            for batch in batches if qa is not None else ():
                video, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((video[1:] != video[:-1]) | (part[1:] != part[:-1])) + 1), len(part)]
                for i, k in zip(cuts[:-1], cuts[1:], strict=True):
                    if k > i:
                        if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (video[i], part[i]):
                            yield from solved(held)
                            held = []
                        held.append(batch.slice(i, k - i))
            if held:
                yield from solved(held)

        x = dealt.mapInArrow(run, "query_id long, gid long, a double, ahead double")
        found = x if found is None else found.unionAll(x)
    a, ahead = F.col("a"), F.col("ahead")
    x = {"hm": harmonic(a, ahead), "product": a * ahead, "a": a}[how]
    return found.select("query_id", "gid", F.round(F.when(ahead.isNull(), 0.0).otherwise(x), 6).alias("paired"))


def rescale(df: DataFrame, keys: list[str], new: str, old: str, blend: float) -> DataFrame:
    """New scores brought to the mean and deviation of the old ones and blended with them."""
    d = with_stats(df, keys, _mn=F.avg(new), _sn=F.stddev_pop(new), _mo=F.avg(old), _so=F.stddev_pop(old))
    z = (F.col(new) - F.col("_mn")) / (F.col("_sn") + 1e-6) * F.col("_so") + F.col("_mo")
    return d.withColumn("rescaled", F.round((1 - blend) * F.col(old) + blend * z, 5)).drop("_mn", "_sn", "_mo", "_so")


def insert_guaranteed(ranked: DataFrame, extra: DataFrame, keys: list[str], item: str, at: int = 18, most: int = 3) -> DataFrame:
    """The first `at - 1` rows stay; up to `most` rows of extra (in order of rnk) that aren't among them take the places from
    `at`; the others follow. Result: keys, item, new_rank."""
    head = ranked.where(F.col("rnk") < at).select(*keys, item)
    fresh = extra.join(head, [*keys, item], "left_anti")
    w = Window.partitionBy(*keys)
    fresh = fresh.withColumn("_e", F.row_number().over(w.orderBy("rnk", item))).where(F.col("_e") <= most)
    rest = ranked.join(fresh.select(*keys, item), [*keys, item], "left_anti")
    rest = rest.select(*keys, item, F.when(F.col("rnk") < at, 0).otherwise(2).alias("_p"), F.col("rnk").alias("_o"))
    rows = gathered([rest, fresh.select(*keys, item, F.lit(1).alias("_p"), F.col("_e").cast("long").alias("_o"))], keys)
    return rows.withColumn("new_rank", F.row_number().over(w.orderBy("_p", "_o"))).drop("_p", "_o")


def chain_verdicts(chains: DataFrame, verdicts: DataFrame, reach: int = 3) -> DataFrame:
    """(query_id, video_id, verdict, picks, accepted) of chains(query_id, video_id, event_idx, n): the mean over events of the best verdict
    (query_id, event_idx, video_id, n, conf) within reach items, none counting 0; the items of those bests, taken over only if they
    rise strictly."""
    near = chains.withColumn("m", F.explode(F.array(*[F.col("n") + i for i in range(-reach, reach + 1)])))
    v = verdicts.select("query_id", "event_idx", "video_id", F.col("n").alias("m"), "conf")
    best = near.join(v, ["query_id", "event_idx", "video_id", "m"], "left").groupBy("query_id", "video_id", "event_idx").agg(F.max(F.struct(F.coalesce("conf", F.lit(0.0)).alias("c"), F.when(F.col("conf").isNotNull(), -F.col("m")).alias("m"))).alias("b"), F.max("n").alias("own"))
    pick = F.coalesce(-F.col("b.m"), F.col("own"))
    out = best.groupBy("query_id", "video_id").agg(F.round(F.avg("b.c"), 6).alias("verdict"), F.transform(F.sort_array(F.collect_list(F.struct("event_idx", pick.alias("p")))), lambda x: x["p"]).alias("picks"))
    return out.withColumn("accepted", F.col("picks") == F.sort_array(F.array_distinct("picks")))


def rerank_chains(chains: DataFrame, verdicts: DataFrame, reach: int = 3) -> DataFrame:
    """(query_id, video_id, rnk, verdict, accepted, items, new_rank) of chains(query_id, video_id, rnk, event_idx, n) by chain_verdicts(); items are
    the picks where they are accepted, else the chain's own. Ties of verdicts keep the order of rnk."""
    own = chains.groupBy("query_id", "video_id", "rnk").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_idx", "n"))), lambda x: x["n"]).alias("_own"))
    x = chain_verdicts(chains.drop("rnk"), verdicts, reach).join(own, ["query_id", "video_id"])
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("verdict"), "rnk"))
    return x.select("query_id", "video_id", "rnk", "verdict", "accepted", F.when(F.col("accepted"), F.col("picks")).otherwise(F.col("_own")).alias("items"), new.alias("new_rank"))
