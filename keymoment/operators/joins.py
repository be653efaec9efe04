"""Range, nearest, interval and band joins over equi keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gathered(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of frames with the same columns, dealt by keys anew.

    A keyed step after a union must not count on the partitioning of the union's parts: adaptive execution may coalesce their shuffles
    differently, and Spark 4.1 then leaves out an exchange that is needed (a key's rows stay in several tasks). Its setting for this is
    turned off for the session; the exchange asked for here is the one that the keyed step needs.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", False)
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.repartition(*keys)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, left_id: list[str], take: list[str], width: float | None = None) -> DataFrame:
    """For each left row the right row of its keys whose b is nearest to a; ties: the smaller b, then the smaller taken values.
    Rows without a right row of their keys go.

    Both sides are put in one order by key and value, and the last right row is carried along upwards and downwards: work grows
    with rows and not with pairs. With a width, a key's values are dealt to ranges of it that are ordered each on their own, and what
    lies before and after a range comes from a table of the ranges' first and last right rows: a hot key is many tasks.
    """
    r = right.select(*keys, F.col(b).cast("double").alias("_x"), F.lit(0).alias("_side"), F.struct(F.col(b).alias("b"), *[F.col(c).alias(c) for c in take]).alias("_r"))
    l = left.select(*keys, F.col(a).cast("double").alias("_x"), F.lit(1).alias("_side"), F.col(a).alias("_a"), *[F.col(c) for c in left_id])
    parts = list(keys)
    if width is not None:
        l, r, parts = *(x.withColumn("_k", F.floor(F.col("_x") / width)) for x in (l, r)), [*keys, "_k"]
    both = gathered([l, r], parts)
    w = Window.partitionBy(*parts).rowsBetween(Window.unboundedPreceding, 0)
    under = F.last("_r", ignorenulls=True).over(w.orderBy("_x", "_side", F.desc("_r")))
    over = F.last("_r", ignorenulls=True).over(w.orderBy(F.desc("_x"), "_side", F.desc("_r")))
    near = both.withColumn("_u", under).withColumn("_o", over).where("_side = 1")
    found = ["_u", "_o"]
    if width is not None:
        ends = both.groupBy(*parts).agg(
            F.min(F.when(F.col("_side") == 0, F.struct((-F.col("_x")).alias("x"), F.col("_r").alias("r")))).alias("_last"),
            F.min(F.when(F.col("_side") == 0, F.struct(F.col("_x").alias("x"), F.col("_r").alias("r")))).alias("_first"),
        )
        along = Window.partitionBy(*keys).orderBy("_k")
        before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
        near = near.join(ends.select(*parts, before["r"].alias("_b"), after["r"].alias("_f")), parts)
        found += ["_b", "_f"]
    found = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_a") - F.col(f"{c}.b")).alias("d"), F.col(c).alias("r"))) for c in found]
    best = near.select(*left_id, F.array_min(F.array_compact(F.array(*found))).alias("_m")).where("_m is not null")
    return best.select(*left_id, F.col("_m.d").alias("distance"), *[F.col(f"_m.r.{c}").alias(c) for c in take])


def within(left: DataFrame, right: DataFrame, keys: list[str], x: str, lo: str, hi: str, how: str = "inner") -> DataFrame:
    """Interval join: rows of equal keys with lo <= x <= hi."""
    return left.join(right, [*(left[k] == right[k] for k in keys), left[x].between(right[lo], right[hi])], how)


def band(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: float, bucket: float | None = None) -> DataFrame:
    """Rows of equal keys with |a - b| <= width. The right side is dealt to three buckets of that width, so that a hot key's pairs
    are found by equality on (keys, bucket) and not by comparing all its rows."""
    size = bucket or width
    l = left.withColumn("_k", F.floor(F.col(a) / size))
    r = right.withColumn("_k", F.explode(F.array(*[F.floor(F.col(b) / size) + i for i in (-1, 0, 1)])))
    return l.join(r, [*keys, "_k"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_k")


def in_ranges(items: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, span: int) -> DataFrame:
    """Range join without keys: ranges are cut into cells of `span` values, items look up their own cell."""
    r = ranges.withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / span), F.floor(F.col(hi) / span))))
    return items.withColumn("_c", F.floor(F.col(x) / span)).join(r, "_c").where(F.col(x).between(F.col(lo), F.col(hi))).drop("_c")


def outer_ranks(a: DataFrame, b: DataFrame, keys: list[str], missing: int = 1_000_000) -> DataFrame:
    """Full outer join of two rankings (column rnk): rank_a and rank_b, a missing one as `missing`."""
    x, y = a.select(*keys, F.col("rnk").alias("rank_a")), b.select(*keys, F.col("rnk").alias("rank_b"))
    return x.join(y, keys, "full_outer").fillna(missing, ["rank_a", "rank_b"])


def union_first(frames: list[DataFrame], keys: list[str], pos: str = "pos") -> DataFrame:
    """Rows of frames end to end, each key once, at its first place; frames are in order of their own pos column."""
    all_rows = gathered([f.withColumn("_s", F.lit(i)) for i, f in enumerate(frames)], keys)
    w = Window.partitionBy(*keys).orderBy("_s", pos)
    return all_rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("_s", "source")


def priority_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order: the earlier of several sources wins."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
