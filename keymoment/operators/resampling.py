"""Resampling by hashes: draws, permutations and power as grouped aggregations that any engine with md5 repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import draw
from .vector import broadcast_if_small

#: Rows that travel with the tasks of a resampling; more are joined by a shuffle.
MOST_ROWS = 200_000
#: Shapes of an effect: (name, how many of n rows change, the share of those that go up).
SHAPES = (("three", lambda n: F.least(F.lit(3), n), 1.0), ("eleven", lambda n: F.least(F.lit(11), n), 10 / 11), ("third", lambda n: F.floor(n / 3), 0.8), ("every_mixed", lambda n: n, 0.7), ("every", lambda n: n, 1.0))
EFFECTS = (0.001, 0.01, 0.05, 0.12, 0.30, 0.65, 1.30, 2.0)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with idx from 0, in order of the first byte of the key's md5, then of the key: numbers within 256 parts, and the parts' offsets, so
    no task orders all rows."""
    part = F.substring(F.md5(F.col(key).cast("string")), 1, 2)
    x = df.withColumn("_part", part)
    sizes = x.groupBy("_part").agg(F.count("*").alias("_size"))  # 256 rows at most
    offsets = sizes.withColumn("_offset", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return x.join(F.broadcast(offsets), "_part").withColumn("idx", (own - 1 + F.col("_offset")).cast("long")).drop("_part", "_offset")


def resampled_means(df: DataFrame, key: str, x: str, resamples: int, seed: int) -> DataFrame:
    """(resample, mean): the mean of n of n rows drawn with replacement, so multinomial counts, for each resample. An empty df has none.

    Draws are rows of a range, no row of df is multiplied; they meet their row by its number and are summed by resample before the shuffle.
    """
    rows = numbered(df.select(key, x), key)
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).cast("long").alias("resample"), F.lit(0.0).alias("mean")).limit(0)
    draws = df.sparkSession.range(resamples * n).select(F.expr(f"id div {n}").alias("resample"), (F.col("id") % n).alias("slot"))
    draws = draws.withColumn("idx", F.floor(draw(seed, "resample", "slot") * n))
    return draws.join(broadcast_if_small(rows, MOST_ROWS), "idx").groupBy("resample").agg((F.sum(x) / n).alias("mean"))


def interval(means: DataFrame) -> DataFrame:
    """One row: mean, low and high ends of the middle 95 %, and the share of resamples that aren't positive."""
    m = means.select(F.round("mean", 9).alias("m"))
    return m.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)), 6).alias("p_not_positive"))


def half_splits(df: DataFrame, stratum: list[str], key: str, x: str, splits: int, seed: int) -> DataFrame:
    """(split, gap): the second half's mean of x less the first's, for halves of each stratum in hashed order; a group is one split's stratum."""
    rows = df.select(*stratum, key, x).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    w = Window.partitionBy("split", *stratum)
    r = F.row_number().over(w.orderBy(draw(seed, "split", key), key))
    rows = rows.withColumn("_first", r <= F.floor(F.count("*").over(w) / 2))
    return rows.groupBy("split").agg((F.avg(F.when(~F.col("_first"), F.col(x))) - F.avg(F.when(F.col("_first"), F.col(x)))).alias("gap"))


def against_null(observed: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: the observed gap (of one row), the null's deviation, 95th percentile and largest size, and the share of splits whose gap is as large."""
    x = gaps.select(F.round("gap", 9).alias("gap")).join(F.broadcast(observed.select(F.round("gap", 9).alias("observed"))))
    return x.groupBy(F.round("observed", 6).alias("observed")).agg(
        F.count("gap").alias("splits"), F.round(F.stddev_samp("gap"), 6).alias("sd"), F.round(F.percentile(F.abs("gap"), 0.95), 6).alias("p95"), F.round(F.max(F.abs("gap")), 6).alias("most"),
        F.round(F.avg(F.when(F.abs("gap") >= F.abs("observed"), 1.0).otherwise(0.0)), 6).alias("p_value"),
    )


def power(groups: DataFrame, group: str, reps: int, resamples: int, seed: int) -> DataFrame:
    """(group, shape, n, changed, up, power, mde) of groups(group, n, base), a row for each group.

    Power is the share of `reps` experiments in which the 2.5th percentile of `resamples` paired bootstrap means of an effect of that shape is above 0.
    Such a percentile keeps its sign when all changes grow alike, so power depends on the shape alone and mde, the least of EFFECTS (as
    a share of the base score) that is found in 80 % of experiments, is the least of all where a shape has that power, else null.
    """
    n, names = F.col("n"), [s[0] for s in SHAPES]
    g = groups.select(group, n.cast("long").alias("n"), "base")
    for name, changed, share in SHAPES:
        g = g.withColumn(f"{name}_k", changed(n).cast("long")).withColumn(f"{name}_u", F.greatest(F.lit(1), F.round(F.col(f"{name}_k") * share)).cast("long"))
    total = F.col("n") * reps * resamples
    draws = g.where("n > 0").withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    draws = draws.withColumns({"rep": F.expr(f"id div (n * {resamples})"), "resample": F.expr(f"id div n % {resamples}"), "slot": F.expr("id % n")})
    idx = F.floor(draw(seed, "n", "rep", "resample", "slot") * n)
    draws = draws.withColumn("idx", idx)
    sums = [F.sum(F.when(F.col("idx") < F.col(f"{s}_u"), 1).when(F.col("idx") < F.col(f"{s}_k"), -1).otherwise(0)).alias(s) for s in names]
    means = draws.groupBy(group, "rep", "resample").agg(*sums)
    each = means.groupBy(group, "rep").agg(*(F.when(F.percentile(s, 0.025) > 0, 1.0).otherwise(0.0).alias(s) for s in names))
    share = each.groupBy(group).agg(*(F.avg(s).alias(s) for s in names)).join(g, group)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("shape"), F.col(f"{s}_k").alias("changed"), F.col(f"{s}_u").alias("up"), F.col(s).alias("power")) for s in names)))
    out = share.select(group, "n", "base", rows.alias("s")).select(group, "s.shape", "n", "s.changed", "s.up", F.round("s.power", 6).alias("power"), "base")
    found = (F.col("power") >= 0.8) & (F.col("base") > 0) & (2 * F.col("up") > F.col("changed"))
    return out.withColumn("mde", F.when(found, EFFECTS[0])).drop("base")


def post_stratified(df: DataFrame, axis: str, part: str, x: str) -> DataFrame:
    """One row: the raw gap test less tune, the gap weighted by axis values' shares of all rows (values that one part lacks go), and the share that this explains."""
    own = df.groupBy(axis).agg(F.count("*").alias("n"), (F.avg(F.when(F.col(part) == "test", F.col(x))) - F.avg(F.when(F.col(part) == "tune", F.col(x)))).alias("gap"))
    weighted: Column = F.sum(F.when(F.col("gap").isNotNull(), F.col("n") * F.col("gap"))) / F.sum(F.when(F.col("gap").isNotNull(), F.col("n")))
    raw = df.agg((F.avg(F.when(F.col(part) == "test", F.col(x))) - F.avg(F.when(F.col(part) == "tune", F.col(x)))).alias("raw"))
    out = own.agg(weighted.alias("gap")).join(F.broadcast(raw))  # one row each
    return out.select(F.round("raw", 6).alias("raw"), F.round("gap", 6).alias("gap"), F.when(F.abs("raw") > 1e-9, F.round(1 - F.abs("gap") / F.abs("raw"), 6)).alias("explained"))
