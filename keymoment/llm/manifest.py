"""Operator 12: a Merkle manifest of a dataset, level by level in DataFrames.

Each row is a leaf; every FANOUT consecutive nodes of a source become their parent, until a source has one node, its subroot; the subroots, in
order of their sources, become the root the same way. A level is a grouped aggregation by (source, place div FANOUT) whose sorted children are
hashed, written as a table. Proofs go down again: a level's parents meet their own path by a join on (source, place), and the exploded children carry
it on with their siblings, so a level's join has a row for each parent only and documents are never joined: the lowest level's children carry them.

Places of rows (`placed`) need no task that holds a whole source: rows are sorted over range partitions, row_number counts within a source's part of
a partition, and only sources that cross partitions (at most two a partition) need an offset, in a broadcast bounded by the number of partitions.

Defined cases: null fields are written "-"; a null source is a source of its own and the first; rows that repeat a doc_id are leaves of their own, in order of their digests
(equal rows have equal ones, so their order doesn't show), null ones first; a null doc_id is never tampered with; empty texts are "0:"; extra columns
are no part of a leaf; an empty table has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop, written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(text: Column) -> Column:
    """The digest of a row's fields, with text for its text."""
    values = [text if f == "text" else F.col(f).cast("string") for f in FIELDS]
    return hashed(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered): tree orders sources by bytes, null first; tampered is the changed row's digest, null where nothing changes."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text").cast("string")).alias("digest"), F.when(changed, leaf(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))).alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their place (from 0) in their tree in that order, and n, the tree's rows."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = written(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()), "sorted")
    counts = sorted_rows.groupBy("tree", "part").agg(F.count("*").alias("own"))
    edges = counts.groupBy("part").agg(F.min("tree").alias("low"), F.max("tree").alias("high"))
    # A tree that crosses partitions is the first or the last of each it touches: at most two rows a partition.
    crossing = counts.join(F.broadcast(edges), "part").where("tree = low or tree = high")
    before = Window.partitionBy("tree").orderBy("part")
    offsets = crossing.select("tree", "part", (F.sum("own").over(before) - F.col("own")).alias("offset"), F.sum("own").over(Window.partitionBy("tree")).alias("total"))
    own = Window.partitionBy("part", "tree")
    numbered = sorted_rows.repartitionByRange(parts, "part").select("*", F.row_number().over(own.orderBy(*order)).alias("at"), F.count("*").over(own).alias("inside"))
    out = numbered.join(F.broadcast(offsets), ["tree", "part"], "left")
    out = out.withColumn("place", (F.col("at") - 1 + F.coalesce("offset", F.lit(0))).cast("long")).withColumn("n", F.coalesce("total", "inside").cast("long"))
    out = written(out.select(*rows.columns, "place", "n"), "level")
    drop(sorted_rows)
    return out


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, place, n, digest, children) one level up, of trees with more than one node; children are rows of nodes in order of place."""
    kept = F.struct("place", *(c for c in nodes.columns if c not in ("tree", "place", "n", "children")))
    up = nodes.where("n > 1").groupBy("tree", F.expr(f"place div {FANOUT}").alias("up"), "n").agg(F.sort_array(F.collect_list(kept)).alias("children"))
    digest = hashed(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
    return up.select("tree", F.col("up").alias("place"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"), "children")


def levels(ground: DataFrame) -> list[DataFrame]:
    """Tables of the levels from the lowest (a table already) up to where every tree has one node."""
    out = [ground]
    most = ground.agg(F.max("n")).first()[0] or 1
    while most > 1:
        out.append(written(parents(out[-1]), "level"))
        most = -(-most // FANOUT)
    return out


def last_nodes(up: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node that each tree ends in."""
    return reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", "digest") for x in up))


def _siblings(keep: Column) -> Column:
    return F.aggregate(F.transform(keep, lambda c: F.unhex(c["digest"])), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))


def with_paths(up: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest level's rows, with all of ends' columns and `path`: for each level up to the root, the digests left and right of the row's node.

    ends: (tree, path, ...) of each tree's last node.
    """
    carried = [c for c in ends.columns if c not in ("tree", "path")]
    above: DataFrame | None = None
    for k in range(len(up) - 1, 0, -1):
        last = up[k].where("n = 1").select("tree", "place").join(ends, "tree")
        known = last if above is None else above.unionByName(last)
        down = up[k].drop("digest").join(known, ["tree", "place"]).select("tree", "path", *carried, "children", F.explode("children").alias("child"))
        left, right = F.filter("children", lambda c: c["place"] < F.col("child.place")), F.filter("children", lambda c: c["place"] > F.col("child.place"))
        step = F.struct(_siblings(left).alias("left"), _siblings(right).alias("right"))
        down = down.select("tree", "child.*", F.concat(F.array(step), "path").alias("path"), *carried)
        if k > 1:
            above = written(down.select("tree", "place", "path", *carried), "paths")
    alone = up[0].where("n = 1").drop("n").join(ends, "tree")
    return alone if len(up) == 1 else down.unionByName(alone.select(down.columns))


def folded(digest: Column, path: Column) -> Column:
    """The root that a row's digest and its path give."""
    return F.aggregate(path, digest, lambda cur, s: hashed(F.lower(F.hex(s["left"])), cur, F.lower(F.hex(s["right"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: its leaf, its source's subroot, the root, the digest of its proof, the root that the tampered row folds to, and whether that verifies."""
    sources = levels(placed(leaves(docs), ["doc_id", "digest"]))
    subroots = last_nodes(sources).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top = levels(placed(subroots, ["source"]))
    root = last_nodes(top).select("tree", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.unhex("digest").alias("root"))
    ends = written(with_paths(top, root).select(F.col("source").alias("tree"), "path", "root", F.unhex("digest").alias("subroot")), "subroots")
    rows = with_paths(sources, ends).withColumns({c: F.lower(F.hex(c)) for c in ("root", "subroot")})
    proof = F.array_join(F.transform("path", lambda s: F.concat(F.lower(F.hex(s["left"])), F.lower(F.hex(s["right"])))), "")
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", hashed(proof).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
