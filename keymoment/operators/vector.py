"""Vector similarity: element-wise expressions for single vectors, products of blocks of vectors for queries against a corpus.

Queries are the small side of a search. They travel with the tasks in blocks of at most MOST_QUERIES rows, whose sizes are counted
before they are built; more queries are more blocks, each with its own pass over the corpus, whose rows are never shuffled or collected.
Counting the queries and fetching their blocks are small jobs that run while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_QUERIES = 4096
#: Scores that a task holds at a time.
CELLS = 1 << 19


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has `most` rows at most, as counted; without one beyond, so Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_blocks(queries: DataFrame, key: str, most: int = MOST_QUERIES) -> Iterator[DataFrame]:
    """queries dealt by their key to parts of at most `most` rows each, as counted. A key's rows stay together and must be `most` at most."""
    n = queries.count()
    parts = -(-n // most)
    while parts > 1:
        part = F.pmod(F.xxhash64(key), F.lit(parts))
        if queries.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] <= most:
            yield from (queries.where(part == i) for i in range(parts))
            return
        parts *= 2
        if parts > 64 * n:
            raise ValueError(f"more than {most} rows of one {key}")
    yield queries


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float | None = None) -> Column:
    """a divided by its length; by `least` if that is larger, and a null vector stays as it is without `least`."""
    length = norm(a)
    by = F.greatest(length, F.lit(least)) if least else F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(a, lambda x: x / by)


def vector_sum(df: DataFrame, keys: list[str], v: str, weight: Column, out: str) -> DataFrame:
    """Weighted sums of vectors by key: element-wise partial sums, so a hot key is combined before the shuffle."""
    e = df.select(*keys, F.posexplode(v).alias("_i", "_x"), weight.alias("_w"))
    s = e.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_x"))
    return s.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias(out))


def ensemble(df: DataFrame, keys: list[str], v: str, weight: str, out: str) -> DataFrame:
    """Prompt ensemble: the weighted sum of a key's vectors, at length one."""
    return vector_sum(df, keys, v, F.col(weight), out).withColumn(out, unit(F.col(out), 1e-6))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows; a null among them is an error of the caller's."""
    if column.null_count:
        raise ValueError("null vectors have no products")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def products(corpus: DataFrame, queries: DataFrame, v: str, out: dict[str, str], key: str = "query_id", digits: int | None = 6, sparse: tuple[str, ...] = ()) -> DataFrame:
    """Every query with every item: all columns of both sides but the vectors, and for each name of `out` the product of v with that
    query vector. A row with a null vector has no products and goes. The corpus is read once for each block of queries; nothing is shuffled.

    Columns of the corpus in `sparse` are arrays of (query, x), a query once at most and no nulls; of a pair they give its x as a double, 0 without one.
    """
    mine = [c for c in corpus.columns if c != v and c not in sparse]
    theirs = [c for c in queries.columns if c not in out.values()]
    schema = T.StructType([*(corpus.schema[c] for c in mine), *(queries.schema[c] for c in theirs), *(T.StructField(c, T.DoubleType()) for c in (*sparse, *out))])
    entries = (F.coalesce(F.col(c), F.array()).cast("array<struct<q:bigint,x:double>>").alias(c) for c in sparse)
    items = corpus.select(*mine, *entries, F.col(v).alias("_v")).where("_v is not null")
    parts = []
    for block in query_blocks(queries.where(" and ".join(f"`{q}` is not null" for q in out.values())), key):
        t = block.toArrow()
        vectors = [_matrix(t.column(q)).T if t.num_rows else None for q in out.values()]
        fixed = [t.column(c).combine_chunks() for c in theirs]
        keys = t.column(key).to_numpy() if sparse else None

        def run(batches: Iterator[pa.RecordBatch], vectors: list = vectors, fixed: list = fixed, n: int = t.num_rows, keys: np.ndarray | None = keys) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not n:
                    continue
                x = _matrix(batch.column(batch.num_columns - 1))
                s = [x @ m if digits is None else np.round(x @ m, digits) + 0.0 for m in vectors]
                own = batch.columns[: len(mine)]
                few = [_by_query(c, keys) for c in batch.columns[len(mine) : -1]]
                for j in range(n):
                    given = [pa.repeat(c[j], batch.num_rows) for c in fixed]
                    given += [pa.array(_dense(f, j, batch.num_rows)) for f in few]
                    yield pa.RecordBatch.from_arrays([*own, *given, *(pa.array(np.ascontiguousarray(y[:, j])) for y in s)], names=schema.names)

        parts.append(items.mapInArrow(run, schema))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def _by_query(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each query of keys begins, rows, values) of the entries of a sparse column, in order of the query."""
    flat, rows = column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    q, x = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    place = np.searchsorted(keys, q, sorter=order).clip(max=len(keys) - 1)
    at = order[place]
    held = keys[at] == q
    at, rows, x = at[held], rows[held], x[held]
    by = np.argsort(at, kind="stable")
    return np.searchsorted(at[by], np.arange(len(keys) + 1)), rows[by], x[by]


def _dense(entries: tuple[np.ndarray, np.ndarray, np.ndarray], j: int, n: int) -> np.ndarray:
    out, (cuts, rows, x) = np.zeros(n), entries
    out[rows[cuts[j] : cuts[j + 1]]] = x[cuts[j] : cuts[j + 1]]
    return out


def similarities(corpus: DataFrame, queries: DataFrame, v: str, q: str, digits: int = 6, key: str = "query_id") -> DataFrame:
    """products() with one query vector, as score."""
    return products(corpus, queries, v, {"score": q}, key, digits)


def combine_chunks(scored: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """Scores of a query's clauses combined by mean or max."""
    f = {"mean": F.avg, "max": F.max}[how]
    return scored.groupBy(*keys).agg(F.round(f("score"), 8).alias("score"))


def max_sim(pairs: DataFrame, keys: list[str], token: str, score: Column) -> DataFrame:
    """Late interaction: the mean over tokens of the maximum over patches."""
    best = pairs.groupBy(*keys, token).agg(F.max(score).alias("_m"))
    return best.groupBy(*keys).agg(F.round(F.avg("_m"), 6).alias("score"))


def adjacent_cosine(items: DataFrame, group: str, order: str, v: str, lag: int = 1) -> DataFrame:
    """cosine of an item with the one `lag` before it in its group; null for the first ones."""
    w = Window.partitionBy(group).orderBy(order)
    return items.withColumn("_p", F.lag(v, lag).over(w)).withColumn("cosine", dot(F.col(v), F.col("_p")) / (norm(F.col(v)) * norm(F.col("_p")))).drop("_p")


def drawn_pairs(items: DataFrame, key: str, group: str, v: str, partners: int, seed: int) -> DataFrame:
    """(key, other, cosine) of items with `partners` drawn items each, those of other groups only: an equi-join on the drawn item's number, no cross join."""
    from .evaluate import draw
    from .resampling import numbered

    rows = numbered(items.select(key, group, v), key)
    n = rows.count()
    drawn = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(partners)))).select(F.col(key), F.col(group).alias("_g"), F.col(v).alias("_v"), F.floor(draw(seed, key, "slot") * n).alias("idx"))
    pairs = drawn.join(rows.select("idx", F.col(key).alias("other"), group, v), "idx").where(F.col("_g") != F.col(group))
    return pairs.select(key, "other", (dot(F.col("_v"), F.col(v)) / (norm(F.col("_v")) * norm(F.col(v)))).alias("cosine"))


def _dealt(items: DataFrame) -> DataFrame:
    """items dealt to as many tasks as run at once by their gid: numbering them leaves a task for each video, few files leave few."""
    return items.repartition(items.sparkSession.sparkContext.defaultParallelism, "gid")


def _scored(x: np.ndarray, queries: list[np.ndarray], score: Callable[..., np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of x's rows by queries, CELLS of them at a time: (the queries' places, a row for each of them)."""
    step = max(1, CELLS // len(x))
    for at in range(0, len(queries[0]), step):
        part = slice(at, at + step)
        yield part, score(*(m[part] @ x.T for m in queries))


def top_similar(corpus: DataFrame, queries: DataFrame, v: str, q: str, k: int, digits: int = 6, group: str | None = None, without: str | None = None) -> DataFrame:
    """(query_id, gid, score, rnk): the k best items of each query, ties to the smaller gid; with group and without, items
    whose text in group is the query's in without are left out.

    A task keeps the k best rows of each batch for each query, so the shuffle holds candidates and not all pairs.
    """
    from .topk import top_per_group

    schema = "query_id long, gid long, score double"
    items = corpus.select(F.col("gid").cast("long"), F.col(v).alias("_v"), *([F.col(group).alias("_g")] if group else [])).where("_v is not null")
    parts = []
    for block in query_blocks(queries.select("query_id", q, *([without] if without else [])).where(F.col(q).isNotNull()), "query_id"):
        t = block.toArrow()
        ids, m = t.column("query_id").to_numpy(), _matrix(t.column(q)) if t.num_rows else None
        barred = t.column(without).to_pylist() if without else []

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, m: np.ndarray | None = m, barred: list[str] = barred) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gid = batch.column(0).to_numpy()
                if not len(gid) or m is None:
                    continue
                if barred:
                    texts = pc.unique(batch.column(2)).to_pylist()
                    code = {x: i for i, x in enumerate(texts) if x is not None}
                    own = pc.fill_null(pc.index_in(batch.column(2), pa.array(texts, batch.column(2).type), skip_nulls=True), -2).to_numpy(zero_copy_only=False)
                    out = np.array([code.get(x, -1) for x in barred])
                n = min(k, len(gid))
                for part, s in _scored(_matrix(batch.column(1)), [m], lambda x: np.round(x, digits) + 0.0):
                    if barred:
                        s[out[part, None] == own] = -np.inf
                    bad = np.isnan(s)
                    by = np.where(bad, np.inf, s) if bad.any() else s  # as in an ORDER BY
                    cut = np.partition(by, len(gid) - n, axis=1)[:, len(gid) - n, None]
                    j, at = np.nonzero((by >= cut) & (by > -np.inf))  # ties stay, the order below decides
                    order = np.lexsort((gid[at], -by[j, at], ~bad[j, at], j))
                    j, at = j[order], at[order]
                    first = np.arange(len(j)) - np.searchsorted(j, j) < n
                    j, at = j[first], at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][j], pa.int64()), pa.array(gid[at], pa.int64()), pa.array(s[j, at])], names=["query_id", "gid", "score"])

        parts.append(_dealt(items).mapInArrow(run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc("gid")], k)


def reaching(corpus: DataFrame, queries: DataFrame, v: str, q: str, floor: str, digits: int = 6) -> DataFrame:
    """(query_id, gid, score) of the pairs whose score is the query's number in floor or more. Others leave no task."""
    items = corpus.select(F.col("gid").cast("long"), F.col(v).alias("_v")).where("_v is not null")
    parts = []
    for block in query_blocks(queries.select("query_id", q, F.col(floor).cast("double").alias("_f")).where(F.col(q).isNotNull() & F.col("_f").isNotNull()), "query_id"):
        t = block.toArrow()
        ids, low, m = t.column("query_id").to_numpy(), t.column("_f").to_numpy(), _matrix(t.column(q)) if t.num_rows else None

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, low: np.ndarray = low, m: np.ndarray | None = m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or m is None:
                    continue
                for part, s in _scored(_matrix(batch.column(1)), [m], lambda x: np.round(x, digits) + 0.0):
                    j, at = np.nonzero(~(s < low[part, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][j], pa.int64()), batch.column(0).take(pa.array(at)), pa.array(s[j, at])], names=["query_id", "gid", "score"])

        parts.append(_dealt(items).mapInArrow(run, "query_id long, gid long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x at so many digits, halves of x * 10 ** digits away from zero, as SQL's round()."""
    r = np.rint(y := x * 10.0**digits)
    with np.errstate(invalid="ignore"):  # inf
        off = np.abs(np.subtract(y, r, out=y), out=y)
    if (half := off == 0.5).any():
        y = x[half] * 10.0**digits
        r[half] = y + np.copysign(0.5, y)
    r /= 10.0**digits
    r += 0.0
    return r


def scores_of(pairs: DataFrame, v: str, vectors: list[str], score: Callable[..., np.ndarray]) -> DataFrame:
    """(query_id, score) of the rows of pairs, which hold an item's vector v and those of a query: score of the products of v with each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, *qs = map(_matrix, batch.columns[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(*(np.einsum("ij,ij->i", x, q) for q in qs)))], names=["query_id", "score"])

    whole = pairs.select(F.col("query_id").cast("long"), v, *vectors)
    return whole.where(" and ".join(f"`{c}` is not null" for c in (v, *vectors))).mapInArrow(run, "query_id long, score double")


def counts_above(corpus: DataFrame, queries: DataFrame, v: str, vectors: list[str], score: Callable[..., np.ndarray], bar: str) -> DataFrame:
    """(query_id, above): how many items have a score, of the products of v with a query's vectors, above the query's number in bar. A task gives a row
    for each query, pairs leave none. NaN is above any number, as in SQL."""
    items = corpus.select("gid", F.col(v).alias("_v")).where("_v is not null")
    known = " and ".join(f"`{c}` is not null" for c in (*vectors, bar))
    parts = []
    for block in query_blocks(queries.select(F.col("query_id").cast("long"), *vectors, F.col(bar).cast("double")).where(known), "query_id"):
        t = block.toArrow()
        ids, bars, ms = t.column("query_id").to_numpy(), t.column(bar).to_numpy(), [_matrix(t.column(c)) for c in vectors] if t.num_rows else None

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, bars: np.ndarray = bars, ms: list[np.ndarray] | None = ms) -> Iterator[pa.RecordBatch]:
            above = np.zeros(len(ids), np.int64)
            for batch in batches:
                if batch.num_rows and ms:
                    for part, s in _scored(_matrix(batch.column(1)), ms, score):
                        above[part] += np.count_nonzero(~(s <= bars[part, None]), axis=1)
            above[np.isnan(bars)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(above)], names=["query_id", "above"])

        parts.append(_dealt(items).mapInArrow(run, "query_id long, above long"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("query_id").agg(F.sum("above").alias("above"))


def top_shaken(corpus: DataFrame, queries: DataFrame, v: str, q: str, shaken: Column, most: float, head: int = 16) -> tuple[DataFrame, DataFrame]:
    """(query_id, gid) of each query's best item by score, and by `shaken`, a column of query_id, gid and score that is at most `most` above the
    score; ties to the smaller gid.

    The best of the `head` best items' shaken scores is a floor, and only items whose scores come within `most` of it can hold the best one,
    so few pairs are shaken. The floor is lowered by what rounding adds.
    """
    from .fusion import kept
    from .topk import top_per_group

    queries = kept(queries.select("query_id", q), "queries")
    items = corpus.select("gid", v)
    best = kept(top_similar(items, queries, v, q, head), "heads")
    top = best.withColumn("score", shaken).groupBy("query_id").agg(F.max("score").alias("_top"))
    low = F.when(F.isnan("_top"), float("inf")).otherwise(F.col("_top") - most - 2e-6 - F.abs("_top") * 1e-12)
    near = reaching(items, queries.join(top.select("query_id", low.alias("_low")), "query_id"), v, q, "_low").withColumn("score", shaken)
    return best.where("rnk = 1").select("query_id", "gid"), top_per_group(near, ["query_id"], [F.desc("score"), F.asc("gid")], 1).select("query_id", "gid")
