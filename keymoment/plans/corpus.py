"""The test tables seen as a corpus of timed, ordered items with vectors, and the SQL of the same views.

Queries follow a rule, so their number grows with the table: every fiftieth vector (vec_id divisible by 50) begins one, and it and the
three after it are its prompts. A video is a label; its items are a group of a video's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keymoment.operators import vector

#: Frames between items, frames a second, items at the start of a video that are left out, candidates of a query.
STEP, FPS, SKIP, CANDIDATES = 55, 25.0, 2, 400
#: Vectors from one query to the next, and the weights of a query's prompts.
EVERY = 50
WEIGHTS = (0.45, 0.35, 0.10, 0.10)

K = """k AS (SELECT *, (n - 1) * 55 AS frame_idx, CAST((n - 1) * 55 AS DOUBLE) / 25 AS pts_time FROM (
  SELECT vec_id AS gid, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS video_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
QV = """qx AS (SELECT vec_id // 50 AS query_id, CASE vec_id % 50 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.35::DOUBLE ELSE 0.10::DOUBLE END AS w,
         unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 50 < 4),
  qs AS (SELECT query_id, i, sum(w * x) AS x FROM qx GROUP BY ALL),
  qv AS (SELECT query_id, list(x / greatest(norm, 1e-6) ORDER BY i) AS qv FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS norm FROM qs) GROUP BY query_id)"""
S = f"{K}, {QV}, s AS (SELECT query_id, gid, video_id, n, frame_idx, pts_time, round(list_inner_product(v, qv), 6) AS score FROM k, qv)"
H = f"""{S}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rnk FROM s WHERE n > 2) WHERE rnk <= 400)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many items and queries there are, in SQL.
N_ITEMS, N_QUERIES = "(SELECT count(*) FROM embeddings)", "(SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0)"


def dealt(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """df with the numbers of items and queries (_items, _queries), by whose remainders rows of other tables are dealt to them."""
    e = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("_items"), F.count_if(F.col("vec_id") % EVERY == 0).alias("_queries"))
    return df.join(F.broadcast(e))  # one row


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, video_id, n, frame_idx, pts_time, v of every item."""
    e = table(spark, sf_dir, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    out = e.select(F.col("vec_id").alias("gid"), F.format_string("V%03d", "label").alias("video_id"), n.alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    return out.withColumn("frame_idx", (F.col("n") - 1) * STEP).withColumn("pts_time", F.col("frame_idx") / FPS)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, prompt_no, weight, v: the prompts of each query, four but at the table's end."""
    no = F.col("vec_id") % EVERY
    e = table(spark, sf_dir, "embeddings").where(no < len(WEIGHTS))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (no + 1).cast("int"))
    return e.select(F.floor(F.col("vec_id") / EVERY).alias("query_id"), no.alias("prompt_no"), weight.alias("weight"), F.col("embedding").cast("array<double>").alias("v"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.ensemble(prompts(spark, sf_dir), ["query_id"], "v", "weight", "qv")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, gid, video_id, n, frame_idx, pts_time, score of every query, in blocks, against every item."""
    return vector.similarities(keyframes(spark, sf_dir), query_vectors(spark, sf_dir), "v", "qv")


def hits(spark: SparkSession, sf_dir: str, n: int = CANDIDATES) -> DataFrame:
    """The best n items of each query outside the videos' openings, with their rank as rnk."""
    k = keyframes(spark, sf_dir).where(F.col("n") > SKIP)
    top = vector.top_similar(k, query_vectors(spark, sf_dir), "v", "qv", n)
    return top.join(k.drop("v"), "gid")
