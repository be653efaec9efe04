"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame that run()
writes as Parquet in the shared folder and reads back. All stages but the last return the columns of documents.

Defined cases: a null or empty text has no letter and goes in the first stage; without one labelled language that stage keeps every
text with a letter; rows with a null doc_id stay and are neither compared nor cut; rows that repeat a doc_id are one document to the stages
that compare documents and are judged each by the others; columns beside doc_id and text are kept, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.llm import bpe, decontaminate, jaccard_join, language, passages
from keymoment.llm.store import drop, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose cosine with all language prototypes is within chance, or that have no letter, go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of Jaccard 0.8 or more, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller doc_id too are cut out."""
    return passages.remove_passages(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with what they decode to as a digest."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.encode_decode(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("byte_pairs", byte_pairs),
]

#: The stages can't be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)  # the stage before; of the input nothing is deleted
        docs = done
    return docs
