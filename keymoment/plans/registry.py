"""Queries by name: each takes (spark, sf_dir), some have the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_WIDE = {T.ByteType: T.LongType(), T.ShortType: T.LongType(), T.IntegerType: T.LongType(), T.FloatType: T.DoubleType(), T.DecimalType: T.DoubleType()}


def _wide(t: T.DataType) -> T.DataType:
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_wide(t.elementType))
    return _WIDE.get(type(t), t)


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, other numbers as double, so results have one schema in any engine."""
    return df.select([F.col(f"`{f.name}`").cast(_wide(f.dataType)).alias(f.name) if _wide(f.dataType) != f.dataType else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add
