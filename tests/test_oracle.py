"""Every query that has SQL gives the rows that DuckDB gives, types included, over the whole small tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from keymoment.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if x != x else x + 0.0
    return x


def rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)), key=repr)


def kinds(table) -> dict[str, str]:
    out = {}
    for f in table.schema:
        t = str(f.type).replace("large_", "").replace(" not null", "")
        for word in ("element: ", "item: ", "child: ", "l: "):
            t = t.replace(word, "")
        out[f.name] = t
    return out


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), db.sql(ORACLE[name]).to_arrow_table()
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == entry.queries()["d3_prompt_ensemble"](spark, DATA).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
