"""The formats npy and zip_files: ranges that are read, commits and aborts."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from keymoment.sources import data_sources
from keymoment.sources.data_sources import FilteredNpyReader


@pytest.fixture(scope="module")
def matrices(tmp_path_factory):
    folder = tmp_path_factory.mktemp("npy")
    own = {f"m{i}.npy": np.random.default_rng(i).normal(size=(n, 5)).astype(t) for i, (n, t) in enumerate([(1000, "<f4"), (37, "<f8"), (0, "<f4"), (3, ">i2")])}
    for name, m in own.items():
        np.save(folder / name, m)
    (folder / "note.txt").write_text("no matrix")
    return str(folder), own


def test_whole_matrices(spark, matrices):
    data_sources.register(spark)
    folder, own = matrices
    got = {(r.file, r.gid): r.v for r in spark.read.format("npy").option("rows", 100).load(folder).collect()}
    assert got == {(k, i): row.astype(float).tolist() for k, m in own.items() for i, row in enumerate(m)}
    assert spark.read.format("npy").load(f"{folder}/m1.npy").count() == 37


def test_filters_choose_files_and_ranges(spark, matrices):
    folder, own = matrices
    reader = FilteredNpyReader(folder, 100)
    rest = list(reader.pushFilters([EqualTo(("file",), "m0.npy"), GreaterThan(("gid",), 149), LessThanOrEqual(("gid",), 420), IsNotNull(("gid",))]))
    assert rest == [IsNotNull(("gid",))]
    assert [(p.name, p.first, p.end) for p in reader.partitions()] == [("m0.npy", 150, 250), ("m0.npy", 250, 350), ("m0.npy", 350, 421)]
    reader = FilteredNpyReader(folder, 100)
    assert not list(reader.pushFilters([In(("gid",), (3, 4, 5, 36, 900, 5000, None))]))
    assert [(p.name, p.first, p.end) for p in reader.partitions()] == [("m0.npy", 3, 6), ("m0.npy", 36, 37), ("m0.npy", 900, 901), ("m1.npy", 3, 6), ("m1.npy", 36, 37)]
    os.rename(f"{folder}/m0.npy", f"{folder}/m0.gone")  # a file that a filter leaves out isn't opened
    try:
        open(f"{folder}/m0.npy", "w").close()
        df = spark.read.format("npy").option("pushdown", True).load(folder).where((F.col("file") == "m1.npy") & (F.col("gid") == 36))
        assert [r.v for r in df.collect()] == [own["m1.npy"][36].tolist()]
        assert spark.read.format("npy").option("pushdown", True).load(folder).where("file = 'none'").count() == 0
    finally:
        os.rename(f"{folder}/m0.gone", f"{folder}/m0.npy")


def test_no_matrix(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros(3))
    with pytest.raises(Exception, match="row by row"):
        spark.read.format("npy").load(str(tmp_path)).collect()


def test_archives_are_committed_together(spark, tmp_path):
    data_sources.register(spark)
    folder = str(tmp_path / "zips")
    files = spark.range(50).select(F.concat(F.lit("f"), "id").alias("name"), F.concat(F.lit("é "), "id").alias("content"))
    files.repartition(4).write.format("zip_files").mode("append").save(folder)
    back = spark.read.format("zip_files").load(folder)
    assert {r.name: bytes(r.content).decode() for r in back.collect()} == {f"f{i}": f"é {i}" for i in range(50)}
    pushed = spark.read.format("zip_files").option("pushdown", True).load(folder).where("name in ('f3', 'f9')")
    assert len(os.listdir(folder)) == 4 and back.where("name in ('f3', 'f9')").count() == pushed.count() == 2
    bad = files.withColumn("content", F.when(F.col("name") == "f49", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(4, "name").write.format("zip_files").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 4 and back.count() == 50  # nothing of the aborted job, all of the one before
    files.limit(2).coalesce(1).write.format("zip_files").mode("overwrite").save(folder)
    assert spark.read.format("zip_files").load(folder).count() == 2 and len(os.listdir(folder)) == 1
    twice = files.limit(1).union(files.limit(1)).coalesce(1)
    with pytest.raises(Exception, match="comes twice"):
        twice.write.format("zip_files").mode("append").save(folder)
    assert len(os.listdir(folder)) == 1
