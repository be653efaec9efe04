"""Small files in a folder that driver and executors share: written by tasks, read by ranges."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


#: Spark's setting by which a query's shuffle files go when it has ended, and not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files behind; one that needs them again makes them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder of this machine only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="keymoment-"))
        found = _LOCAL[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str):
    """(pyarrow filesystem, path in it); plain paths are local ones."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes each row of df(name, content) as a file of its own and gives (name, bytes). A name may have folders.

    A file is written under a temporary name and then moved, so a task that is run again leaves whole files only. This runs while the plan
    is built; what is returned reads the list of what was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        made: set[str] = set()
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                parent, _, leaf = f"{base}/{name}".rpartition("/")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{leaf}-{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    done = df.select("name", F.col("content").cast("binary")).mapInArrow(run, "name string, bytes long")
    listing = f"{folder}.list"
    done.write.parquet(listing)
    return df.sparkSession.read.schema("name string, bytes long").parquet(listing)
