"""Shuffles of many small fixed-size records as few rows with packed columns.

Map tasks sort their records by bucket and emit one row for each bucket and batch; a reduce task gets whole
buckets. A row holds at most a batch's records, so nothing here grows with the input but the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, which the cluster sizes to its input."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Packer:
    """Collects arrays of equal length and gives them out as rows (bucket, one binary column per array)."""

    def __init__(self, names: list[str], buckets: int, limit: int = 1 << 19):
        self.names, self.buckets, self.limit = names, np.uint64(buckets), limit
        self.parts: list[list[np.ndarray]] = [[] for _ in names]
        self.n = 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        for own, a in zip(self.parts, arrays, strict=True):
            own.append(a)
        self.n += len(arrays[0])
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns = [np.concatenate(p) for p in self.parts]
        self.parts, self.n = [[] for _ in self.names], 0
        bucket = (columns[0] >> np.uint64(20)) % self.buckets
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(bucket)]
        columns = [c[order] for c in columns]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts].astype(np.int32)), *(pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in columns)],
            names=["bucket", *self.names],
        )


def by_bucket(df: DataFrame) -> DataFrame:
    """Whole buckets to tasks, in order of the bucket within a task."""
    return df.repartition(bucket_count(df), F.col("bucket")).sortWithinPartitions("bucket")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Groups of rows with one key, from rows in order of it."""
    held: list[pa.RecordBatch] = []
    last: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield last, held
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def unpack(rows: list[pa.RecordBatch], name: str, dtype: str) -> np.ndarray:
    out = []
    for r in rows:
        offsets, data = _binary(r.column(r.schema.get_field_index(name)))
        out.append(data[offsets[0] : offsets[-1]])
    return np.frombuffer(b"".join(x.tobytes() for x in out), dtype)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .words import text_buffers

    return text_buffers(column)
