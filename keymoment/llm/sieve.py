"""A set of hashes in a file of bounded size, that passes all of them and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buckets import Packer, runs, unpack
from .lean import lean
from .store import new_path, open_fs

#: Bits for each hash, up to MOST_BITS in all (more hashes only let more others pass), in PIECES parts.
BITS, MOST_BITS, PIECES = 24, 1 << 28, 16
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HELD: dict[str, Sieve] = {}


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bits of each hash in its piece, which has so many."""
    with np.errstate(over="ignore"):
        for k in _ODD:
            yield ((h * k) >> np.uint64(33)) % np.uint64(bits)


class Sieve:
    """The bits of a sieve's folder."""

    def __init__(self, path: str, bits: int):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, where = open_fs(path)
        self.bits, data = bits, np.zeros((PIECES, bits // 8), np.uint8)
        for f in fs.get_file_info(FileSelector(where)):
            if f.base_name.endswith(".parquet"):
                t = pq.read_table(f.path, filesystem=fs)
                for k, x in zip(t["bucket"].to_pylist(), t["bits"], strict=True):
                    data[k] = np.frombuffer(x.as_buffer(), np.uint8)
        self.data = data.reshape(-1)

    @staticmethod
    def of(path: str, bits: int) -> Sieve:
        """The sieve of a folder; a worker keeps the last few."""
        if path not in _HELD:
            while len(_HELD) >= 4:
                _HELD.pop(next(iter(_HELD)))
            _HELD[path] = Sieve(path, bits)
        return _HELD[path]

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set."""
        out = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for k in range(3):
            own = h[left]
            at = [*_probes(own, self.bits)][k] + (own >> np.uint64(20)) % np.uint64(PIECES) * np.uint64(self.bits)
            left = left[(self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        out[left] = True
        return out


def sieve_of(hashes: DataFrame, n: int) -> tuple[str, int]:
    """(folder, bits of a piece) of the sieve of a table of n hashes (column h)."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS * max(n, 1) - 1).bit_length())) // PIECES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(["h"], PIECES)
        for batch in batches:
            yield from pack.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from pack.flush()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in runs(batches, "bucket"):
            held = np.zeros(bits, bool)
            for row in rows:
                for at in _probes(unpack([row], "h", "<u8"), bits):
                    held[at.astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    path = new_path(hashes.sparkSession, "sieve")
    rows = hashes.select("h").mapInArrow(lean(deal), "bucket int, h binary").repartition("bucket").sortWithinPartitions("bucket")
    rows.mapInArrow(lean(mark), "bucket int, bits binary").write.parquet(path)
    return path, bits
