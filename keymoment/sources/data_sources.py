"""Formats of spark.read and spark.write: "npy" reads rows of matrices by byte range, "zip_files" writes and reads archives of small files.

register() adds both to a session. With option pushdown=true, filters on file and gid (npy) or archive and name (zip_files) reach the reader: files that can't
match aren't opened, and of the others only the ranges of matching rows or members are read. Spark 4.1 keeps the filters that one query pushed in the
loaded relation, for later queries on it too, so load anew for each query with that option; without it a relation can be used any number of times.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .files import open_folder


def register(spark: SparkSession) -> None:
    """Adds the formats to a session, and turns on its setting that lets Python sources see filters (no other source reads that setting)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NpySource, ZipSource):
        spark.dataSource.register(source)


def _listed(path: str, suffix: str) -> list[tuple[str, str]]:
    """(name, path in its store) of a file, or of a folder's files with a suffix, in order."""
    from pyarrow.fs import FileSelector, FileType

    fs, where = open_folder(path)
    own = fs.get_file_info(where)
    found = [own] if own.type == FileType.File else fs.get_file_info(FileSelector(where, allow_not_found=True))
    return sorted((f.base_name, f.path) for f in found if f.type == FileType.File and f.base_name.endswith(suffix))


class _Names:
    """What filters leave of a column of names: None for all."""

    def __init__(self) -> None:
        self.left: set[str] | None = None

    def take(self, f: Filter) -> bool:
        if isinstance(f, EqualTo):
            wanted = {f.value}
        elif isinstance(f, In):
            wanted = set(f.value)
        else:
            return False
        self.left = wanted if self.left is None else self.left & wanted
        return True

    def has(self, name: str) -> bool:
        return self.left is None or name in self.left


class _Rows:
    """What filters leave of row numbers: those from low, below high, and of `left` unless it is None."""

    def __init__(self) -> None:
        self.low, self.high = 0, 1 << 62
        self.left: set[int] | None = None

    def take(self, f: Filter) -> bool:
        if isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.left = wanted if self.left is None else self.left & wanted
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
        else:
            return False
        return True

    def runs(self, n: int) -> list[tuple[int, int]]:
        """Runs of the rows that are left of n."""
        low, high = self.low, min(self.high, n)
        if self.left is None:
            return [(low, high)] if low < high else []
        rows = np.array(sorted(x for x in self.left if x is not None and low <= x < high), np.int64)
        if not len(rows):
            return []
        cuts = np.flatnonzero(np.diff(rows) > 1) + 1
        return [(int(x[0]), int(x[-1]) + 1) for x in np.split(rows, cuts)]


class NpyPart(InputPartition):
    """Rows [first, end) of a matrix."""

    def __init__(self, name: str, path: str, dtype: str, width: int, offset: int, first: int, end: int):
        self.name, self.path, self.dtype, self.width, self.offset, self.first, self.end = name, path, dtype, width, offset, first, end


class NpySource(DataSource):
    """Two-dimensional .npy matrices of a file or folder: file, gid (the row's number in its file) and v.

    Option rows: the rows of a partition. The driver reads each matching file's header, nothing else.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, gid long, v array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        kind = FilteredNpyReader if self.options.get("pushdown", "false").lower() == "true" else NpyReader
        return kind(self.options["path"], int(self.options.get("rows", 65536)))


class NpyReader(DataSourceReader):
    #: Rows that become one Arrow batch.
    BATCH = 4096

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.files, self.gids = _Names(), _Rows()

    def partitions(self) -> list[NpyPart]:
        fs, _ = open_folder(self.path)

        def header(file: tuple[str, str]) -> list[NpyPart]:
            name, path = file
            with fs.open_input_file(path) as f:
                version = np.lib.format.read_magic(f)
                shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                offset = f.tell()
            if len(shape) != 2 or by_column or dtype.hasobject:
                raise ValueError(f"{name}: a matrix of numbers, row by row, is needed")
            runs = self.gids.runs(shape[0])
            return [NpyPart(name, path, dtype.str, shape[1], offset, a, min(a + self.rows, end)) for first, end in runs for a in range(first, end, self.rows)]

        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(header, [x for x in _listed(self.path, ".npy") if self.files.has(x[0])]) for p in parts]

    def read(self, part: NpyPart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partition at all
            return
        fs, _ = open_folder(self.path)
        size = np.dtype(part.dtype).itemsize * part.width
        with fs.open_input_file(part.path) as f:
            for a in range(part.first, part.end, self.BATCH):
                b = min(a + self.BATCH, part.end)
                data = f.read_at((b - a) * size, part.offset + a * size)
                m = np.frombuffer(data, part.dtype).astype(np.float64)
                offsets = np.arange(b - a + 1, dtype=np.int32) * part.width
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.name), b - a), pa.array(np.arange(a, b)), pa.ListArray.from_arrays(offsets, m)], names=["file", "gid", "v"])


class FilteredNpyReader(NpyReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            done = (column == ("file",) and self.files.take(f)) or (column == ("gid",) and self.gids.take(f))
            if not done:
                yield f


class ZipPart(InputPartition):
    def __init__(self, name: str, path: str):
        self.archive, self.path = name, path


class ZipSource(DataSource):
    """Archives of small files: archive, name and content. A task writes one archive; a read has a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "zip_files"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def reader(self, schema: StructType) -> ZipReader:
        return (FilteredZipReader if self.options.get("pushdown", "false").lower() == "true" else ZipReader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], self.options.get("prefix", ""), schema.names, overwrite)


class ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.archives, self.names = _Names(), _Names()

    def partitions(self) -> list[ZipPart]:
        return [ZipPart(*x) for x in _listed(self.path, ".zip") if self.archives.has(x[0])]

    def read(self, part: ZipPart | None) -> Iterator[tuple[str, str, bytes]]:
        if part is None:
            return
        fs, _ = open_folder(self.path)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            for member in z.infolist():
                if not member.is_dir() and self.names.has(member.filename):
                    yield part.archive, member.filename, z.read(member)


class FilteredZipReader(ZipReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if not ((column == ("archive",) and self.archives.take(f)) or (column == ("name",) and self.names.take(f))):
                yield f


class Written(NamedTuple):
    archive: str
    files: int


class ZipMessage(WriterCommitMessage):
    def __init__(self, written: list[Written]):
        self.written = written


class ZipWriter(DataSourceWriter):
    """Rows of (name, content) as members of a task's archive, in order of arrival, under a prefix.

    Archives are written in a hidden folder beside the others and moved when all tasks are done, so a job that fails leaves nothing and a
    task that runs twice leaves one archive. A name that comes twice in a task is an error.
    """

    def __init__(self, path: str, prefix: str, columns: list[str], overwrite: bool):
        if not {"name", "content"} <= set(columns):
            raise ValueError("columns name and content are needed")
        self.path, self.prefix, self.overwrite = path, prefix, overwrite
        self.staging = f"{path.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> ZipMessage:
        fs, where = open_folder(self.staging)
        archive, names = f"part-{uuid.uuid4().hex}.zip", set()
        out = io.BytesIO()  # members are small files; a task's archive is its rows
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                if row.name in names:
                    raise ValueError(f"{row.name} comes twice")
                names.add(row.name)
                z.writestr(zipfile.ZipInfo(self.prefix + row.name), row.content if isinstance(row.content, str) else bytes(row.content))
        if not names:
            return ZipMessage([])
        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/{archive}") as f:
            f.write(out.getvalue())
        return ZipMessage([Written(archive, len(names))])

    def commit(self, messages: list[ZipMessage | None]) -> None:
        fs, where = open_folder(self.path)
        fs.create_dir(where, recursive=True)
        if self.overwrite:
            for _, old in _listed(self.path, ".zip"):
                fs.delete_file(old)
        _, staged = open_folder(self.staging)
        for w in (w for m in messages if m for w in m.written):
            fs.move(f"{staged}/{w.archive}", f"{where}/{w.archive}")
        self._clear()

    def abort(self, messages: list[ZipMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, staged = open_folder(self.staging)
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)
