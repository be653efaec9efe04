"""Operator 7: media columns with content-addressed payloads in tar shards.

A text's UTF-8 bytes, filled up with 255 to a positive multiple of WIDTH, are a grey image of that width and 8 bits a
sample, kept losslessly as a PNG. Payloads are named by their SHA-256: copies are dropped within map tasks first
(a hot payload leaves each task a few times at most), then dealt by digest in compressed packs, and each is written once, to a tar
shard of its reduce task, in members that hold about PACK_BYTES of images. Rows carry digest, shard, offset and length. Width and height come from range reads of the
first 33 bytes of an entry; features from the pixels, read back by offset. Documents meet the stored payloads
in an equi-join on the digest, whose hot keys adaptive execution splits.

Defined cases: null text counts as empty (one row of 255); rows that repeat, or texts that are equal, share a payload
and all values; a null doc_id stays null; extra columns are ignored. A repeated task writes a new shard, and only shards of the
committed index are read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_count
from .lean import lean
from .store import new_path, open_fs, written

WIDTH, LEVEL, SHARD_BYTES, PACK_BYTES, READ_BYTES = 576, 6, 256 << 20, 1 << 20, 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    """raw, filled up with 255 to a positive multiple of width."""
    return raw + b"\xff" * (-(-max(len(raw), 1) // width) * width - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG")
    return struct.unpack(">II", head[16:24])


def from_png(data: bytes) -> bytes:
    """The samples of an image made by to_png()."""
    width, height = png_size(data[:33])
    at, parts = 33, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(payload: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and the shares of eight equal ranges of sample values, in thousandths."""
    v = np.frombuffer(payload, np.uint8)
    share = np.bincount(v >> 5, minlength=8) * 1000 // len(v)
    return f"grey8 {width}x{height} mean {v.mean():.3f} sd {v.std():.3f} hist {'.'.join(map(str, share.tolist()))}"


def _padded(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("long") * WIDTH


def _described(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    payload = F.concat(raw, F.unhex(F.repeat(F.lit("FF"), (_padded(n) - n).cast("int"))))
    return docs.select(F.col("doc_id").cast("long"), n.alias("n_bytes"), _padded(n).alias("payload_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"))


class Shard:
    """A tar of packs: members that hold images end to end, named by the SHA-256 of what they hold. A member to each image would
    add a header and padding of about half an image's size."""

    def __init__(self, folder: str):
        self.fs, self.where = open_fs(folder)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.path = f"{folder}/{self.name}"
        self.stream, self.at, self.rows, self.held, self.size = None, 0, [], [], 0

    def add(self, digest: bytes, media: bytes) -> None:
        self.held.append((digest, media))
        self.size += len(media)
        if self.size > PACK_BYTES:
            self._write()

    def _write(self) -> None:
        if self.stream is None:
            self.fs.create_dir(self.where, recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.where}/{self.name}")
        pack = b"".join(m for _, m in self.held)
        info = tarfile.TarInfo(f"{hashlib.sha256(pack).hexdigest()}.pngs")
        info.size = len(pack)
        head = info.tobuf()
        self.stream.write(head + pack + b"\0" * (-len(pack) % 512))
        at = self.at + len(head)
        for digest, media in self.held:
            self.rows.append((digest, at, len(media)))
            at += len(media)
        self.at += len(head) + len(pack) + -len(pack) % 512
        self.held, self.size = [], 0

    def close(self) -> pa.RecordBatch:
        """Ends the tar and gives its index."""
        if self.held:
            self._write()
        self.stream.write(b"\0" * 1024)
        self.stream.close()
        d, o, n = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array([self.path] * len(d)), pa.array(o, pa.int64()), pa.array(n, pa.int64())], names=["digest", "shard", "offset", "length"])


def store_payloads(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores docs(text) and returns the committed index: digest, shard, offset, length."""
    folder = folder or new_path(docs.sparkSession, "media")

    buckets = bucket_count(docs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0
        codec = pa.Codec("zstd", compression_level=6)

        def out() -> pa.RecordBatch:
            names, sizes, texts = [], [], []
            for own in held.values():
                names.append(b"".join(n for n, _ in own))
                sizes.append(np.array([len(x) for _, x in own], "<u8").tobytes())
                texts.append(codec.compress(b"".join(x for _, x in own), asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array(x, pa.binary()) for x in (names, sizes, texts))], names=["bucket", "names", "sizes", "texts"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                raw = (x or "").encode()
                name = hashlib.sha256(padded(raw)).digest()
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                held.setdefault(int.from_bytes(name[:4], "little") % buckets, []).append((name, raw))
                size += len(raw)
                if size > 32 << 20:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        shard = Shard(folder)
        codec = pa.Codec("zstd")
        for batch in batches:
            for names, sizes, texts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                sizes = np.frombuffer(sizes, "<u8").tolist()
                texts = memoryview(codec.decompress(texts, sum(sizes), asbytes=True)) if sum(sizes) else memoryview(b"")
                place = 0
                for i, n in enumerate(sizes):
                    key, raw = names[32 * i : 32 * i + 32], bytes(texts[place : place + n])
                    place += n
                    if key not in seen:
                        seen.add(key)
                        shard.add(key, to_png(padded(raw)))
                if shard.at > SHARD_BYTES:
                    yield shard.close()
                    shard = Shard(folder)
        if shard.rows or shard.held:
            yield shard.close()

    made = docs.select("text").mapInArrow(lean(make), "bucket int, names binary, sizes binary, texts binary")
    index = made.repartition(buckets, "bucket").mapInArrow(lean(store), "digest binary, shard string, offset long, length long")
    return written(index, "media-index")


def _read(index: DataFrame, each: Callable[[Callable[[int], bytes], int], tuple], schema: str) -> DataFrame:
    """Index rows with the columns that each(read, length) gives, in order of shard and offset; read(n) reads an entry's first n bytes."""
    kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = "", None
        for batch in batches:
            rows = []
            for shard, at, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if shard != last:
                    if file:
                        file.close()
                    fs, where = open_fs(shard)
                    last, file = shard, fs.open_input_file(where)
                rows.append(each(lambda k, at=at: file.read_at(k, at), n))
            columns = [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *kinds.names])
        if file:
            file.close()

    stored = index.agg(F.sum("length")).first()[0] or 0  # a task for each READ_BYTES of entries, however small the index is
    tasks = max(bucket_count(index), -(-stored // READ_BYTES))
    dealt = index.select("digest", "shard", "offset", "length").repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(lean(run), f"digest binary, shard string, offset long, length long, {schema}")


def header_columns(index: DataFrame) -> DataFrame:
    """The index with width and height, from range reads of 33 bytes an entry."""
    return _read(index, lambda read, n: png_size(read(33)), "width long, height long")


def stored_columns(index: DataFrame) -> DataFrame:
    """The index with width and height, from a range read of the header, and payload_sha256, tail_crc32, media_bytes, media_sha256
    and feature, from the whole entry read back."""

    def each(read: Callable[[int], bytes], n: int) -> tuple:
        width, height = png_size(read(33))
        media = read(n)
        payload = from_png(media)
        return width, height, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, width, height)

    return _read(index, each, "width long, height long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Each document's digest, place (shard, offset, length), size from the header, and what its stored payload says."""
    rows = _described(docs).join(stored_columns(store_payloads(docs)), "digest", "left")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height")
