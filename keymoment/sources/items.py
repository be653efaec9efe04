"""Item tables: loading by suffix, checks of their order, detections, pick lists, query files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keymoment.functions.arrays import round_binary

ITEM_SCHEMA = "video_id string, n int, frame_filename string, frame_idx long, pts_time double, fps double, rel_path string, abs_path string"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """An item table in order of gid, by suffix: parquet, jsonl, json (an array, whose position is the gid) or npz."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{ITEM_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").alias("x"))
        return rows.select(F.posexplode("x").alias("gid", "x")).select(F.col("gid").cast("long"), "x.*").fillna({"n": 1, "pts_time": 0.0})
    if kind == "npz":
        return _npz(spark, path)
    raise ValueError(f"no reader for .{kind}")


def _npz(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of equal length as columns; a row group for each file, read where the file's bytes are."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                z = np.load(io.BytesIO(raw), allow_pickle=False)
                n = len(z["frame_idx"])
                yield pd.DataFrame({"gid": range(n), "video_id": z["video_id"].astype(str), "frame_idx": z["frame_idx"].astype("int64"), "ts_ms": z["ts_ms"].astype("int64"), "shot_id": z["shot_id"].astype("int64"), "pos_in_shot": z["pos_in_shot"].astype("float64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "gid long, video_id string, frame_idx long, ts_ms long, shot_id long, pos_in_shot double")


#: Bytes of a matrix that one task reads at a time.
NPY_RANGE = 64 << 20


def read_npy(spark: SparkSession, path: str, piece: int = NPY_RANGE) -> DataFrame:
    """(file, gid, v): rows of two-dimensional .npy matrices as arrays of float, row numbers of a file as gid.

    Files are cut into ranges of whole rows by their headers, and a task reads its ranges only, so a matrix larger than memory is
    many tasks. Matrices in Fortran order aren't read.
    """
    import numpy as np

    from .files import open_folder

    def header(store, name: str) -> tuple[int, np.dtype, int, int]:
        with store.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if fortran or len(shape) != 2:
                raise ValueError(f"{name} isn't a matrix in C order")
            return f.tell(), kind, *shape

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                store, name = open_folder(uri)
                _, kind, n, d = header(store, name)
                step = max(1, piece // max(1, kind.itemsize * d))
                yield pd.DataFrame({"path": uri, "first": range(0, n, step), "rows": [min(step, n - i) for i in range(0, n, step)]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, first, rows in zip(frame["path"], frame["first"], frame["rows"], strict=True):
                store, name = open_folder(uri)
                start, kind, _, d = header(store, name)
                with store.open_input_file(name) as f:
                    f.seek(start + first * d * kind.itemsize)
                    m = np.frombuffer(f.read(rows * d * kind.itemsize), kind).reshape(rows, d)
                for a in range(0, rows, 4096):
                    part = m[a : a + 4096]
                    yield pd.DataFrame({"file": name.rpartition("/")[2], "gid": range(first + a, first + a + len(part)), "v": list(part.astype("float32"))})

    files = spark.read.format("binaryFile").load(path).select("path")
    ranges = files.mapInPandas(cut, "path string, first long, rows long").repartition("path", "first")
    return ranges.mapInPandas(read, "file string, gid long, v array<float>")


def with_vectors(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items with the vectors of their gid; rows without a partner on either side are an error of the caller's data."""
    return items.join(vectors, "gid")


def remap(items: DataFrame) -> DataFrame:
    """gid counted anew over videos in order of name and items in order of n, so that a video's are contiguous.

    The offset of a video is a running sum over videos, a row each, so no task gets all items.
    """
    sizes = items.groupBy("video_id").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("video_id").orderBy("n")
    return items.join(before.drop("_c"), "video_id").withColumn("gid", F.col("_o") + F.row_number().over(w) - 1).drop("_o")


def ranges(items: DataFrame) -> DataFrame:
    """First and last gid of each video, and whether its items are contiguous."""
    return items.groupBy("video_id").agg(F.min("gid").alias("s"), F.max("gid").alias("e"), F.count("*").alias("items")).withColumn("contiguous", F.col("e") - F.col("s") + 1 == F.col("items"))


def range_problems(r: DataFrame, total: int) -> DataFrame:
    """Problems of ranges(video_id, s, e): start, gap, overlap, tail, empty; one row each. Ranges are a row for each video."""
    w = Window.orderBy("s", "e")
    x = r.withColumn("_p", F.lag("e").over(w)).withColumn("_last", F.row_number().over(Window.orderBy(F.desc("s"), F.desc("e"))) == 1)
    kinds = [
        ((F.col("_p").isNull()) & (F.col("s") != 0), "start"),
        (F.col("s") > F.col("_p") + 1, "gap"),
        (F.col("s") <= F.col("_p"), "overlap"),
        (F.col("_last") & (F.col("e") != total - 1), "tail"),
        (F.col("e") < F.col("s"), "empty"),
    ]
    return x.select("video_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in kinds]))).alias("problem"))


def detection_postings(d: DataFrame, least: float) -> DataFrame:
    """(cls, gid, conf): the best confidence of each class in each item, at 2 places."""
    return d.where((F.col("conf") >= least) & (F.length("cls") >= 2)).groupBy("cls", "gid").agg(F.round(F.max("conf"), 2).alias("conf"))


def parse_picks(lines: DataFrame) -> DataFrame:
    """(id, query, video, frames, answer) of lines `query=VIDEO:FRAME[|F2|F3][:answer]`, several by `;`, comments from `#` on."""
    e = F.explode(F.split(F.regexp_replace("line", "#.*$", ""), ";"))
    p = lines.select("id", e.alias("p")).withColumn("p", F.trim("p")).where("p like '%=%'")
    at = F.split(F.expr("substr(p, instr(p, '=') + 1)"), ":", 3)
    return p.select("id", F.trim(F.substring_index("p", "=", 1)).alias("query"), F.trim(at[0]).alias("video"), F.transform(F.split(F.trim(at[1]), "[|]"), lambda x: x.cast("long")).alias("frames"), F.trim(F.get(at, F.lit(2))).alias("answer"))


def decode_text(raw: bytes) -> str:
    """A query file's text: of the codecs that decode it, the one whose text has most letters and fewest odd characters."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16").lstrip("﻿")
    best = (-1e18, "")
    for i, codec in enumerate(("utf-8-sig", "utf-16-le", "cp1258", "latin-1")):
        try:
            x = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        odd = sum(ord(c) < 32 and c not in "\r\n\t" for c in x) + x.count("�") + sum(0x3400 <= ord(c) <= 0x9FFF for c in x)
        score = (sum(c.isalpha() or c.isspace() for c in x) - 4 * odd) / max(1, len(x)) - 0.01 * i
        best = max(best, (score, x))
    return best[1]


def read_query_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of .txt files but translations (.en.txt, .vi.txt); a handful of small files each."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).where(~F.col("path").rlike("[.](en|vi)[.]txt$"))

    @F.pandas_udf(T.StringType())
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(decode_text)

    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), decoded("content").alias("text"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer rows of .csv files: file, pos, video_id, frame, answer."""
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("pos", "line"))
    c = F.split("line", ",", 3)
    return t.where("line <> ''").select("file", F.col("pos").cast("long"), c[0].alias("video_id"), F.expr("try_cast(split(line, ',', 3)[1] as long)").alias("frame"), F.get(c, F.lit(2)).alias("answer"))


MEDIA_INFO = "title string, description string, keywords array<string>, author string, publish_date string, watch_url string"


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, title, description, keywords, author, publish_date, watch_url) of JSON files named after their video, loose or in ZIPs."""
    import json
    import zipfile

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                members = [(name, raw)]
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        members = [(m, z.read(m)) for m in sorted(z.namelist()) if m.endswith(".json")]
                rows = []
                for m, x in members:
                    try:
                        o = json.loads(x)
                    except ValueError:
                        continue  # a broken file is left out
                    k = o.get("keywords") or []
                    rows.append({"video_id": m.rpartition("/")[2].rpartition(".")[0], **{c: o.get(c) for c in ("title", "description", "author", "publish_date", "watch_url")}, "keywords": k if isinstance(k, list) else [w.strip() for w in k.split(",")]})
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike("[.](json|zip)$")).select("path", "content")
    return files.mapInPandas(run, f"video_id string, {MEDIA_INFO}").select("video_id", "title", "description", "keywords", "author", "publish_date", "watch_url")


_CACHE = "map<string,array<array<string>>>"


def read_text_cache(spark: SparkSession, path: str, least: float = 0.35) -> DataFrame:
    """(video_id, frame_idx, text, confidence) of caches, one JSON object a video: frame -> [[text, confidence], ...]."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("video_id"), F.from_json("value", _CACHE).alias("m"))
    rows = raw.select("video_id", F.explode("m").alias("frame_idx", "found")).select("video_id", F.col("frame_idx").cast("long"), F.explode("found").alias("x"))
    return rows.select("video_id", "frame_idx", F.col("x")[0].alias("text"), F.col("x")[1].cast("double").alias("confidence")).where(F.col("confidence") >= least)


def extend_text_cache(fresh: DataFrame, folder: str, known: str | None = None) -> DataFrame:
    """Writes caches of fresh(video_id, frame_idx, found: array of (text, confidence)) to a folder and gives the list of files written.

    Confidences are kept at three places, rounded by their binary value. Frames that the cache at `known` holds stay as they are there, frames of fresh that it doesn't are added, a frame that was looked at
    and had no text is an empty list, so it isn't looked at again. Only videos with a new frame are written.
    """
    from .files import write_files

    spark = fresh.sparkSession
    pairs = F.transform("found", lambda x: F.array(x["text"], round_binary(x["confidence"], 3).cast("string")))
    new = fresh.select("video_id", F.col("frame_idx").cast("string").alias("frame"), pairs.alias("found"), F.lit(1).alias("turn"))
    if known is not None:
        raw = spark.read.text(known, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("video_id"), F.from_json("value", _CACHE).alias("m"))
        new = new.unionByName(raw.select("video_id", F.explode("m").alias("frame", "found"), F.lit(0).alias("turn")))
    first = new.groupBy("video_id", "frame").agg(F.min(F.struct("turn", "found")).alias("x"))
    video = first.groupBy("video_id").agg(F.max("x.turn").alias("turn"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("frame", "x.found")))).alias("m")).where("turn = 1")
    return write_files(video.select(F.concat("video_id", F.lit(".json")).alias("name"), F.to_json("m").alias("content")), folder)


def caption_cues(files: DataFrame) -> DataFrame:
    """(video_id, pos, start, text) of caption files(video_id, content) of timed events: the segments of an event joined, its start in
    seconds at two places; events without text go."""
    x = F.from_json("content", "events array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>")
    e = files.select("video_id", F.posexplode(x["events"]).alias("pos", "e"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), "^\\s+|\\s+$", ""))
    out = e.select("video_id", F.col("pos").cast("long"), F.round(F.coalesce("e.tStartMs", F.lit(0.0)) / 1000, 2).alias("start"), text.alias("text"))
    return out.where("text <> ''")


def read_transcripts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(video_id, title, segments) of transcript files of either shape ({segments, title} or [[start, text], ...]); of several folders
    the first that has a video wins, broken files are left out."""
    from keymoment.operators.joins import priority_rows

    seg = "array<struct<start:double,text:string>>"
    out = None
    for i, p in enumerate(paths):
        raw = spark.read.text(p, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("video_id"), "value", F.lit(i).alias("_p"))
        a = F.from_json("value", f"struct<segments:{seg},title:string>")
        b = F.transform(F.from_json("value", "array<array<string>>"), lambda x: F.struct(x[0].cast("double").alias("start"), x[1].alias("text")))
        is_list = F.ltrim("value").startswith("[")
        rows = raw.select("video_id", "_p", F.when(~is_list, a["title"]).alias("title"), F.when(is_list, b).otherwise(a["segments"]).alias("segments")).where("segments is not null")
        out = rows if out is None else out.unionAll(rows)
    return priority_rows(out, ["video_id"], [F.asc("_p")]).drop("_p")
