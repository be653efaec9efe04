"""Folders of pictures: paths as columns, and vectors by a function of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a picture's file name ends in, in any case, and the pictures that an encoder gets at once.
SUFFIXES, BATCH = ("jpg", "jpeg", "png"), 64


def scan_pictures(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """video_id, frame_filename, frame_idx, rel_path, path, bytes of the pictures in the folders of `folder`, with n or, if asked for, their content.

    A picture is a file `<video>/<name>.<suffix>`; files elsewhere and other files are left out. frame_idx is the name as a whole number, 0
    where it is none; n counts a video's pictures from 1 in the order of their names. Without content no file is opened; with it there is no n, as counting
    would sort the contents. A folder that has no picture gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    name, video = F.element_at(parts, -1), F.element_at(parts, -2)
    top = F.lit("/" + folder.rstrip("/").rpartition("/")[2] + "/")
    rel = F.concat_ws("/", video, name)
    number = F.regexp_replace(F.regexp_extract(name, r"^\s*([+-]?[0-9]+(?:_[0-9]+)*)\s*\.[^.]*$", 1), "_", "")
    x = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES) & F.contains(name, F.lit(".")) & F.endswith(F.col("path"), F.concat(top, rel)))
    x = x.select(video.alias("video_id"), name.alias("frame_filename"), F.coalesce(number.try_cast("long"), F.lit(0).cast("long")).alias("frame_idx"), rel.alias("rel_path"), "path", F.col("length").alias("bytes"), *(["content"] if content else []))
    if content:
        return x
    return x.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_filename")).cast("long"))


def encode_pictures(pictures: DataFrame, encode: Callable[[list[bytes]], np.ndarray], batch: int = BATCH, content: str = "content") -> DataFrame:
    """pictures with v (array<float>, of length 1) in place of their content.

    `encode` gets the contents of `batch` pictures, fewer at a partition's end only, and gives a row of numbers for each; a row of NaN
    stands for a picture that it can't read, whose v is null, as is that of a null content, which it never sees. A row of zeros stays so.
    """
    fields = [c for c in pictures.columns if c != content]
    schema = pictures.select(*fields).schema.add("v", T.ArrayType(T.FloatType()))

    def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in pdfs:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            full = len(held) // batch * batch
            for i in range(0, full, batch):
                yield held.iloc[i : i + batch]
            held = held.iloc[full:]
        if held is not None and len(held):
            yield held

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows(pdfs):
            out: list[np.ndarray | None] = [None] * len(part)
            known = [i for i, c in enumerate(part[content]) if c is not None]
            if known:
                m = np.asarray(encode([bytes(part[content].iloc[i]) for i in known]), np.float64)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = (m / np.where(norm == 0, 1.0, norm)).astype(np.float32)
                for i, v in zip(known, m, strict=True):
                    out[i] = None if np.isnan(v).any() else v
            yield part[fields].assign(v=out)

    return pictures.select(*fields, content).mapInPandas(run, schema)
