"""Answer files: lines, batches, CSV and ZIP writers, the verifier."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keymoment.functions.text import csv_name, sanitise

MOST_ROWS = 100


def answer_line(video: Column, frames: Column, answer: Column | None = None) -> Column:
    """video,f1..fN[,answer]"""
    parts = [sanitise(video), F.array_join(F.transform(frames, lambda f: f.cast("string")), ",")]
    line = F.concat_ws(",", *parts)
    return line if answer is None else F.when(answer.isNull(), line).otherwise(F.concat_ws(",", line, sanitise(answer)))


def ndjson_batches(df: DataFrame, keys: list[str], order: str, size: int = 8) -> DataFrame:
    """(keys, batch, rows): rows of each key in order, `size` to a batch, as JSON arrays."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    x = df.withColumn("batch", F.floor(i / size)).withColumn("_i", i)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_i", F.struct(*[c for c in df.columns if c not in keys]).alias("row")))), lambda r: r["row"])
    return x.groupBy(*keys, "batch").agg(F.to_json(rows).alias("rows"))


def stamped_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each query's rows with its first answer that isn't empty (answers by query_id, pos, answer)."""
    first = answers.where(F.trim("answer") != "").groupBy("query_id").agg(F.min_by("answer", "pos").alias("answer"))
    return rows.join(first, "query_id", "left")


def row_problems(lines: DataFrame) -> DataFrame:
    """(file, problem, severity, n) of lines(file, pos, line): the rules for answer rows that can be judged line by line or by file."""
    f = F.split("line", ",")
    task = F.when(F.col("file").rlike("(?i)qa|vqa"), "qa").when(F.col("file").rlike("(?i)trake"), "trake").otherwise("kis")
    x = lines.withColumn("w", F.size(f)).withColumn("task", task)
    rules = [
        (F.col("w") < 2, "few fields", "error"),
        (~F.get(f, F.lit(1)).rlike("^-?[0-9]+$") & (F.col("w") >= 2), "frame", "error"),
        (F.contains("line", F.lit(".mp4")), "suffix", "error"),
        (F.contains("line", F.lit('"')), "quote", "error"),
        (F.contains("line", F.lit("\r")), "line end", "error"),
        (F.col("line").startswith("﻿"), "byte order mark", "error"),
        ((F.col("task") == "qa") & ((F.col("w") < 3) | (F.trim(F.coalesce(F.get(f, F.lit(2)), F.lit(""))) == "")), "no answer", "error"),
        ((F.col("task") == "trake") & (F.col("w") == 2), "one event", "error"),
    ]
    by_row = x.select("file", F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("problem"), F.lit(s).alias("severity"))) for c, p, s in rules]))).alias("p")).groupBy("file", "p.problem", "p.severity").agg(F.count("*").alias("n"))
    size = x.groupBy("file").agg(F.count("*").alias("n"), (F.min("w") != F.max("w")).alias("uneven"), F.first("task").alias("task"))
    by_file = size.select("file", F.explode(F.array_compact(F.array(
        F.when(F.col("n") > MOST_ROWS, F.struct(F.lit("too many rows").alias("problem"), F.lit("error").alias("severity"))),
        F.when(F.col("n") < MOST_ROWS, F.struct(F.lit("fewer rows than allowed").alias("problem"), F.lit("note").alias("severity"))),
        F.when(F.col("uneven") & (F.col("task") == "trake"), F.struct(F.lit("uneven width").alias("problem"), F.lit("error").alias("severity"))),
    ))).alias("p"), "n").select("file", "p.problem", "p.severity", "n")
    return by_row.unionByName(by_file)


def name_problems(got: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, problem): answer files that are missing or extra for query files (column name)."""
    want = wanted.select(csv_name(F.col("name")).alias("file")).distinct()
    have = got.select("file").distinct()
    return want.join(have, "file", "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(want, "file", "left_anti").withColumn("problem", F.lit("extra")))


def write_query_csv(rows: Iterable[tuple], path: str) -> None:
    """One query's answer rows (at most a hundred): no header, UTF-8, LF."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def package(files: dict[str, str], folder: str = "submission") -> bytes:
    """A ZIP of answer files by name, in order of name, within a folder."""
    if not files:
        raise ValueError("there is nothing to package")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(f"{folder}/{name}"), files[name])
    return out.getvalue()


def packages(files: DataFrame, size: int = 1000) -> DataFrame:
    """(name, content) of ZIPs of files(pos, name, content), `size` files by pos to each, made by tasks."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = package(dict(zip(pdf["name"], pdf["content"], strict=True)))
        return pd.DataFrame({"name": [f"submission-{pdf['block'].iloc[0]:05d}.zip"], "content": [raw]})

    return files.withColumn("block", F.floor(F.col("pos") / size)).groupBy("block").applyInPandas(run, "name string, content binary")


def zip_lines(df: DataFrame) -> DataFrame:
    """(file, pos, line) of the members of ZIPs given as binaryFile rows (content)."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(z.namelist()):
                        lines = z.read(name).decode("utf-8", "replace").split("\n")
                        lines = lines[:-1] if lines[-1] == "" else lines
                        yield pd.DataFrame({"file": name.rpartition("/")[2], "pos": range(len(lines)), "line": lines})

    return df.select("content").mapInPandas(run, "file string, pos long, line string")
