"""Answer rows under a budget: ladders, cost slots, coverage, lattices, tails."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import gathered

BUDGET, STEP, DEPTH = 100, 10, 24
BREADTH_COST, DEPTH_COST, FLAT = 1.0, 0.5, 30
#: What fills up a coverage answer: flat candidates and depth cost of the plain plan.
TAIL_FLAT, PLAIN_DEPTH_COST = 20, 0.75


def ladder_offset(d: Column, step: int = STEP) -> Column:
    """0, -step, +step, -2 step, ...: the d-th place of a ladder."""
    return F.when(d % 2 == 1, -F.ceil(d / 2)).otherwise(F.ceil(d / 2)) * step


def frame_ladder(df: DataFrame, centre: str, n: int, step: int = STEP, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Each row with the first n frames of its ladder within [lo, hi] as frame, in order as depth. The ladder stops at 4 n steps."""
    x = df.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(8 * n)))).withColumn("frame", F.col(centre) + ladder_offset(F.col("_d"), step))
    if lo:
        x = x.where(F.col("frame") >= F.col(lo))
    if hi:
        x = x.where(F.col(hi).isNull() | (F.col("frame") <= F.col(hi)))
    w = Window.partitionBy(*df.columns).orderBy("_d")
    return x.withColumn("depth", F.row_number().over(w) - 1).where(F.col("depth") < n).drop("_d")


def _first_places(slots: DataFrame, order: list[str], budget: int) -> DataFrame:
    """Slots in order, each (query, video, frame) once, `budget` at most; rank counts from 1."""
    w = Window.partitionBy("query_id", "video_id", "frame").orderBy(*order)
    once = slots.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= budget).drop("_r")


def cost_slots(c: DataFrame, breadth: float = BREADTH_COST, depth: float = DEPTH_COST, step: int = STEP, most: int = DEPTH) -> DataFrame:
    """Ladder slots of candidates (query_id, pos, video_id, frame_idx, last_frame) with their cost breadth * pos + depth * place."""
    x = c.select("query_id", "pos", "video_id", "frame_idx", "last_frame", F.lit(0).alias("_zero"))
    x = x.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(8 * most)))).withColumn("frame", F.col("frame_idx") + ladder_offset(F.col("_d"), step))
    x = x.where((F.col("frame") >= 0) & (F.col("last_frame").isNull() | (F.col("frame") <= F.col("last_frame"))))
    x = x.withColumn("depth", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("_d")) - 1).where(F.col("depth") < most)
    return x.withColumn("cost", breadth * F.col("pos") + depth * F.col("depth")).drop("_d", "_zero")


def moment_rows(c: DataFrame, budget: int = BUDGET, **plan: float) -> DataFrame:
    """(query_id, rank, video_id, frame): the cheapest slots, each frame once. pos counts from 0."""
    return _first_places(cost_slots(c, **plan), ["cost", "pos", "depth"], budget).select("query_id", "rank", "video_id", "frame")


def hybrid_rows(c: DataFrame, budget: int = BUDGET, flat: int | Column = FLAT, **plan: float) -> DataFrame:
    """The first `flat` candidates' own frames, then cost slots (of three budgets) that aren't among them. flat is a number or, where it
    differs by query, a column of c."""
    head = c.where(F.col("pos") < flat).select("query_id", "video_id", F.col("frame_idx").alias("frame"), F.lit(0).alias("phase"), F.col("pos").cast("long").alias("place"))
    tail = moment_rows(c, 3 * budget, **plan).select("query_id", "video_id", "frame", F.lit(1).alias("phase"), F.col("rank").cast("long").alias("place"))
    return _first_places(gathered([head, tail], ["query_id"]), ["phase", "place"], budget).select("query_id", "rank", "video_id", "frame")


def video_rows(c: DataFrame, budget: int = BUDGET, by_video: float = 1.0, by_item: float = 0.5, by_depth: float = 0.5, step: int = STEP, most: int = DEPTH) -> DataFrame:
    """Slots by cost a * (video's place) + b * (item's place in it) + c * depth."""
    first = c.withColumn("_f", F.min("pos").over(Window.partitionBy("query_id", "video_id")))
    x = first.withColumn("_v", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_f")) - 1).withColumn("_m", F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("pos")) - 1)
    s = cost_slots(c, 0.0, by_depth, step, most).join(x.select("query_id", "pos", "_v", "_m"), ["query_id", "pos"]).withColumn("cost", by_video * F.col("_v") + by_item * F.col("_m") + F.col("cost"))
    return _first_places(s, ["cost", "pos", "depth"], budget).select("query_id", "rank", "video_id", "frame")


def reserve_tail(rows: DataFrame, extra: DataFrame, budget: int = BUDGET) -> DataFrame:
    """rows(query_id, rank, video_id, frame) with the extras that aren't among them in the last places: the head keeps
    budget - (number of new extras) rows."""
    key = ["query_id", "video_id", "frame"]
    fresh = extra.join(rows.select(*key), key, "left_anti").withColumn("_e", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    n = fresh.groupBy("query_id").agg(F.count("*").alias("_n"))
    head = rows.join(n, "query_id", "left").where(F.col("rank") <= budget - F.least(F.coalesce("_n", F.lit(0)), F.lit(budget)))
    fresh = fresh.where(F.col("_e") <= budget).select(*key, F.lit(1).alias("_p"), F.col("_e").cast("long").alias("_o"))
    both = gathered([head.select(*key, F.lit(0).alias("_p"), F.col("rank").cast("long").alias("_o")), fresh], ["query_id"])
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "_o"))).drop("_p", "_o")


def pinned_rows(c: DataFrame, pin: DataFrame, budget: int = BUDGET, share: int = 50, how: str = "coverage") -> DataFrame:
    """Answers whose video a person has confirmed: `share` rows of it first, then rows of the other videos.

    pin(query_id, video_id, frames, last_frame) has the confirmed frames in order, or none. With one frame it leads and all else of its
    share is the ladder around it and around the video's candidates; with several each leads flat; without one the video's candidates
    are allocated as any others, by `how`, as are the other videos' candidates.
    """
    pin = pin.select("query_id", F.col("video_id").alias("_v"), F.array_distinct(F.coalesce("frames", F.array().cast("array<long>"))).alias("_f"), F.col("last_frame").alias("_l"))
    x = c.join(pin, "query_id")
    lead = pin.select("query_id", "_f", F.posexplode("_f").alias("_i", "frame_idx"), F.col("_v").alias("video_id"), F.col("_l").alias("last_frame"), F.lit(0).alias("_g"), F.lit(1e9).alias("score"))
    own = x.where((F.col("video_id") == F.col("_v")) & ~F.array_contains("_f", F.col("frame_idx"))).select("query_id", "_f", F.col("pos").alias("_i"), "frame_idx", "video_id", "last_frame", F.lit(1).alias("_g"), "score")
    order = Window.partitionBy("query_id").orderBy("_g", "_i")
    both = gathered([lead, own], ["query_id"]).withColumn("pos", F.row_number().over(order) - 1)
    named = F.size("_f") > 0
    first = [hybrid_rows(both.where(named), share, F.size("_f")), allocate(both.where(~named), how, share)]
    others = x.where(F.col("video_id") != F.col("_v")).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1)
    rows = gathered([*(f.withColumn("_p", F.lit(0)) for f in first), allocate(others, how, budget).withColumn("_p", F.lit(1))], ["query_id"]).withColumnRenamed("rank", "_o")
    return _first_places(rows, ["_p", "_o"], budget).select("query_id", "rank", "video_id", "frame")


def coverage(frames: list[int], scores: list[float], videos: list[str], last: list[int | None], budget: int = BUDGET, heat: float = 0.02, sigma: float = 30.0, grid: int = 5, half: int = 6) -> list[tuple[str, int]]:
    """Greedy coverage of the moment's probable places: a softmax prior over candidates, spread by a Gaussian on each video's
    grid; the next row is the cell whose window holds most mass, first of equals, and empties its window. Only cells within a candidate's
    reach are held, so time and memory follow the candidates and not the videos' lengths."""
    if not frames:
        return []
    x = np.array([round(s, 4) for s in scores])
    prior = np.exp((x - x.max()) / heat)
    prior /= prior.sum()
    order: list[str] = list(dict.fromkeys(videos))
    cells = max(1, half // grid)
    own: dict[str, tuple[np.ndarray, ...]] = {}
    reach = 39 * sigma  # beyond it a Gaussian is zero in double precision
    for v in order:
        at = [i for i, y in enumerate(videos) if y == v]
        f = np.array([frames[i] for i in at], float)
        lo = max(0, math.floor(f.min() - 4 * sigma))
        hi = math.floor(f.max() + 4 * sigma)
        ends = [last[i] for i in at]
        if None not in ends:  # with a candidate whose video's end isn't known the grid is open
            hi = min(max(ends), hi)
        n = (max(lo, hi) - lo) // grid + 1
        a = np.clip(np.ceil((f - reach - lo) / grid), 0, n).astype(int)
        e = np.clip(np.floor((f + reach - lo) / grid) + 1, a, n).astype(int)
        held = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(a, e, strict=True)]))
        m = np.zeros(len(held))
        for i, x, y in zip(range(len(at)), np.searchsorted(held, a), np.searchsorted(held, e), strict=True):
            m[x:y] += prior[at[i]] * np.exp(-0.5 * (((lo + held[x:y] * grid) - f[i]) / sigma) ** 2)
        m = np.floor(m / 1e-9 + 0.5) * 1e-9
        some = held[m > 0]
        keep = np.unique(np.concatenate([some + i for i in range(-cells, cells + 1)]))
        keep = keep[(keep >= 0) & (keep < n)]
        mass = np.zeros(len(keep))
        mass[np.searchsorted(keep, some)] = m[m > 0]
        own[v] = lo + keep * grid, mass, np.searchsorted(keep, keep - cells), np.searchsorted(keep, keep + cells, "right")

    def best(v: str) -> tuple[float, int]:
        _, m, left, right = own[v]
        if not len(m):
            return 0.0, 0
        c = np.concatenate([[0.0], np.cumsum(m)])
        gain = c[right] - c[left]
        k = int(gain.argmax())
        return float(gain[k]), k

    gains = {v: best(v) for v in order}
    out: list[tuple[str, int]] = []
    seen: set[tuple[str, int]] = set()
    while len(out) < budget:
        v = max(order, key=lambda y: gains[y][0])  # the first of equal ones
        gain, k = gains[v]
        if gain <= 0:
            break
        g, m, left, right = own[v]
        row = v, int(g[k])
        m[left[k] : right[k]] = 0.0
        gains[v] = best(v)  # only the video that changed is looked at again
        if row not in seen:
            seen.add(row)
            out.append(row)
    return out


def coverage_rows(c: DataFrame, budget: int = BUDGET, **plan: float) -> DataFrame:
    """coverage() for each query of candidates (query_id, pos, video_id, frame_idx, score, last_frame), filled up with hybrid rows of the
    plain plan. A group is a query's candidates, some hundreds by contract."""
    schema = T.StructType([c.schema["query_id"], T.StructField("rank", T.LongType()), c.schema["video_id"], T.StructField("frame", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        last = [None if pd.isna(x) else int(x) for x in pdf["last_frame"]]
        got = coverage(pdf["frame_idx"].astype(int).tolist(), pdf["score"].tolist(), pdf["video_id"].tolist(), last, budget, **plan)
        return pd.DataFrame([(pdf["query_id"].iloc[0], i + 1, v, f) for i, (v, f) in enumerate(got)], columns=["query_id", "rank", "video_id", "frame"])

    head = c.groupBy("query_id").applyInPandas(run, schema).withColumn("_p", F.lit(0)).withColumnRenamed("rank", "_o")
    tail = hybrid_rows(c, budget, TAIL_FLAT, depth=PLAIN_DEPTH_COST).withColumn("_p", F.lit(1)).withColumnRenamed("rank", "_o").withColumn("_o", F.col("_o").cast("long"))
    return _first_places(gathered([head, tail], ["query_id"]), ["_p", "_o"], budget).select("query_id", "rank", "video_id", "frame")


def allocate(c: DataFrame, how: str = "coverage", budget: int = BUDGET) -> DataFrame:
    return {"coverage": coverage_rows, "hybrid": hybrid_rows, "slots": moment_rows}[how](c, budget)


def lattice(frames: list[int], step: int = STEP, last: int | None = None, budget: int = BUDGET) -> list[list[int]]:
    """Rows of a sequence answer around frames: offset tuples in order of their total size, then of the tuple; frames are kept in
    [0, last], and rows that come out equal are one."""
    n = len(frames)
    if not n:
        return []
    reach = 2
    while (2 * reach + 1) ** n < budget and reach < budget:
        reach += 1
    heap: list[tuple[int, tuple[int, ...]]] = [(0, (0,) * n)]
    known = {(0,) * n}
    out: list[list[int]] = []
    seen: set[tuple[int, ...]] = set()
    while heap and len(out) < budget:
        cost, o = heapq.heappop(heap)
        row = tuple(min(max(0, f + k * step), last) if last is not None else max(0, f + k * step) for f, k in zip(frames, o, strict=True))
        if row not in seen:
            seen.add(row)
            out.append(list(row))
        for i in range(n):
            for d in (-1, 1):
                k = o[i] + d
                if abs(k) > abs(o[i]) and abs(k) <= reach:
                    p = (*o[:i], k, *o[i + 1 :])
                    if p not in known:
                        known.add(p)
                        heapq.heappush(heap, (cost + 1, p))
    return out


def sequence_rows(a: DataFrame, step: int = STEP, budget: int = BUDGET) -> DataFrame:
    """lattice() for each row of (query_id, video_id, frames, last_frame): query_id, rank, video_id, frames."""
    schema = T.StructType([a.schema["query_id"], a.schema["video_id"], T.StructField("rank", T.LongType()), T.StructField("frames", T.ArrayType(T.LongType()))])

    def run(frames):
        for pdf in frames:
            rows = []
            for q, v, f, last in zip(pdf["query_id"], pdf["video_id"], pdf["frames"], pdf["last_frame"], strict=True):
                rows += [(q, v, i + 1, r) for i, r in enumerate(lattice([int(x) for x in f], step, None if pd.isna(last) else int(last), budget))]
            yield pd.DataFrame(rows, columns=["query_id", "video_id", "rank", "frames"])

    return a.select("query_id", "video_id", "frames", "last_frame").mapInPandas(run, schema)


def product_lattice(a: DataFrame, n: int, reach: int, step: int = STEP, budget: int = BUDGET) -> DataFrame:
    """The same order by a product of offsets, for small n: (2 reach + 1) ** n rows for each answer, a number that parameters fix."""
    x = a.withColumn("o", F.array().cast("array<int>"))
    for _ in range(n):
        x = x.withColumn("_k", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("o", F.concat("o", F.array("_k"))).drop("_k")
    x = x.withColumn("cost", F.aggregate("o", F.lit(0), lambda s, k: s + F.abs(k)))
    frames = F.zip_with("frames", "o", lambda f, k: F.greatest(F.lit(0), F.least(f + k * step, F.col("last_frame"))))
    x = x.withColumn("moved", frames)
    w = Window.partitionBy("query_id", "video_id")
    once = x.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "video_id", "moved").orderBy("cost", "o"))).where("_r = 1")
    return once.withColumn("rank", F.row_number().over(w.orderBy("cost", "o"))).where(F.col("rank") <= budget).select("query_id", "video_id", "rank", F.col("moved").alias("frames"))


def respend_tail(rows: DataFrame, c: DataFrame, keep: int = 50, apart: int = 20, budget: int = BUDGET) -> DataFrame:
    """The first `keep` rows stay; then candidates of videos among them that are more than `apart` frames from every row kept so
    far, in order of pos; then the other rows. Sequential by definition, for each query's hundred rows."""
    schema = T.StructType([rows.schema["query_id"], T.StructField("rank", T.LongType()), rows.schema["video_id"], T.StructField("frame", T.LongType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("rank")
        own = list(zip(left["video_id"], left["frame"].astype(int), strict=True))
        out = own[:keep]
        videos = {v for v, _ in out}
        for v, f in zip(*(right.sort_values("pos")[k] for k in ("video_id", "frame_idx")), strict=True):
            if len(out) >= budget:
                break
            if v in videos and all(v != a or abs(int(f) - b) > apart for a, b in out):
                out.append((v, int(f)))
        for r in own[keep:]:
            if len(out) < budget and r not in out:
                out.append(r)
        return pd.DataFrame([(left["query_id"].iloc[0], i + 1, v, f) for i, (v, f) in enumerate(out)], columns=["query_id", "rank", "video_id", "frame"]) if len(left) else pd.DataFrame(columns=["query_id", "rank", "video_id", "frame"])

    other = c.select(F.col("query_id").alias("_q"), "pos", F.col("video_id").alias("_v"), "frame_idx").toDF("_q", "pos", "video_id", "frame_idx")
    return rows.groupBy("query_id").cogroup(other.groupBy("_q")).applyInPandas(run, schema)


def reorder(rows: DataFrame, how: str) -> DataFrame:
    """Rows permuted as new_rank: breadth (each video's first rows first), by_video (videos in order of appearance), density (rows with
    most rows of their video within 50 frames first)."""
    w = Window.partitionBy("query_id")
    v = Window.partitionBy("query_id", "video_id")
    x = rows.withColumn("_i", F.row_number().over(v.orderBy("rank"))).withColumn("_f", F.min("rank").over(v)).withColumn("_n", F.count("*").over(v.orderBy("frame").rangeBetween(-50, 50)))
    order = {"breadth": ["_i", "_f"], "by_video": ["_f", "rank"], "density": [F.desc("_n"), "rank"]}[how]
    return x.withColumn("new_rank", F.row_number().over(w.orderBy(*order))).drop("_i", "_f", "_n")
