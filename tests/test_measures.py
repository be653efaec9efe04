"""Resampling, exact rounding and picture gates against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keymoment.functions.arrays import round_binary, sharpness
from keymoment.operators import resampling


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), round(r.random(), 3)) for i in range(1, 38)]
    return rows, spark.createDataFrame(rows, "k long, g string, x double").repartition(5)


def test_rounding_by_the_binary_value(spark):
    r = random.Random(1)
    xs = [r.randint(-(10**7), 10**7) / 10**4 for _ in range(3000)] + [0.5, 1.5, 2.5, -0.5, 0.0005, 0.0015, 0.125, 2.675, 1.005, 0.0, 1e6 + 0.0005]
    for places in (0, 2, 3):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_binary(F.col("x"), places).alias("y")).collect()
        assert [g.y for g in got] == [round(g.x, places) for g in got]
    with pytest.raises(ValueError):
        round_binary(F.col("x"), 7)


def test_sharpness_of_pictures(spark):
    r = np.random.default_rng(4)
    for height, width in ((8, 8), (3, 5), (4, 3)):
        p = r.integers(0, 256, (height, width)).astype(float)
        lap = np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1])
        got = spark.createDataFrame([(p.reshape(-1).tolist(),)], "p array<double>").select(sharpness(F.col("p"), width)).first()[0]
        assert got == pytest.approx(lap.var())
    assert spark.createDataFrame([([1.0] * 8,), ([],), (None,)], "p array<double>").select(sharpness(F.col("p"), 4)).collect() == [(None,)] * 3


def test_numbers_are_dense(spark, values):
    rows, df = values
    got = {r.k: r.idx for r in resampling.numbered(df, "k").collect()}
    want = sorted((k for k, _, _ in rows), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest()[:2], k))
    assert got == {k: i for i, k in enumerate(want)}


def test_resamples_draw_with_replacement(spark, values):
    rows, df = values
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:2], r[0]))
    n = len(rows)
    want = {b: sum(order[int(u(9, b, s) * n)][2] for s in range(n)) / n for b in range(50)}
    got = {r.resample: r.mean for r in resampling.resampled_means(df, "k", "x", 50, 9).collect()}
    assert got == pytest.approx(want) and len(got) == 50
    assert resampling.resampled_means(df.limit(0), "k", "x", 50, 9).count() == 0


def test_half_splits_and_their_null(spark, values):
    rows, df = values
    want = {}
    for s in range(1, 41):
        first, second = [], []
        for g in "ab":
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (u(5, s, r[0]), r[0]))
            first += own[: len(own) // 2]
            second += own[len(own) // 2 :]
        want[s] = np.mean([r[2] for r in second]) - np.mean([r[2] for r in first])
    gaps = resampling.half_splits(df, ["g"], "k", "x", 40, 5)
    assert {r.split: r.gap for r in gaps.collect()} == pytest.approx(want)
    one = resampling.against_null(spark.createDataFrame([(0.05,)], "gap double"), gaps).first()
    assert one.splits == 40 and one.p_value == pytest.approx(np.mean([abs(x) >= 0.05 for x in want.values()]))


def test_power_by_shape(spark):
    groups = spark.createDataFrame([("a", 30, 0.2), ("b", 12, 0.0), ("none", 0, None)], "g string, n long, base double")
    got = {(r.g, r.shape): r for r in resampling.power(groups, "g", 6, 50, 3).collect()}
    assert {g for g, _ in got} == {"a", "b"}
    for (g, shape), r in got.items():
        n, found = {"a": 30, "b": 12}[g], 0
        for rep in range(6):
            sums = []
            for b in range(50):
                idx = [int(u(3, n, rep, b, s) * n) for s in range(n)]
                sums.append(sum(1 if i < r.up else -1 if i < r.changed else 0 for i in idx))
            found += np.percentile(sums, 2.5) > 0
        assert r.power == pytest.approx(found / 6, abs=1e-6), shape
        assert r.mde == (0.001 if found / 6 >= 0.8 and g == "a" and 2 * r.up > r.changed else None)
    assert got["a", "every"].power == 1.0 and got["a", "every_mixed"].changed == 30 and got["a", "every_mixed"].up == 21
