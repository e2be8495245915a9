"""Robust moments, mutual information, greedy intervals and quota windows against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import robust, segments, series, statistics


def test_contamination_does_not_move_the_fit(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5))
    good, bad = rng.normal(size=(600, 5)) @ mix, rng.normal(size=(120, 5)) * 0.5 + 25
    cols = [f"x{i}" for i in range(5)]
    rows = [(i, *map(float, r)) for i, r in enumerate(np.vstack([good, bad]))] + [(999, None, 1.0, 1.0, 1.0, 1.0), (998, math.nan, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    mean, cov = robust.concentrated(df, cols)
    d2 = {r.id: r.d2 for r in df.where("id < 900").select("id", robust.distance(cols, mean, cov).alias("d2")).collect()}
    far = sorted(d2, key=d2.get)[-120:]
    assert set(far) == set(range(600, 720)) and max(d2[i] for i in range(600)) < min(d2[i] for i in range(600, 720)) / 3
    # The plain moments are drawn by them.
    plain = robust.moments(df.where("id < 900"), cols)[0]
    assert np.abs(plain - good.mean(axis=0)).max() > 3 and np.abs(mean - good.mean(axis=0)).max() < 0.5
    want = np.einsum("ni,ij,nj->n", good - mean, np.linalg.inv(cov), good - mean)
    assert np.allclose([d2[i] for i in range(600)], want)


def test_distance_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, *map(float, rng.normal(size=3) + s)) for g, s in (("a", 0.0), ("b", 2.0)) for _ in range(50)] + [(None, 1.0, 1.0, 1.0)]
    x = {g: np.array([r[1:] for r in rows if r[0] == g]) for g in ("a", "b", None)}
    got = {r.g: r.distance for r in robust.group_distance(spark.createDataFrame(rows, "g string, x double, y double, z double"), "g", "a", ["x", "y", "z"]).collect()}
    inv = np.linalg.inv(np.cov(x["a"].T))
    for g, v in x.items():
        d = v.mean(axis=0) - x["a"].mean(axis=0)
        assert got[g] == pytest.approx(math.sqrt(d @ inv @ d), abs=1e-9)


def test_mutual_information(spark):
    rng = random.Random(1)
    rows = [(y := rng.choice("ABC"), y if rng.random() < 0.7 else "x", rng.randrange(4), None if rng.random() < 0.3 else 1) for _ in range(500)]
    df = spark.createDataFrame(rows, "y string, a string, b int, c int")
    scores = statistics.mutual_information(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, F.col("y"))
    got = {r.feature: r for r in statistics.best_features(scores, "mi", 1).collect()}
    for k, name in enumerate("abc", 1):
        xy, xs, ys = Counter((r[k], r[0]) for r in rows), Counter(r[k] for r in rows), Counter(r[0] for r in rows)
        assert got[name].mi == pytest.approx(sum(n / 500 * math.log(n * 500 / (xs[x] * ys[y])) for (x, y), n in xy.items()))
    assert got["a"].kept and got["a"].nth == 1 and not got["b"].kept


def greedy(rows):
    out = set()
    by = defaultdict(list)
    for k, i, a, b in rows:
        if a is not None and b is not None and a < b:
            by[k].append((b, i, a))
    for k, some in by.items():
        last = -math.inf
        for b, i, a in sorted(some):
            if a >= last:
                out.add((k, i))
                last = b
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_greedy_intervals(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, a := rng.randrange(2000), a + rng.choice([0, 1, 5, 5, 60])) for i in range(600)] + [(3, 1000 + i, i, i + 1) for i in range(300)] + [(4, 5000, None, 3), (5, 5001, 1, 1)]
    df = spark.createDataFrame(rows, "k long, id long, a long, b long")
    assert {(r.k, r.id) for r in series.greedy_intervals(df, "k", "a", "b", "id", parts).collect()} == greedy(rows)


def test_least_ahead_and_frames_over_chunks(spark):
    rng = random.Random(8)
    rows = [(1 if i < 150 else 2, i, rng.choice([None, *range(50)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    d = segments.fold(segments.segmented(df, ["k"], ["i"], 9), ["k"], low=segments.floor_ahead(F.col("x")), high=segments.peak_before(F.col("x")))
    for r in d.collect():
        after, before = [x for k, i, x in rows if k == r.k and i >= r.i and x is not None], [x for k, i, x in rows if k == r.k and i < r.i and x is not None]
        assert (r.low, r.high) == (min(after, default=None), max(before, default=None))
    d, run = segments.framed(df.withColumnRenamed("i", "id"), ["k"], ["id"], 4, 2, size=7, parts=5)
    got = {r.id: r.s for r in d.withColumn("s", F.sum("x").over(run.rowsBetween(-4, 2))).where("_own").collect()}
    for k, i, _ in rows:
        near = [x for q, j, x in rows if q == k and i - 4 <= j <= i + 2 and x is not None]
        assert got[i] == (sum(near) if near else None)
    with pytest.raises(ValueError):
        segments.framed(df, ["k"], ["i"], 8, size=7)
