"""Density clusters against all pairs."""

import math
import random

import pytest

from airlattice.operators import density


def plain(points, eps, least):
    near = {i: [j for j, y in points.items() if sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) <= eps * eps] for i, x in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    cluster = {}
    for i in sorted(core):
        if i in cluster:
            continue
        ahead = [i]
        while ahead:
            j = ahead.pop()
            if j not in cluster:
                cluster[j] = i
                ahead += [k for k in near[j] if k in core]
    edge = {i: min((cluster[j] for j in near[i] if j in core), default=None) for i in points if i not in core}
    return {i: (cluster[i], True) if i in core else (edge[i], False) for i in points}


def cloud(dims, seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.uniform(-5, 5) for _ in range(dims)] for _ in range(6)]
    out = {}
    for i in range(n):
        c, s = rng.choice(centres), rng.choice([0.02, 0.3, 1.5])
        out[i] = [rng.gauss(m, s) for m in c]
    for k in range(40):  # a chain, and a cell of many equal points
        out[n + k] = [0.35 * k - 7] + [6.0] * (dims - 1)
        out[n + 100 + k] = [3.0] * dims
    return out


@pytest.mark.parametrize("dims, eps, least, block", [(1, 0.2, 4, 4096), (2, 0.36, 5, 4096), (2, 0.36, 5, 7), (2, 0.36, 1, 50), (3, 0.7, 6, 16)])
def test_against_all_pairs(spark, dims, eps, least, block):
    points = cloud(dims, dims * 7 + least)
    df = spark.createDataFrame(list(points.items()), "id long, x array<double>")
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, eps, least, dims, block).collect()}
    assert got == plain(points, eps, least)


def test_points_without_a_place(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, [0.0]), (5, [math.nan, 0.0]), (6, [None, 0.0]), (7, [math.inf, 0.0])]
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(spark.createDataFrame(rows, "id long, x array<double>"), 0.5, 2, 2).collect()}
    assert got == {1: (1, True), 2: (1, True)} | {i: (None, False) for i in (3, 4, 5, 6, 7)}
    assert density.dbscan(spark.createDataFrame([], "id long, x array<double>"), 0.5, 2, 2).count() == 0
