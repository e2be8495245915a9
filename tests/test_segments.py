"""Folds over segments give what plain windows give, wherever the cuts fall."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airlattice.operators import graph, segments


def rows_of(n, keys, seed):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(n), i, rng.choice([None, 1.0, 2.0, 5.0])) for i in range(n)]


SCHEMA = "k long, t long, id long, x double"


@pytest.mark.parametrize("keys, parts", [([1], 13), ([1, 1, 1, 2, 3, None], 7), (list(range(60)), 5), ([1, 2], 1)])
def test_folds_equal_plain_windows(spark, keys, parts):
    df = spark.createDataFrame(rows_of(400, keys, parts), SCHEMA)
    w = Window.partitionBy("k").orderBy("t", "id")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.col("x")
    want = df.select("id", F.sum(x).over(up).alias("s"), F.last(x, True).over(up).alias("b"), F.first(x, True).over(down).alias("a"), F.lag(x).over(w).alias("p"), F.lead(x).over(w).alias("q"))
    d = segments.segmented(df, ["k"], ["t", "id"], parts)
    got = segments.fold(d, ["k"], s=segments.running_sum(x), b=segments.last(x), a=segments.next_(x), p=segments.lag(x), q=segments.lead(x))
    assert {r.id: (r.s, r.b, r.a, r.p, r.q) for r in got.collect()} == {r.id: (r.s, r.b, r.a, r.p, r.q) for r in want.collect()}


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame(rows_of(500, [1, 1, 1, 1, 2, None, 7], 3), SCHEMA)
    got = {}
    for r in segments.numbered(df, ["k"], ["t", "id"], 9).collect():
        got.setdefault((r.k, r.n), []).append((r.i, r.t, r.id))
    assert len({k for k, _ in got}) == len(got)
    for (_, n), rows in got.items():
        rows.sort()
        assert [i for i, _, _ in rows] == list(range(n)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_one_series_is_spread(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    d = segments.segmented(df, ["k"], ["id"], 400)
    assert d.groupBy("_segment").count().agg(F.max("count")).first()[0] <= 200


def test_empty_table(spark):
    d = segments.segmented(spark.createDataFrame([], SCHEMA), ["k"], ["t"], 3)
    assert segments.fold(d, ["k"], s=segments.running_sum(F.col("x"))).count() == 0
    assert segments.numbered(spark.createDataFrame([], SCHEMA), ["k"], ["t"]).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-1]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
