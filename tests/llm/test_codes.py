"""Codes and codebooks against a plain Lloyd over all vectors."""

import hashlib
import math
import random

import pytest

from airlattice.llm import codes, registry
from oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=6):
    import numpy as np

    keep = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % 8 == 0]
    ints = lambda r: [max(-codes.LIMIT, min(codes.LIMIT, math.floor(4096 * float(np.float32(x))))) for x in r[1]]
    keep = sorted(((r[0], ints(r), r[2]) for r in keep), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not keep:
        return []
    keep = [r for r in keep if len(r[1]) == len(keep[0][1])]
    w = len(keep[0][1]) // 8
    books = [[r[1][p * w : (p + 1) * w] for r in keep[:16]] for p in range(8)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            mine = {}
            for r in keep:
                x = r[1][p * w : (p + 1) * w]
                mine.setdefault(best(p, x)[1], []).append(x)
            for j, xs in mine.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, label in keep:
        at = [best(p, v[p * w : (p + 1) * w]) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for _, j in at), sum(e for e, _ in at), label))
    per = {}
    for r in out:
        per[r[3]] = per.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], per[r[3]], sha) for r in out), key=repr)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in codes.compress(spark.createDataFrame(rows, schema)).collect()), key=repr)


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = vectors(120, 16, 1)
    rows += [(200 + i, [0.25] * 16, 1) for i in range(60)]  # one vector of a third of the rows
    rows += [rows[3], rows[3], (5, [1.0] * 16, 2), (None, [2.0] * 16, None), (None, [2.0] * 16, None)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] + [1.0] * 15, 1), (903, [math.nan] + [0.0] * 15, 0), (904, [math.inf] * 16, 0), (905, [1.0] * 15, 0), (906, [1.0] * 24, 1)]
    rows += [(300, [-0.0001] * 16, 1), (301, [3e38, -3e38] * 8, 1)]
    random.Random(2).shuffle(rows)
    assert found(spark, rows + bad) == plain(rows)


def test_fewer_vectors_than_entries_and_equal_entries(spark):
    rows = [(i, [float(i // 2)] * 8, None) for i in range(6)]
    assert found(spark, rows) == plain(rows)


def test_extra_columns_and_empty_tables(spark):
    rows = vectors(40, 8, 4)
    extra = [(*r, 1, "x", 2) for r in rows]
    assert found(spark, extra, SCHEMA + ", part int, code string, position int") == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 2), (2, [math.nan] * 8, 1)]) == []


@pytest.mark.parametrize("share", [2, 50])
def test_spread_join_meets_hot_and_rare_keys(spark, share):
    from pyspark.sql import functions as F

    from airlattice.operators.joins import spread_join

    rows = spark.createDataFrame([(k,) for k in [None] * 30 + [1] * 40 + list(range(2, 32))], "k long")
    marks = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = [tuple(r) for r in spread_join(rows, marks, ["k"], "n", 100, share).collect()]
    assert len(got) == 100 and sorted(map(str, got)) == sorted(map(str, [(None, 30)] * 30 + [(1, 40)] * 40 + [(k, 1) for k in range(2, 32)]))


def test_query_matches_sql(spark, sf):
    assert compare(spark, sf, "op11_vector_codes", registry.queries()["op11_vector_codes"], registry.oracle_sql()["op11_vector_codes"]) > 0
