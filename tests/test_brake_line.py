"""Samples made in place: the same cycles and rows as from samples that are laid out, and none of them shuffled."""

import re

from pyspark.sql import functions as F

from airlattice.operators import cycles, phases, segments
from airlattice.plans import cycling


def test_detection_in_place(spark):
    """Series that go on over cuts, some over whole segments, give the same cycles however their samples come."""
    brakes = spark.createDataFrame([(k, i, ((k or 0) + i) % 4) for k, n in ((1, 1), (2, 7), (3, 2), (None, 3)) for i in range(n)], "kit long, i long, level long")
    laid = segments.segmented(brakes, ["kit"], ["i"], 6)
    samples = cycling.sampled(brakes).select("kit", "seq", "t", "pressure")
    want = cycles.detect(samples, ["kit"], "t", "pressure", "seq", parts=1).collect()
    got = cycles.detect(cycling.sampled(laid), ["kit"], "t", "pressure", "seq", laid=laid).collect()
    assert len(want) > 5
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rows_of_phases_that_meet(spark):
    """A tail that reaches into the next phases: each row is the earliest phase's."""
    rows = [(1, "a", k / 4, max(0.0, 1.0 - (k % 80) / 60), -0.1) for k in range(200)]
    samples = spark.createDataFrame([(k, s, t, p, p, g) for k, s, t, p, g in rows], "kit long, sensor string, t double, p double, p10 double, g double")
    found = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 8.0, 9.0), (1, 3, 15.0, 16.0), (1, 4, 40.0, 44.0)], "kit long, phase long, start double, end double")
    got = {(r["phase"], r["t"]) for r in phases.cylinder_rows(samples, found, ["kit"]).select("phase", "t").collect()}
    taken, want = set(), set()
    for phase, a, b in ((1, 0.0, 4.0), (2, 8.0, 9.0), (3, 15.0, 16.0), (4, 40.0, 44.0)):
        own = [(t, p) for _, _, t, p, _ in rows if a <= t <= b + 10]
        stop = next((t for j, (t, p) in enumerate(own) if t > b and p < 0.4 and j >= 39), None)
        for t, _ in own:
            if (stop is None or t <= stop) and t not in taken:
                taken.add(t)
                want.add((phase, t))
    assert got == want


def test_no_samples_are_shuffled(spark, sf):
    """Of the cylinders' rows only phases and brakings are dealt out."""
    plan = cycling.BrakeLine(spark, sf).rows._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\([^)]*_ms", plan)
    assert len(re.findall(r"Window \[", plan)) > 2
    for exchange in re.split(r"Exchange ", plan)[1:]:
        assert "pressure" not in exchange.split("\n")[0]
