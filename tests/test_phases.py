import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from airlattice.operators import phases


def line(*pieces):
    """(t, p, g) of pieces (seconds, from, to) at 40 Hz, with exact gradients."""
    p, g = [], []
    for s, a, b in pieces:
        n = round(s * 40)
        p += [a + (b - a) * i / n for i in range(n)]
        g += [(b - a) / s] * n
    return np.arange(len(p)) / 40, np.array(p), np.array(g)


def test_pipe_parts():
    t, p, g = line((2, 5, 5), (4, 5, 4), (5, 4, 4), (2, 4, 5), (3, 5, 5))
    x = phases.pipe_parts(t, p, g)
    # The row that starts a part is still the old part's: the brake is rows 81 to 440, the release from 441 on.
    assert x["brake_start"] == 81 / 40 and x["brake_timing"] == pytest.approx(359 / 40)
    assert x["buildup_last"] == pytest.approx(0.9) and x["buildup_timing"] == pytest.approx((80 + 144 - 81) / 40)
    assert x["holding_start"] == x["buildup_end"] and x["holding_end"] == x["brake_end"]
    q = np.clip(p[0] - p, 0, 1.5)
    assert x["brake_energy"] == pytest.approx(np.trapezoid(q[81:441], t[81:441])) and x["brake_power"] == pytest.approx(x["brake_energy"] / x["brake_timing"])
    assert x["release_start"] == 441 / 40 and x["release_last"] < 0.05 and x["total_energy"] == pytest.approx(x["brake_energy"] + x["release_energy"])
    assert x["max_pressure"] == pytest.approx(1) and x["again"] == 0
    d = (p[0] - p)[1:-1]
    assert x["mean"] == pytest.approx(d.mean()) and x["std"] == pytest.approx(d.std())


def test_pipe_brakes_again_and_never():
    t, p, g = line((2, 5, 5), (4, 5, 4), (3, 4, 4), (1, 4, 4.3), (2, 4.3, 3.8), (3, 3.8, 3.8), (2, 3.8, 5), (2, 5, 5))
    x = phases.pipe_parts(t, p, g)
    assert x["again"] == 1 and x["brake_timing"] > 12  # the false release is part of the brake
    x = phases.pipe_parts(*line((5, 5, 5)))
    assert x["brake_timing"] == x["release_energy"] == x["buildup_power"] == 0 and np.isnan(x["brake_start"]) and np.isnan(x["total_power"])


def test_cylinder_parts():
    t, p, g = line((2, 0, 0), (4, 0, 2), (6, 2, 2), (4, 2, 0), (3, 0, 0))
    x = phases.cylinder_parts(t, p, p, g, True, False, True)
    assert x["brake_start"] == 81 / 40 and x["buildup_last"] == pytest.approx(1.8) and x["non_standard"] is False
    # A flat cylinder counts as releasing after 210 calm rows, and as braking again while it doesn't fall.
    assert 0.4 <= x["release_last"] < 0.45 and x["max_pressure"] == 2  # the row before the one below 0.4 bar
    assert x["mode"] == "P" and phases.mode(30, (3.5, 4.5), (21, 27)) == "unknown" and phases.mode(21, (3.5, 4.5), (21, 27)) == "G"
    # The first rise is a line of 0.5 bar a second.
    assert x["rise_max_gradient"] == pytest.approx(0.5) and x["rise_curvature"] == pytest.approx(0, abs=1e-9)
    assert x["rise_timing"] == pytest.approx(31 / 40) == x["rise10_timing"]
    assert x["rise_half_ratio"] == pytest.approx(15 / 31)


def test_valley_is_stitched():
    valley = line((2, 0, 0), (4, 0, 2), (2, 2, 2), (4, 2, 0.2), (2, 0.2, 0.2), (4, 0.2, 2), (2, 2, 2), (4, 2, 0), (2, 0, 0))
    x = phases.cylinder_parts(valley[0], valley[1], valley[1], valley[2], True, False, False)
    assert x["again"] == 1 and x["brake_end"] > 18 and x["release_start"] > 18
    late = line((2, 0, 0), (4, 0, 2), (2, 2, 2), (4, 2, 0.2), (2, 0.2, 0.2), (50, 0.2, 3.0), (2, 3.0, 3.0))
    x = phases.cylinder_parts(late[0], late[1], late[1], late[2], True, False, False)
    assert x["brake_end"] > 12  # a slow rise that reaches 0.4 within thirty seconds counts as well


def test_late_release():
    assert phases.late_release(np.array([0.0, 0.5, 1.0])) is None
    assert phases.late_release(np.array([0.0, 1.0, 1.0, 0.99, 0.7, 0.4, 0.1])) == (3, 5)
    assert phases.late_release(np.array([0.0, 0.4, 0.3, 0.2, 0.1])) == (2, 3)  # half of a low peak
    assert phases.late_release(np.array([0.0, 1.0, 0.9, 0.8])) is None
    t, p, g = line((2, 0, 0), (4, 0, 0.5), (2, 0.5, 0.5), (20, 0.5, 0.1))
    x = phases.cylinder_parts(t, p, p, g, False, False, False)  # never fast enough for a release by gradient
    assert x["non_standard"] and x["release_first"] == pytest.approx(0.495, abs=1e-3) and x["release_last"] <= 0.4 and x["brake_end"] < x["release_start"]


def test_flags_and_tail(spark):
    rows = []
    shapes = {"good": line((12, 0, 2), (8, 2, 0), (5, 0, 0)), "above": line((25, 0.5, 2)), "zero": line((25, 0, 0)), "engaged": line((25, 0.2, 0.2)), "falling": line((25, 0.39, 0.1)), "low": line((12, 0, 0.5), (13, 0.5, 0.5))}
    for name, (t, p, g) in shapes.items():
        rows += [("k", name, float(a), float(b), float(b), float(c)) for a, b, c in zip(t, p, g)]
    samples = spark.createDataFrame(rows, "kit string, sensor string, t double, p double, p10 double, g double")
    spans = spark.createDataFrame([("k", 1, 0.0, 15.0, False), ("k", 2, 20.0, 24.0, True)], "kit string, phase long, start double, end double, over boolean")
    taken = phases.cylinder_rows(samples, spans, ["kit"])
    got = {(r.phase, r.sensor): r for r in phases.cylinder_flags(taken, spans, ["kit"]).collect()}
    one = {s: got[1, s] for s in shapes}
    assert one["above"].above_start and one["zero"].flat_near_zero and one["engaged"].already_engaged and one["falling"].releasing_start
    assert all(one[s].sensor_error == (s not in ("good", "low")) for s in shapes)
    assert one["good"].normal and not one["good"].low_braking and one["low"].low_braking and not one["low"].normal
    # The tail ends with the first row below 0.4 bar, at 18.4 s; others run ten seconds past the pipe's end.
    assert one["good"].end_time == pytest.approx(18.425, abs=0.03) and one["above"].end_time == pytest.approx(24.975, abs=0.03)
    assert got[2, "good"].sensor_error and got[2, "good"].max_pressure is None
    # Rows of the first phase's tail are not in the second.
    assert taken.where("phase = 2 AND sensor = 'above'").count() == 0 and taken.where("phase = 2 AND sensor = 'good'").count() > 0


def test_feature_table(spark, sf):
    d = entry.queries()["feature_table"](spark, sf)
    rows = d.collect()
    assert len(rows) == 2 * entry.queries()["cycle_detection"](spark, sf).count() and len(d.columns) > 100
    a = [r for r in rows if r.sensor == "a" and r.kit >= 5]
    assert a and all(r.cyl_max_pressure > 0.6 and r.pipe_brake_timing > 1 and r.load is not None and r.cyl_release_timing > 0 for r in a)
    assert all(r.total_power_efficiency == pytest.approx(r.brake_power_efficiency + r.release_power_efficiency) for r in a)
    assert [r.start for r in rows] == sorted(r.start for r in rows)
    assert d.select("pipe_classification_error").agg(F.sum("pipe_classification_error")).first()[0] == 0


def test_reference_phase(spark):
    found = spark.createDataFrame([("k", i, 10.0 * i, 10.0 * i + 5, False, False, i == 1) for i in range(1, 6)] + [("m", 1, 0.0, 5.0, True, False, False)], "kit string, phase long, start double, end double, over boolean, under boolean, emergency boolean")
    samples = spark.createDataFrame([("k", i / 2) for i in range(20, 100)] + [("m", i / 2) for i in range(20)], "kit string, t double")
    bc = [("k", p, s, e, n) for p, s, e, n in [(1, "a", False, True), (1, "b", False, True), (2, "a", True, False), (2, "b", False, True), (3, "a", False, True), (3, "b", False, True), (4, "a", False, True), (5, "a", False, True), (5, "b", False, True)]] + [("m", 1, "a", False, True)]
    wv = [("k", p, "w", p == 5) for p in range(1, 6)]
    out = phases.reference_phase(samples, found, spark.createDataFrame(bc, "kit string, phase long, sensor string, sensor_error boolean, normal boolean"), spark.createDataFrame(wv, "kit string, phase long, sensor string, sensor_error boolean"), ["kit"])
    got = {(r.kit, r.phase): (r.eligible, r.score, r.reference) for r in out.collect()}
    assert got == {("k", 1): (True, 90, False), ("k", 2): (False, None, False), ("k", 3): (True, 100, True), ("k", 4): (False, None, False), ("k", 5): (False, None, False), ("m", 1): (True, 90, True)}


def test_gateway_and_speeds(spark):
    found = spark.createDataFrame([("k", 1, 0.0, 5.0), ("k", 2, 10.0, 15.0)], "kit string, phase long, start double, end double")
    cyl = spark.createDataFrame([], "kit string, phase long, end_time double")
    nan = float("nan")
    fixes = spark.createDataFrame([("k", float(t), 45.0, 9.0, 80.0 - t, v, r) for t, v, r in [(0, 9.0, 308.0), (1, nan, 1.0), (2, None, 308.0), (3, 12.0, None), (4, 9.9, nan)]], "kit string, t double, lat double, lon double, speed double, vbatt double, rpm double")
    got = {r.phase: r for r in phases.gps_slices(fixes, found, cyl, ["kit"]).collect()}
    assert (got[1].gateway_vb_error, got[1].gateway_cb_error, got[1].speed_start, got[1].speed_end, got[1].gps_n) == (2, 2, 80.0, 76.0, 5)
    assert (got[2].gateway_vb_error, got[2].gateway_cb_error, got[2].speed_start, got[2].gps_error) == (0, 0, 0.0, True)
    bare = phases.gps_slices(fixes.drop("vbatt", "rpm"), found, cyl, ["kit"]).collect()
    assert all(r.gateway_vb_error == 0 and r.gateway_cb_error == 0 for r in bare)
