"""Roles from the steady window against a version over arrays."""

import numpy as np
import pytest

from airlattice.operators import filters, roles
from test_filters import plain_zero_phase


def plain(samples, rules):
    """Per kit: grid, filter, steady blocks, window, medians and roles, over whole arrays."""
    b, a = filters.butterworth(4, rules.cutoff, rules.rate)
    out = {}
    for kit in {s[0] for s in samples}:
        sensors = sorted({s[1] for s in samples if s[0] == kit})
        T, P = {}, {}
        for s in sensors:
            seen = {}
            for _, _, t, p, _ in sorted((x for x in samples if x[0] == kit and x[1] == s and x[2] is not None and x[3] is not None), key=lambda x: x[4]):
                seen.setdefault(t, p)
            T[s], P[s] = np.array(sorted(seen)), np.array([seen[t] for t in sorted(seen)])
        out |= {(kit, s): (None, None) for s in sensors}
        if min(len(t) for t in T.values()) < 2 or (t0 := max(t[0] for t in T.values())) >= (t1 := min(t[-1] for t in T.values())):
            continue
        grid = t0 + np.arange(int(np.ceil((t1 - t0) * rules.rate + 1))) / rules.rate
        Y, steady = [], np.ones(len(grid), bool)
        for s in sensors:
            y = np.interp(grid, T[s], P[s], left=np.nan, right=np.nan)
            good = np.flatnonzero(~np.isnan(y))
            y = np.interp(np.arange(len(y)), good, y[good])
            gap = np.abs(grid[:, None] - T[s][None, :]).min(axis=1)
            y = plain_zero_phase(b, a, y)
            y[gap > rules.reach] = np.nan
            slope = np.concatenate([[0.0], np.diff(y)]) * rules.rate
            Y.append(y)
            steady &= np.nan_to_num(np.abs(slope), nan=np.inf) < rules.slope
            steady &= gap <= rules.reach
        Y = np.array(Y)
        blocks, k = [], 0
        while k < len(grid):
            j = k
            while j < len(grid) and steady[j]:
                j += 1
            if j > k and np.nanmax(Y[:, k:j]) > rules.full:
                blocks.append((k, j - 1))
            k = max(j, k + 1)
        long = [x for x in blocks if (x[1] - x[0]) / rules.rate >= rules.shortest] or blocks
        if not long:
            continue
        i, j = max(long, key=lambda x: x[1] - x[0])
        most = round(rules.longest * 60 * rules.rate)
        if j - i + 1 > most:
            centre = i + int(np.argmax(np.nanmax(Y[:, i : j + 1], axis=0)))
            i = max(centre - most // 2, i)
            j = min(i + most - 1, j)
        mids = {s: float(np.median(Y[n, i : j + 1])) for n, s in enumerate(sensors)}
        top = max(sensors, key=lambda s: mids[s])
        rest = sorted((s for s in sensors if s != top), key=lambda s: mids[s])
        named = {s: "BC" if n < len(rest) // 2 else "WV" for n, s in enumerate(rest)} | {top: "MBP"}
        out |= {(kit, s): (mids[s], named[s]) for s in sensors}
    return out


def kit_of(kit, levels, seed, seconds=60, start=0.0, hole=None):
    """Sensors at about 8 Hz around their levels; the line is disturbed for a while in the middle."""
    rng = np.random.default_rng(seed)
    rows = []
    for n, level in enumerate(levels):
        t = start + n * 0.3 + np.cumsum(rng.uniform(0.05, 0.2, int(seconds * 8)))
        p = level + 0.002 * rng.normal(size=len(t)) + np.where((t > start + 20) & (t < start + 24), 0.8 * np.sin(t), 0)
        rows += [(kit, f"s{n}", float(x), float(y), i) for i, (x, y) in enumerate(zip(t, p)) if not (hole and hole[0] < x < hole[1])]
    return rows


RULES = roles.Rules(slope=0.05, shortest=5.0, longest=0.3)


@pytest.mark.parametrize("parts", [1, 9])
def test_roles(spark, parts):
    rows = kit_of("a", [5.0, 2.1, 2.4, 0.05, 0.1], 1) + kit_of("b", [4.9, 5.0, 0.1], 2, hole=(30, 38)) + kit_of("low", [1.0, 2.0], 3)
    rows += kit_of("apart", [5.0], 4) + [("apart", "z", 1e6 + i, 5.0, i) for i in range(20)] + [("one", "s", 1.0, 5.0, 1), ("one", "t", 1.0, 5.0, 1), ("one", "t", 2.0, 5.0, 2)]
    rows += [("a", "s0", rows[5][2], 9.0, 900), ("a", "s1", None, 1.0, 901), ("a", "s1", 3.0, None, 902)]
    df = spark.createDataFrame(rows, "kit string, sensor string, t double, p double, seq long")
    want = plain(rows, RULES)
    got = {(r.kit, r.sensor): r for r in roles.identify(df, RULES, parts).collect()}
    assert set(got) == set(want) and {k for k, v in want.items() if v[1]} >= {("a", "s0"), ("b", "s1")}
    for k, (mid, role) in want.items():
        assert got[k].role == role and (got[k].mid is None if mid is None else got[k].mid == pytest.approx(mid, abs=1e-9)), k


def test_inpainting(spark):
    rows = [(1, i, v) for i, v in enumerate([None, None, 2.0, None, None, 5.0, 7.0, None])] + [(2, 0, None), (2, 1, None)] + [(None, 3, 1.0), (None, 4, None)]
    got = {(r.k, r.g): r.y for r in roles.inpainted(spark.createDataFrame(rows, "k long, g long, y double"), ["k"], "g", "y", 4).collect()}
    assert [got[1, i] for i in range(8)] == pytest.approx([2, 2, 2, 3, 4, 5, 7, 7])
    assert got[2, 0] is None and got[None, 4] == 1.0


@pytest.mark.parametrize("short", [0, 300, 1 << 17])
def test_short_and_long_series_are_smoothed_alike(spark, short):
    rows = kit_of("a", [5.0, 2.1, 0.1], 1) + kit_of("b", [4.9, 0.1], 2, seconds=30, hole=(12, 18)) + kit_of("c", [4.9, 5.0], 3, seconds=2)
    df = spark.createDataFrame(rows, "kit string, sensor string, t double, p double, seq long")
    want = {(r.kit, r.sensor, r.g): r for r in roles.smoothed(df, RULES, 5, short=0).collect()}
    got = {(r.kit, r.sensor, r.g): r for r in roles.smoothed(df, RULES, 5, short=short).collect()}
    assert set(got) == set(want) and any(r.y is None for r in want.values()) and 0 < sum(r.steady for r in want.values()) < len(want)
    for k, r in want.items():
        assert got[k].steady == r.steady and got[k].t == r.t and (got[k].y is None if r.y is None else got[k].y == pytest.approx(r.y, abs=1e-9)), k


def test_short_series_are_laid_out_once(spark, monkeypatch):
    """A layout in segments for each step, each sampled and written, took most of the time."""
    monkeypatch.setattr(roles.segments, "segmented", lambda *_: pytest.fail("laid out in segments"))
    rows = kit_of("a", [5.0, 2.1], 1, seconds=10)
    df = spark.createDataFrame(rows, "kit string, sensor string, t double, p double, seq long")
    assert roles.smoothed(df, RULES, 3).count() > 0
