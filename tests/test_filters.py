"""Filters against plain recursions, wherever series are cut."""

import random

import numpy as np
import pytest

from airlattice.operators import filters, segments


def plain(b, a, x, state=None):
    """Direct form, sample by sample."""
    s = np.zeros(len(a) - 1) if state is None else np.array(state, float)
    out = []
    for v in x:
        y = b[0] * v + s[0]
        s = np.append(s[1:], 0.0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def plain_zero_phase(b, a, x):
    pad = 3 * len(a)
    if len(x) <= pad:
        return np.array(x, float)
    x = np.array(x, float)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    f = filters.Filter.of(b, a)
    y = plain(b, a, wide, f.rest() * wide[0])[::-1]
    return plain(b, a, y, f.rest() * y[0])[::-1][pad:-pad]


def test_known_coefficients():
    b, a = filters.butterworth(1, 1, 40)
    assert np.allclose([b[0], -a[1]], [0.0729596572682667, 0.8540806854634666], atol=1e-14)
    # Fourth order at a fifth of the rate, from the usual tables.
    b, a = filters.butterworth(4, 1, 5)
    assert np.allclose(b, [0.04658291, 0.18633163, 0.27949744, 0.18633163, 0.04658291], atol=1e-7)
    assert np.allclose(a, [1, -0.78209520, 0.67997853, -0.18267570, 0.03011888], atol=1e-7)
    with pytest.raises(ValueError):
        filters.butterworth(2, 3, 5)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_cutting_anywhere_gives_the_same_output(order):
    rng = np.random.default_rng(order)
    b, a = filters.butterworth(order, 1, 20)
    f, x = filters.Filter.of(b, a), rng.normal(size=777)
    want = plain(b, a, x)
    for cuts in ([], [1], [63, 64, 65], sorted(rng.integers(0, 777, 9).tolist())):
        state, got = np.zeros(order), []
        for part in np.split(x, cuts):
            y, state = f.run(part, state)
            got.append(y)
        assert np.allclose(np.concatenate(got), want, atol=1e-10)
        # The maps of the parts compose to that of the whole.
        total = np.zeros(order)
        for part in np.split(x, cuts):
            total = f.power(len(part)) @ total + f.run(part, np.zeros(order))[1]
        assert np.allclose(total, state, atol=1e-10)


def series(seed, sizes):
    rng = random.Random(seed)
    return [(k, i, rng.gauss(5, 1)) for k, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("sizes, parts", [({1: 900}, 17), ({1: 300, 2: 5, 3: 1, None: 200, 4: 400}, 9), ({k: 30 for k in range(20)}, 6), ({1: 40}, 1)])
@pytest.mark.parametrize("settle", [False, True])
def test_segments_equal_the_plain_recursion(spark, sizes, parts, settle):
    rows = series(parts, sizes)
    random.Random(1).shuffle(rows)
    b, a = filters.butterworth(4, 1, 5)
    f = filters.Filter.of(b, a)
    d = segments.segmented(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], ["i"], parts)
    got = {(r.k, r.i): r.y for r in filters.recursive(d, f, ["k"], "x", "y", settle).collect()}
    assert len(got) == len(rows)
    for k in sizes:
        x = [v for q, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        want = plain(b, a, x, f.rest() * x[0] if settle else None)
        assert np.allclose([got[k, i] for i in range(len(x))], want, atol=1e-9)


@pytest.mark.parametrize("parts", [1, 11])
def test_zero_phase(spark, parts):
    rows = series(3, {1: 400, 2: 15, 3: 16, 4: 1, None: 100})
    b, a = filters.butterworth(4, 1, 5)
    out = filters.zero_phase(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", "x", 1, 5, "y", parts=parts)
    got = {(r.k, r.i): r.y for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        x = [r[2] for r in rows if r[0] == k]
        assert np.allclose([got[k, i] for i in range(len(x))], plain_zero_phase(b, a, x), atol=1e-9), k


def test_a_constant_and_an_empty_table_stay(spark):
    rows = [(1, i, 3.0) for i in range(200)]
    out = filters.zero_phase(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], "i", "x", 1, 5, "y", parts=5)
    assert all(abs(r.y - 3) < 1e-9 for r in out.collect())
    assert filters.zero_phase(spark.createDataFrame([], "k long, i long, x double"), ["k"], "i", "x", 1, 5, "y").count() == 0
