"""Braking cycles in a pressure series: an ordered state machine, the same for batches and for streams.

A cycle begins where a calm series starts to fall from operating pressure and ends where the pressure is back. Guards
drop cycles without fluctuation after their onset, those that never end, and those too shallow. Samples pass a causal
filter first: a moving mean, a first-order Butterworth low-pass and the mean of its gradient.

The state is small, so a series is cut anywhere: a batch lays series out in segments, each task advances its segments
row by row, and what a segment leaves goes to the one after it (``detect``).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.session import ship

from .filters import butterworth
from .segments import segmented


@dataclass(frozen=True)
class Rules:
    """Fixed values of the domain: pressures in bar, times in seconds, gradients in bar a second."""

    rate: float = 40.0
    smooth: int = 20
    window: int = 80
    calm: float = 0.02
    calm_share: float = 0.6
    onset: float = -0.05
    lower: float = 4.7
    upper: float = 5.2
    release: float = 0.05
    least_drop: float = 0.2
    emergency: float = 1.5
    control_delay: float = 2.0
    control_length: float = 4.0
    longest: float = 1800.0
    hold: float = 5.0
    hold_gradient: float = 0.02
    later: tuple[float, float] = (20.0, 60.0)
    patience: float = 60.0
    cutoff: float = 1.0


@dataclass
class State:
    """All that a series carries from one chunk to the next."""

    n: int = 0
    raw: list[float] = field(default_factory=list)
    slopes: list[float] = field(default_factory=list)
    mean: float = 0.0
    smooth: float | None = None
    time: float | None = None
    calm: list[int] = field(default_factory=list)
    cycle: dict | None = None
    done: dict | None = None  # the last cycle, while its later pressures are awaited

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> State:
        return cls(**json.loads(text))


def _mean(tail: list[float], x: np.ndarray, width: int, n: int) -> np.ndarray:
    """Means of the last ``width`` values up to each of ``x``, of fewer in a series' first rows; ``n`` rows came before. Sums are
    made in the order of rows, so they don't depend on where a series is cut."""
    tail = tail[-(width - 1) :] if width > 1 else []
    wide = np.concatenate([np.zeros(width - 1 - len(tail)), tail, x])
    total = np.zeros(len(x))
    for j in range(width):
        total += wide[j : j + len(x)]
    return total / np.minimum(np.arange(n + 1, n + 1 + len(x)), width)


def _filtered(state: State, p: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smooth pressure, its gradient and whether enough of the last rows were calm; ``state`` takes the new tails."""
    (b0, b1), (_, a1) = (c.tolist() for c in butterworth(1, rules.cutoff, rules.rate))
    mean = _mean(state.raw, p, rules.smooth, state.n)
    y, smooth = state.smooth or 0.0, []
    for u in (b0 * mean + b1 * np.concatenate([[state.mean], mean[:-1]])).tolist():
        y = u - a1 * y
        smooth.append(y)
    smooth = np.array(smooth)
    slopes = np.diff(np.concatenate([[smooth[0] if state.smooth is None else state.smooth], smooth])) * rules.rate
    g = _mean(state.slopes, slopes, rules.smooth, state.n)
    calm = (np.abs(g) <= rules.calm).astype(int)
    total = np.concatenate([[0], np.cumsum([*state.calm, *calm])])
    upto = np.arange(len(state.calm) + 1, len(total))
    enough = total[upto] - total[np.maximum(upto - rules.window, 0)] >= -(-rules.calm_share * rules.window // 1)
    keep = lambda old, new, k: [*old[-k:], *new[-k:].tolist()][-k:]
    state.raw, state.slopes, state.calm = keep(state.raw, p, rules.smooth), keep(state.slopes, slopes, rules.smooth), keep(state.calm, calm, rules.window)
    state.mean, state.smooth, state.n = float(mean[-1]), float(smooth[-1]), state.n + len(p)
    return smooth, g, enough


def feed(state: State, times: list[float], pressures: list[float], rules: Rules = Rules()) -> list[dict]:
    """Takes the next rows of a series in order; gives the cycles that are complete. ``state`` is advanced in place.

    Between cycles only rows that may begin one are looked at, and those that settle a later pressure.
    """
    out: list[dict] = []
    if not len(times):
        return out
    last, before = state.time, state.smooth
    y, slope, enough = _filtered(state, np.asarray(pressures, float), rules)
    onsets = np.flatnonzero(enough & (slope <= rules.onset) & (y > rules.lower))
    y, slope, at, n, cycle, done = y.tolist(), slope.tolist(), 0, len(times), state.cycle, state.done
    earlier = lambda k: (times[k - 1], y[k - 1]) if k else (last, before)
    while at < n:
        if cycle is None:
            place = np.searchsorted(onsets, at)
            onset = int(onsets[place]) if place < len(onsets) else n
            if done is not None:
                asked = [bisect_left(times, done["end"] + wait, at) for wait, open_ in zip(rules.later, done["open"], strict=True) if open_]
                for k in sorted(k for k in asked if k < onset):
                    _look(done, times[k], y[k], earlier(k), rules)
                if not done["open"][-1]:
                    out.append(done)
                    done = None
            if onset < n:
                if done is not None:  # a new onset cancels what hasn't been seen
                    _look(done, times[onset], y[onset], earlier(onset), rules)
                    out.append(done)
                    done = None
                cycle = {"start": times[onset], "first": y[onset], "low": y[onset], "control": None, "checked": False, "held": None}
            at = onset + 1
            continue
        t, smooth, g = times[at], y[at], slope[at]
        at += 1
        cycle["low"] = min(cycle["low"], smooth)
        age = t - cycle["start"]
        drop_it = age >= rules.longest
        if not cycle["checked"] and age >= rules.control_delay:
            cycle["checked"], cycle["control"] = True, t
        if not drop_it and cycle["control"] is not None:
            if g < 0:
                cycle["control"] = None
            else:
                drop_it = t - cycle["control"] >= rules.control_length
        if drop_it:
            cycle = None
            continue
        over, held = cycle["first"] > rules.upper, False
        if over:
            if abs(g) >= rules.hold_gradient:
                cycle["held"] = None
            elif cycle["held"] is None:
                cycle["held"] = t
            else:
                held = t - cycle["held"] >= rules.hold
        if held or (smooth > cycle["first"] - rules.release and g > 0):
            drop = cycle["first"] - cycle["low"]
            if drop >= rules.least_drop:
                done = {"start": cycle["start"], "end": t, "first": cycle["first"], "drop": drop, "over": over, "under": cycle["first"] < rules.lower, "emergency": drop >= rules.emergency, "later": [None, None], "open": [True, True]}
            cycle = None
    state.time, state.cycle, state.done = times[-1], cycle, done
    return out


def _look(done: dict, t: float, smooth: float, before: tuple, rules: Rules) -> None:
    """The later pressures that a sample at ``t`` settles: of it and the one before it the nearer to the instant, the earlier of equals.

    There is none where no sample lies between the end and the instant, or none comes within ``patience`` after it.
    """
    for i, wait in enumerate(rules.later):
        at = done["end"] + wait
        if done["open"][i] and t >= at:
            done["open"][i] = False
            if t - at <= rules.patience and (t == at or before[0] > done["end"]):
                done["later"][i] = before[1] if at - before[0] <= t - at else smooth


def deadline(state: State, rules: Rules = Rules()) -> float | None:
    """When nothing more can be learnt about the cycle that is awaited."""
    return None if state.done is None else state.done["end"] + rules.later[-1] + rules.patience


def flush(state: State) -> list[dict]:
    """What is still awaited when a series ends."""
    out = [state.done] if state.done is not None else []
    state.done = None
    return out


SCHEMA = "start double, end double, init_pressure double, drop double, over boolean, under boolean, emergency boolean, after20 double, after60 double"


def frame(found: list[dict]) -> pd.DataFrame:
    rows = [(c["start"], c["end"], c["first"], c["drop"], c["over"], c["under"], c["emergency"], *c["later"]) if c else (None,) * 9 for c in found]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def _runs(columns: list[pd.Series]) -> list[tuple[int, int]]:
    """First row and end of each run of rows whose columns are equal, nulls with nulls."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        before = c.shift()
        new |= ((c != before) & ~(c.isna() & before.isna())).to_numpy(bool)
    cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:])) if n else []


def _advance(keys: list[str], rules: Rules, taken: set[int], goes_on: set[int], starts: dict[int, str] | None):
    """Cycles of the series in a segment, and the state of its last series where that goes on in the next segment.

    Without ``starts``, of the series that begin in the segment; with them, of its first series, which has begun before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = key = segment = None
        state = State()
        for pdf in frames:
            times, pressures, found = pdf["_t"].tolist(), pdf["_p"].to_numpy(), []
            for a, b in _runs([pdf[k] for k in keys]):
                k, span = tuple(None if pd.isna(v) else v for v in (pdf[c].iloc[a] for c in keys)), slice(a, b)
                if segment is None:
                    segment, first, key = int(pdf["_segment"].iloc[0]), k, k
                    if starts is not None:
                        state = State.load(starts[segment])
                if k != key:
                    if mine(segment, key == first):
                        found += [(key, c) for c in flush(state)]
                    key, state = k, State()
                if mine(segment, key == first):
                    found += [(key, c) for c in feed(state, times[span], pressures[span], rules)]
            yield _rows(found)
        if segment is not None and mine(segment, key == first):
            yield _rows([(key, {})]).assign(_state=state.dump(), _segment=segment) if segment in goes_on else _rows([(key, c) for c in flush(state)])

    def mine(segment: int, is_first: bool) -> bool:
        return is_first if starts is not None else not (is_first and segment in taken)

    def _rows(found: list[tuple[tuple, dict]]) -> pd.DataFrame:
        out = frame([c for _, c in found])
        for i, name in enumerate(keys):
            out.insert(i, name, pd.Series([k[i] for k, _ in found], dtype=object))
        return out.assign(_state=None, _segment=0)

    return run


def detect(samples: DataFrame, keys: list[str], time: str, pressure: str, order: str, rules: Rules = Rules(), parts: int | None = None, laid: DataFrame | None = None) -> DataFrame:
    """Cycles of every series, numbered within it. Rows without time or pressure are left out.

    Series are laid out in segments, so a task holds a batch of rows and a state, whatever a series' length. One pass takes the
    series where they begin; the stretch of a series beyond a cut takes over its state in a second pass. Only a series that
    fills whole segments takes a pass for each of them, as its states follow one another.

    Samples that are made in place from rows that ``segmented`` laid out, in order, each row at least one sample, aren't laid out
    again: ``laid`` has those rows, and the samples keep their _segment.
    """
    spark = samples.sparkSession
    ship(spark)
    d = samples.where(F.col(time).isNotNull() & F.col(pressure).isNotNull())
    value = [F.col(time).cast("double").alias("_t"), F.col(pressure).cast("double").alias("_p")]
    if laid is None:
        d = laid = segmented(d.select(*keys, *value, F.col(order).alias("_order")), keys, ["_t", "_order"], parts)
    else:
        d = d.select(*keys, *value, "_segment")
    edges = laid.groupBy("_segment").agg(F.min_by(F.struct(*keys), "_at").alias("a"), F.max_by(F.struct(*keys), "_at").alias("b")).orderBy("_segment").collect()  # a row a segment
    goes_on = {x["_segment"]: y["_segment"] for x, y in zip(edges, edges[1:]) if x["b"] == y["a"]}
    whole = {x["_segment"] for x in edges if x["a"] == x["b"]}
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def advanced(rows: DataFrame, starts: dict[int, str] | None) -> DataFrame:
        out = rows.select(*keys, "_t", "_p", "_segment").mapInPandas(_advance(keys, rules, set(goes_on.values()), set(goes_on) & (whole if starts else set(goes_on)), starts), f"{kinds}, {SCHEMA}, _state string, _segment int")
        return out.checkpoint() if goes_on else out

    passes = [advanced(d, None)]
    while goes_on and (left := passes[-1].where("_state IS NOT NULL").select("_segment", "_state").collect()):  # a row a segment
        starts = {goes_on[r["_segment"]]: r["_state"] for r in left}
        # Only the first series of these segments has begun before; a row a segment is broadcast.
        firsts = spark.createDataFrame([(x["_segment"], *x["a"]) for x in edges if x["_segment"] in starts], ", ".join(["_at_segment int", *[f"_of_{i} {samples.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]]))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)], F.col("_segment") == F.col("_at_segment"))
        passes.append(advanced(d.where(F.col("_segment").isin(sorted(starts))).join(F.broadcast(firsts), same, "left_semi"), starts))
    found = reduce(DataFrame.unionAll, passes).where("_state IS NULL")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start")).cast("long")
    return found.select(*keys, nth.alias("cycle"), *[c.split()[0] for c in SCHEMA.split(", ")])
