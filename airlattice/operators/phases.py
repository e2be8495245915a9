"""What a braking phase holds: cylinder, load and GPS slices, the sub-phases of pipe and cylinder, and derived columns.

Slices are bucketed range joins and aggregates. The sub-phases need the order of the rows and a state, so the samples of one
phase go through a small fold in an Arrow function; a phase is at most half an hour of one sensor, which bounds a group.
Times are seconds, pressures bar.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airlattice.session import ship

from . import joins

#: Fixed values of the domain.
ENGAGED, ACTION, TAIL_S, TAIL_ROWS, TAIL_SHARE = 0.4, 0.6, 10.0, 40, 0.7
FLAT_S, FLAT_RANGE, FLAT_GRADIENT, NEAR_ZERO = 5.0, 0.05, 0.01, 0.05
SATURATED = 1.5
LOW_BATTERY, STUCK_RPM = 10.0, 308.0
MS = 1000


# --- slices ----------------------------------------------------------------------------------------------------


#: Samples, or what makes the samples of given phases (with _ms and the phase's end), to so many seconds past their ends.
Samples = DataFrame | Callable[[DataFrame, float], DataFrame]


def _within(samples: Samples, phases: DataFrame, keys: list[str], after: float) -> DataFrame:
    """Samples of each phase, from its start to ``after`` seconds past its end; times as whole milliseconds.

    ``samples`` may also be a function of (phases, after) that makes these rows itself, where they needn't be looked for.
    """
    if callable(samples):
        return samples(phases, after)
    spans = phases.select(*keys, "phase", (F.col("start") * MS).cast("long").alias("_a"), ((F.col("end") + after) * MS).cast("long").alias("_b"), "end")
    rows = samples.withColumn("_ms", (F.col("t") * MS).cast("long")).withColumn("_key", F.to_json(F.struct(*keys))).drop(*keys)
    return joins.range_join(rows, spans.withColumn("_key", F.to_json(F.struct(*keys))), "_ms", "_a", "_b", 60 * MS, "_key").drop("_key", "_a", "_b")


def _emptied(met: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each phase and cylinder up to where it has emptied."""
    one = Window.partitionBy(*keys, "phase", "sensor")
    order = one.orderBy("_ms")
    falling = F.avg((F.col("g") < 0).cast("double")).over(order.rowsBetween(-(TAIL_ROWS - 1), 0))
    full = F.count(F.lit(1)).over(order.rowsBetween(-(TAIL_ROWS - 1), 0)) == TAIL_ROWS
    tail = F.col("_ms") > (F.col("end") * MS).cast("long")
    met = met.withColumn("_stop", F.when(tail & full & (F.col("p") < ENGAGED) & (falling > TAIL_SHARE), F.col("_ms")))
    return met.withColumn("_last", F.min("_stop").over(one)).where(F.col("_last").isNull() | (F.col("_ms") <= F.col("_last"))).drop("_stop", "_last")


def cylinder_rows(samples: Samples, phases: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, sensor, t, p, p10, g) of each phase and cylinder: to the pipe's end, and then up to ten seconds until the
    cylinder has emptied (below ``ENGAGED``, gradient negative in more than ``TAIL_SHARE`` of the last ``TAIL_ROWS`` rows).
    A row that an earlier phase's tail has taken isn't taken again; phases are numbered by their start.

    Only phases whose spans meet another one's can share rows: how far these reach is found first, so rows aren't compared.
    """
    names = [*keys, "phase", "sensor"]
    time = Window.partitionBy(*keys).orderBy("start")
    before, after = F.max("end").over(time.rowsBetween(Window.unboundedPreceding, -1)), F.min("start").over(time.rowsBetween(1, Window.unboundedFollowing))
    slack = TAIL_S + 1 / MS
    meet = phases.withColumn("_meet", F.coalesce(before + slack >= F.col("start"), F.lit(False)) | F.coalesce(after <= F.col("end") + slack, F.lit(False))).where("_meet").drop("_meet")
    reach = _emptied(_within(samples, meet, keys, TAIL_S), keys).groupBy(*names).agg(F.max("_ms").alias("_reach"))
    earlier = Window.partitionBy(*keys, "sensor").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    taken = reach.select(*names, F.max("_reach").over(earlier).alias("_taken")).where("_taken IS NOT NULL")
    met = _emptied(_within(samples, phases, keys, TAIL_S), keys).join(taken, names, "left")
    return met.where(F.col("_taken").isNull() | (F.col("_ms") > F.col("_taken"))).drop("_taken")


def cylinder_flags(rows: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """By phase and cylinder: how it starts, whether it brakes, its end and maximum. A phase of over-pressure has errors only."""
    names = [*keys, "phase", "sensor"]
    t0 = F.min("t").over(Window.partitionBy(*names))
    d = rows.withColumn("_age", F.col("t") - t0)
    head = F.col("_age") <= FLAT_S
    a = d.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("p", "t").alias("first_p"), F.max("_age").alias("_span"), F.max("p").alias("max_pressure"), F.max_by("p", "t").alias("end_pressure"), F.min("t").alias("start_time"), F.max("t").alias("end_time"),
        (F.max(F.when(head, F.col("p"))) - F.min(F.when(head, F.col("p")))).alias("_dp"), F.avg(F.when(head, F.col("p"))).alias("_p"), F.avg(F.when(head, F.col("g"))).alias("_g"), F.max("p").alias("_high"),
    )
    known = (F.col("n") >= 5) & (F.col("_span") >= FLAT_S)
    flat = known & (F.abs("_g") < FLAT_GRADIENT) & (F.col("_dp") < FLAT_RANGE)
    flags = {"above_start": F.col("first_p") >= ENGAGED, "flat_near_zero": flat & (F.col("_p") < NEAR_ZERO), "already_engaged": flat & (F.col("_p") >= NEAR_ZERO), "releasing_start": known & ~flat & (F.col("_g") < -FLAT_GRADIENT)}
    a = a.withColumns(flags)
    bad = F.col("above_start") | F.col("flat_near_zero") | F.col("already_engaged") | F.col("releasing_start")
    a = a.withColumn("bad_start", bad).withColumn("normal", F.col("_high") >= ACTION).withColumn("low_braking", ~bad & (F.col("_high") < ACTION))
    over = a.join(phases.select(*keys, "phase", "over"), [*keys, "phase"])
    null = lambda c: F.when(~F.col("over"), F.col(c)).alias(c)
    return over.select(*names, "n", (F.col("over") | F.col("bad_start")).alias("sensor_error"), *[(~F.col("over") & F.col(c)).alias(c) for c in ("bad_start", "normal", "low_braking", *flags)], *[null(c) for c in ("start_time", "end_time", "max_pressure", "end_pressure")])


def load_slices(samples: Samples, phases: DataFrame, keys: list[str], sensors: DataFrame | None = None) -> DataFrame:
    """By phase and load sensor: rows, mean rounded to even at one decimal, and an error below two rows or under over-pressure.
    ``sensors`` (keys, sensor) is found from the samples unless given."""
    sensors = samples.select(*keys, "sensor").distinct() if sensors is None else sensors
    met = _within(samples, phases, keys, 0).groupBy(*keys, "phase", "sensor").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("m"))
    all_ = phases.select(*keys, "phase", "over").join(sensors, keys).join(met, [*keys, "phase", "sensor"], "left")
    good = ~F.col("over") & (F.coalesce("n", F.lit(0)) >= 2)
    return all_.select(*keys, "phase", "sensor", F.when(F.col("over"), 0).otherwise(F.coalesce("n", F.lit(0))).alias("n"), F.when(good, F.bround("m", 1)).alias("mean_pressure"), (~good).alias("sensor_error"))


def gps_slices(fixes: Samples, phases: DataFrame, cylinders: DataFrame, keys: list[str]) -> DataFrame:
    """By phase: GPS rows from its start to the latest end of its cylinders (else its own): last position, mean, first and last speed,
    error below two rows; rows of a low battery and of the current board's constant, where the fixes have vbatt and rpm."""
    last = cylinders.groupBy(*keys, "phase").agg(F.max("end_time").alias("_last"))
    spans = phases.join(last, [*keys, "phase"], "left").withColumn("end", F.coalesce("_last", "end"))
    rows_ = _within(fixes, spans, keys, 0)
    met = rows_.groupBy(*keys, "phase")
    stuck = lambda c: F.when(F.abs(F.col(c) - 53.4641) >= 1e-4, F.col(c))
    rows = lambda c, wrong: F.sum(wrong(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(LOW_BATTERY))).cast("int")) if c in rows_.columns else F.lit(0)
    a = met.agg(rows("vbatt", lambda x: x < LOW_BATTERY).cast("long").alias("_vb"), rows("rpm", lambda x: x == STUCK_RPM).cast("long").alias("_cb"), F.count(F.lit(1)).alias("n"), F.max_by(stuck("lat"), F.when(stuck("lat").isNotNull(), F.col("t"))).alias("lat_last"), F.max_by(stuck("lon"), F.when(stuck("lon").isNotNull(), F.col("t"))).alias("lon_last"), F.avg(stuck("speed")).alias("speed_mean"), F.min_by("speed", "t").alias("_s0"), F.max_by("speed", "t").alias("_s1"), (F.max("t") - F.min("t")).alias("_dt"))
    out = phases.select(*keys, "phase").join(a, [*keys, "phase"], "left")
    good = F.coalesce("n", F.lit(0)) >= 2
    part = lambda c: F.when(good, c)
    return out.select(*keys, "phase", F.when(good, F.col("n")).otherwise(0).alias("gps_n"), (~good).alias("gps_error"), part(F.col("lat_last")).alias("lat_last"), part(F.col("lon_last")).alias("lon_last"), part(F.col("speed_mean")).alias("speed_mean"), F.coalesce("_s0", F.lit(0.0)).alias("speed_start"), F.coalesce("_s1", F.lit(0.0)).alias("speed_end"), F.coalesce("_vb", F.lit(0)).alias("gateway_vb_error"), F.coalesce("_cb", F.lit(0)).alias("gateway_cb_error"), F.coalesce(part(F.col("_s1") - F.col("_s0")), F.lit(0.0)).alias("speed_difference"), F.coalesce(part(F.try_divide(F.col("_s1") - F.col("_s0"), "_dt")), F.lit(0.0)).alias("speed_gradient"))


# --- sub-phases ------------------------------------------------------------------------------------------------


@dataclass
class Marks:
    """Row numbers of the parts of a phase, in the order in which they were taken."""

    brake: list[int] = field(default_factory=list)
    buildup: list[int] = field(default_factory=list)
    release: list[int] = field(default_factory=list)
    early: list[int] = field(default_factory=list)
    again: int = 0

    def back_to_brake(self, more: list[int] | None = None) -> None:
        self.brake += self.release + (more or [])
        self.release = []
        self.again += 1


def pipe_marks(drop: np.ndarray, g: np.ndarray, lag: int, idle: float = 0.05) -> Marks:
    """Idle, buildup, braking and releasing of a pipe by its gradient and its fall from the start (``drop``)."""
    m, state, steady, flat = Marks(), "idle", 0, 0
    for i in range(1, len(g) - 1):
        if state == "idle":
            state = "buildup" if g[i] < -0.05 else state
        elif state == "releasing":
            m.release.append(i)
            if drop[i] > SATURATED:
                state, flat = "braking", 0
                m.back_to_brake()
                m.again -= 1
            flat = flat + 1 if abs(g[i]) <= 0.005 else 0
            if g[i] < -0.05 or flat >= 400:
                state, flat = "braking", 0
                m.back_to_brake()
            elif drop[i] < idle:
                state, flat = "idle", 0
        else:
            m.brake.append(i)
            if state == "buildup":
                m.buildup.append(i)
            steady = steady + 1 if g[i] >= 0.01 else 0
            if g[i] > 0.05 or steady >= 40 or (i > lag and drop[i] - drop[i - lag] <= -0.2):
                state, steady, flat = "releasing", 0, 0
    return m


def cylinder_marks(t: np.ndarray, p: np.ndarray, g: np.ndarray, early: bool) -> Marks:
    """Idle, buildup, braking and releasing of a cylinder; a valley of under thirty seconds is stitched to the brake, and a
    release that stays flat was none. ``early`` asks for the rows of the first rise up to ``ENGAGED``."""
    m, state, flat, risen, filled = Marks(), "idle", 0, False, False
    valley: list[int] | None = None
    since: float | None = None  # when a rise out of a valley began
    for i in range(1, len(p)):
        if state == "idle":
            stitched = False
            if risen and g[i] > 0.05 and since is None:
                since = t[i - 1]
            if valley is not None:
                valley.append(i)
            if since is not None:
                if p[i] >= ENGAGED:
                    stitched, since = True, None
                elif t[i] - since >= 30:
                    since, valley = None, None
            if g[i] > 0.05 and risen and stitched:
                m.back_to_brake(valley)
                m.brake.append(i - 1)
                state, valley, risen, filled = "braking", None, False, False
            elif g[i] > 0.05 and not risen:
                state, valley, filled, flat = "buildup", None, False, 0
        elif state == "buildup":
            m.brake.append(i)
            m.buildup.append(i)
            if early and not filled:
                m.early.append(i)
            filled, risen = filled or p[i] >= ENGAGED, risen or p[i] >= ACTION
            flat = flat + 1 if abs(g[i]) <= 0.01 else 0
            if risen and (flat >= 210 or g[i] < -0.05):
                state, flat = "releasing", 0
        elif state == "braking":
            m.brake.append(i)
            risen = risen or p[i] >= ENGAGED
            if g[i] < -0.05 and risen:
                m.release.append(i - 1)
                state = "releasing"
        else:
            m.release.append(i - 1)
            flat = flat + 1 if abs(g[i]) <= 0.01 else 0
            if flat >= 210 and len(m.release) >= 210:
                if p[m.release[0]] - p[i] < 0.05:
                    state, flat = "braking", 0
                    m.back_to_brake()
            elif g[i] > 0.05:
                state = "braking"
                m.back_to_brake()
            elif p[i] < ENGAGED and risen:
                state, flat, valley = "idle", 0, [i - 1]
    return m


def ratio(a: float, b: float) -> float:
    return a / b if b else np.nan


def part(name: str, t: np.ndarray, p: np.ndarray, empty: float) -> dict[str, float]:
    """Start, end, duration, energy, power and gradient of a part; ``empty`` (0 or NaN) where it has no rows."""
    keys = ("start", "end", "first", "last", "timing", "energy", "power", "gradient")
    if not len(t):
        return {f"{name}_{k}": np.nan if k in ("start", "end") else empty for k in keys}
    timing = float(t[-1] - t[0])
    energy = float(np.trapezoid(p, t)) if len(t) > 1 else empty
    values = (t[0], t[-1], p[0], p[-1], timing, energy, ratio(energy, timing), ratio(p[-1] - p[0], timing))
    return {f"{name}_{k}": float(v) for k, v in zip(keys, values, strict=True)}


def split(p: np.ndarray, buildup: list[int]) -> int | None:
    """How many rows of the brake are its buildup: up to the first that has nine tenths of the buildup's maximum."""
    own = p[buildup]
    return int(np.argmax(own >= 0.9 * own.max())) if len(own) else None


def pipe_parts(t: np.ndarray, p: np.ndarray, g: np.ndarray) -> dict[str, float]:
    """Sub-phases of a pipe; pressures are falls from the first row, saturated to [0, 1.5]."""
    drop = p[0] - p
    step = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    m = pipe_marks(drop, g, max(1, round(1.0 / step)) if step > 0 else 1)
    q = np.clip(drop, 0, SATURATED)
    brake, cut = np.array(m.brake, int), split(q, m.buildup)
    none = np.zeros(0, int)
    rows = {"brake": brake, "buildup": none if cut is None else brake[: cut + 1], "holding": none if cut is None else brake[cut:], "release": np.array(m.release, int)}
    out: dict[str, float] = {}
    for name, i in rows.items():
        out |= part(name, t[i], q[i], 0.0)
    inner = drop[1:-1]
    mean = float(inner.mean()) if len(inner) else 0.0
    total = out["brake_energy"] + out["release_energy"]
    out |= {"total_energy": total, "total_power": ratio(total, out["brake_timing"] + out["release_timing"]), "max_pressure": max(0.0, float(inner.max())) if len(inner) else 0.0, "mean": mean, "std": float(np.sqrt(max(0.0, (inner**2).mean() - mean**2))) if len(inner) else 0.0, "again": float(m.again >= 1)}
    return out


def first_rise(name: str, t: np.ndarray, p: np.ndarray) -> dict[str, float]:
    """Shape of the first rise up to ``ENGAGED``: duration, half time, rates, curvature, turning point, energy."""
    keys = ("timing", "half", "half_ratio", "rate", "first_gradient", "max_gradient", "curvature", "inflection", "energy", "power")
    at = np.flatnonzero(p >= ENGAGED)
    if not len(at) or at[0] < 1 or at[0] >= len(t):
        return {f"{name}_{k}": np.nan for k in keys}
    s, q = t[: at[0] + 1] - t[0], p[: at[0] + 1]
    timing = float(s[-1])
    slope = np.gradient(q, s)
    bend = np.gradient(slope, s) / (1 + slope**2) ** 1.5
    half = float(s[np.argmax(q >= 0.2)])
    low = np.flatnonzero(q <= 0.1)
    first = ratio(q[low[-1]] - q[0], s[low[-1]]) if len(low) and low[-1] >= 1 else np.nan
    turn = np.flatnonzero(np.diff(np.sign(bend)) != 0)
    energy = float(np.trapezoid(q, s))
    values = (timing, half, ratio(half, timing), ratio(ENGAGED - q[0], timing), first, slope.max(), np.nanmean(np.abs(bend)), s[turn[0]] if len(turn) else np.nan, energy, ratio(energy, timing))
    return {f"{name}_{k}": float(v) for k, v in zip(keys, values, strict=True)}


def late_release(p: np.ndarray) -> tuple[int, int] | None:
    """First and last row of the release of a brake that never released by its gradient: from just below its peak to 0.4 bar, or
    to half of a low peak. None where it never gets there."""
    top = int(p.argmax())
    if top >= len(p) - 1:
        return None
    below = np.flatnonzero(p[top + 1 :] <= p[top] - 0.005)
    first = min(top + 1 + (int(below[0]) if len(below) else 0), len(p) - 1)
    gone = np.flatnonzero(p[first:] <= (ENGAGED if p[top] > 0.42 else p[top] / 2))
    return (first, first + int(gone[0])) if len(gone) and gone[0] > 0 else None


def mode(timing: float, passenger: tuple[float, float], goods: tuple[float, float]) -> str:
    return "P" if passenger[0] <= timing <= passenger[1] else "G" if goods[0] <= timing <= goods[1] else "unknown"


def cylinder_parts(t: np.ndarray, p: np.ndarray, p10: np.ndarray, g: np.ndarray, normal: bool, bad_start: bool, emergency: bool) -> dict:
    """Sub-phases of a cylinder; null where a part has no rows."""
    m = cylinder_marks(t, p, g, not bad_start and len(p10) > 0 and p10[0] < 0.1)
    brake, buildup, cut = np.array(m.brake, int), np.array(m.buildup, int), split(p, m.buildup)
    release = np.array(m.release, int)
    none = np.zeros(0, int)
    holding = none if cut is None else brake[cut:]
    gave_up = False
    if len(release):
        low = np.flatnonzero(p[release] < ENGAGED)
        release = release[: low[0] + 1] if len(low) else release
    elif not normal and len(brake):
        gave_up = int(p[brake].argmax()) >= len(brake) - 1
        found = late_release(p[brake])
        if found is not None:
            a, b = found
            release = brake[a : b + 1]
            holding = none if cut is None else brake[cut : max(cut, a - 1) + 1]
            brake = brake[:a]
    out: dict = {}
    for name, i in {"brake": brake, "buildup": none if cut is None else buildup[: cut + 1], "holding": holding, "release": release}.items():
        out |= part(name, t[i], p[i], np.nan)
    # Rows of the fast filter share the times of the buildup from its first row on.
    early = np.array(m.early, int)
    out |= first_rise("rise10", t[buildup[: len(early)]] if len(early) <= len(buildup) else t[:0], p10[early]) | first_rise("rise", t[buildup] if len(early) else t[:0], p[buildup] if len(early) else p[:0])
    build_mode = mode(out["buildup_timing"], (3.5, 4.5), (21, 27)) if emergency and cut is not None else "unknown"
    release_mode = mode(out["release_timing"], (15.5, 19.5), (46.5, 58.5)) if emergency and len(release) else "unknown"
    wrong = emergency and (cut is not None and build_mode == "unknown" or bool(len(m.release)) and release_mode == "unknown")
    inner = p[1:]
    mean = float(inner.mean()) if len(inner) else 0.0
    total, spent = out["brake_energy"] + out["release_energy"], out["brake_timing"] + out["release_timing"]
    out |= {"total_timing": spent, "total_energy": total, "total_power": ratio(total, spent), "max_pressure": float(inner.max()) if len(inner) else np.nan, "mean": mean, "std": float(np.sqrt(max(0.0, (inner**2).mean() - mean**2))) if len(inner) else 0.0}
    out |= {"again": float(m.again), "mode_error": float(wrong)}
    if gave_up:  # the peak is the last row: there is no summary
        out |= dict.fromkeys(("total_timing", "total_energy", "total_power", "max_pressure", "mean", "std", "again", "mode_error"), np.nan)
    return out | {"mode": build_mode if build_mode != "unknown" else release_mode, "non_standard": not normal}


PIPE = list(pipe_parts(np.zeros(3), np.zeros(3), np.zeros(3)))
CYLINDER = [k for k in cylinder_parts(np.zeros(3), np.zeros(3), np.zeros(3), np.zeros(3), True, False, False) if k not in ("mode", "non_standard")]


def _columns(rows: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of a phase's rows in the order of time, unknown values as NaN."""
    order = np.argsort(rows["t"].to_numpy().astype(float), kind="stable")
    return [rows[c].to_numpy().astype(float)[order] for c in names]


def _row(values: dict, schema: pa.Schema) -> pa.Table:
    """A table of one row; NaN becomes null."""
    return pa.Table.from_arrays([pa.array([values[f.name]], f.type, from_pandas=True) for f in schema], schema=schema)


def _schema(rows: DataFrame, names: list[str], more: str) -> StructType:
    return StructType.fromDDL(", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in names] + [more]))


def pipe_subphases(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-phases by keys and phase of the pipe's rows (keys, phase, t, p, g). A phase that can't be cut gives its error instead."""
    ship(rows.sparkSession)
    names = [*keys, "phase"]
    schema = _schema(rows, names, ", ".join([f"{c} double" for c in PIPE] + ["error string"]))
    arrow = to_arrow_schema(schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        try:
            found, error = pipe_parts(*_columns(rows, ("t", "p", "g"))), None
        except (ValueError, IndexError) as e:
            found, error = dict.fromkeys(PIPE, np.nan), str(e)
        return _row(dict(zip(names, (k.as_py() for k in key), strict=True)) | found | {"error": error}, arrow)

    return rows.select(*names, "t", "p", "g").groupBy(*names).applyInArrow(run, schema)


def cylinder_subphases(rows: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-phases by keys, phase and sensor of the cylinders' rows; ``flags`` has normal, bad_start and emergency."""
    ship(rows.sparkSession)
    names = [*keys, "phase", "sensor"]
    schema = _schema(rows, names, ", ".join([f"{c} double" for c in CYLINDER] + ["mode string", "non_standard boolean", "error string"]))
    arrow = to_arrow_schema(schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        state = [bool(rows[c][0].as_py()) for c in ("normal", "bad_start", "emergency")]
        try:
            found, error = cylinder_parts(*_columns(rows, ("t", "p", "p10", "g")), *state), None
        except (ValueError, IndexError) as e:
            found, error = dict.fromkeys(CYLINDER, np.nan) | {"mode": None, "non_standard": None}, str(e)
        return _row(dict(zip(names, (k.as_py() for k in key), strict=True)) | found | {"error": error}, arrow)

    met = rows.select(*names, "t", "p", "p10", "g").join(flags.select(*names, "normal", "bad_start", "emergency"), names)
    return met.groupBy(*names).applyInArrow(run, schema)


# --- derived columns -------------------------------------------------------------------------------------------


def null_nan(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def reference_phase(samples: Samples, phases: DataFrame, cylinders: DataFrame, loads: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, phase, eligible, score, reference): which phase a kit's pairs are read from, the first of the highest score.

    A phase is eligible if its pipe has ``least`` samples or more, and as many cylinders without an error that brake, and load sensors
    without one, as any of the kit's phases has sensors. It scores 100, and 10 less if it is of over- or under-pressure or an emergency.
    """
    names = [*keys, "phase"]
    n = _within(samples, phases, keys, 0).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    bc = cylinders.groupBy(*names).agg(F.count(F.lit(1)).alias("bc"), F.sum((~F.col("sensor_error") & F.col("normal")).cast("int")).alias("bc_valid"))
    wv = loads.groupBy(*names).agg(F.count(F.lit(1)).alias("wv"), F.sum((~F.col("sensor_error")).cast("int")).alias("wv_valid"))
    d = phases.select(*names, (F.col("over") | F.col("under") | F.col("emergency")).alias("error"))
    for part in (n, bc, wv):
        d = d.join(part, names, "left")
    most = d.groupBy(*keys).agg(F.coalesce(F.max("bc"), F.lit(0)).alias("bc_wanted"), F.coalesce(F.max("wv"), F.lit(0)).alias("wv_wanted"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = (zero("n") >= least) & (zero("bc_valid") == F.col("bc_wanted")) & (zero("wv_valid") == F.col("wv_wanted"))
    d = d.join(most, keys).select(*names, ok.alias("eligible"), F.when(ok, 100 - 10 * F.col("error").cast("int")).alias("score"))
    best = d.where("eligible").groupBy(*keys).agg(F.max_by("phase", F.struct(F.col("score"), -F.col("phase"))).alias("_best"))
    return d.join(best, keys, "left").select(*names, "eligible", "score", F.coalesce(F.col("phase") == F.col("_best"), F.lit(False)).alias("reference"))


def derived(pipe: str = "pipe_", cylinder: str = "cyl_", load: str = "load", init: str = "init") -> dict[str, Column]:
    """Error flags, efficiencies, delays and ratios of a row with the parts of a pipe and of a cylinder, as columns by name.

    A quotient by 0 is null, a sum skips what is missing, a difference needs both. A timing that is null raises the
    classification error, as one of 0 does.
    """
    c = lambda side, name: null_nan(f"{side}{name}")
    quotient = lambda a, b: F.when(b != 0, a / b)
    added = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    out: dict[str, Column] = {"mbp_sensor_error": flag(null_nan(init) <= 0), "emergency_brake_action": flag(c(pipe, "max_pressure") >= SATURATED)}
    for side, tag in ((pipe, "pipe"), (cylinder, "cylinder")):
        times = [c(side, "brake_timing"), c(side, "release_timing")]
        out[f"{tag}_classification_error"] = F.greatest(*[(x.isNull() | (F.coalesce(x, F.lit(0.0)) < 0.001)).cast("int") for x in times])
        out[f"{tag}_timing_error"] = F.greatest(*[(F.coalesce(x, F.lit(0.0)) > 200).cast("int") for x in times])
    for kind in ("power", "energy"):
        brake = quotient(c(cylinder, f"brake_{kind}"), c(pipe, f"brake_{kind}"))
        release = quotient(c(cylinder, f"release_{kind}"), c(pipe, f"release_{kind}"))
        out[f"brake_{kind}_efficiency"], out[f"release_{kind}_efficiency"], out[f"total_{kind}_efficiency"] = brake, release, added(brake, release)
        out[f"{kind}_ratio"] = quotient(c(cylinder, f"total_{kind}"), c(pipe, f"total_{kind}"))
        delays = [c(cylinder, f"{p}_{kind}") - c(pipe, f"{p}_{kind}") for p in ("brake", "release")]
        out[f"brake_{kind}_delay"], out[f"release_{kind}_delay"], out[f"total_{kind}_delay"] = *delays, delays[0] + delays[1]
    out["normalized_power"] = out["total_power_efficiency"] * quotient(c(cylinder, "max_pressure"), c(pipe, "max_pressure"))
    out["weighted_power"] = quotient(out["normalized_power"], null_nan(load))
    out["mean_delay"], out["std_delay"] = c(cylinder, "mean") - c(pipe, "mean"), c(cylinder, "std") - c(pipe, "std")
    out["buildup_end_delay"], out["release_start_delay"] = c(cylinder, "buildup_last") - c(pipe, "buildup_last"), c(cylinder, "release_first") - c(pipe, "release_first")
    return out
