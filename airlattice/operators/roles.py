"""Roles of a kit's pressure sensors, from the steady stretch in which the pipe is filled.

Sensors are laid on one time grid, smoothed without delay, and marked where they hold still. The longest stretch in which
every sensor of a kit holds still and one of them is above the filling pressure gives each sensor's median, and the
medians give the roles. Series that fit in a task's memory many times over are dealt to tasks whole; longer ones are laid
out by (kit, sensor) in segments, so a sensor of any length is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from airlattice.session import shared_dir

from . import filters, segments
from .series import roles


@dataclass(frozen=True)
class Rules:
    """Grid rate and cutoff in Hz, steepest slope a second, farthest sample and shortest stretch in seconds, longest in minutes, and the pressures that part the roles."""

    rate: float = 5.0
    cutoff: float = 1.0
    slope: float = 0.01
    reach: float = 3.0
    shortest: float = 15.0
    longest: float = 10.0
    full: float = 4.6
    empty: float = 0.2


SENSOR = ["kit", "sensor"]
#: Of the filter.
DEGREE = 4


def inpainted(df: DataFrame, keys: list[str], place: str, x: str, parts: int | None = None) -> DataFrame:
    """``x`` with nulls filled along ``place`` (whole numbers): linearly between known values, held at the edges; a series without any stays null."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(place).alias("p"), F.col(x).alias("v")))
    d = segments.fold(segments.segmented(df, keys, [place], parts), keys, _b=segments.last(known), _a=segments.next_(known))
    part = F.try_divide(F.col(place) - F.col("_b.p"), F.col("_a.p") - F.col("_b.p"))
    filled = F.coalesce(F.col(x), F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * part, F.col("_b.v"), F.col("_a.v"))
    return d.withColumn(x, filled).drop("_b", "_a", "_at", "_segment")


def _points(samples: DataFrame) -> DataFrame:
    """(kit, sensor, t, p): of equal times the first by seq counts."""
    good = samples.where(F.col("t").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))
    return good.groupBy(*SENSOR, "t").agg(F.min_by("p", "seq").alias("p"))


def grids(samples: DataFrame, rules: Rules) -> DataFrame:
    """(kit, t0, m, longest): the start of each kit's grid, its points, and the times of the sensor that has most of them.

    It goes from the last sensor's start to the first one's end. Kits of which a sensor has fewer than two times, or whose
    sensors share no stretch of time, have no grid.
    """
    ends = _points(samples).groupBy(*SENSOR).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    every = samples.select(*SENSOR).distinct().join(ends, SENSOR, "left")
    kits = every.groupBy("kit").agg(F.max("lo").alias("t0"), F.min("hi").alias("t1"), F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max("n").alias("longest")).where("least >= 2 AND t0 < t1")
    return kits.select("kit", "t0", F.ceil((F.col("t1") - F.col("t0")) * rules.rate + 1).alias("m"), "longest")


def gridded(d: DataFrame, rules: Rules) -> DataFrame:
    """(kit, sensor, g, t, y, near): points (kit, sensor, t, p, after, t0, m), each with the next one, on the kit's grid; order and partitions stay.

    ``near`` says whether a sample lies within reach. y is null where the grid's last point lies beyond a sensor's end.
    """
    at = lambda t: F.ceil((t - F.col("t0")) * rules.rate)
    first = F.greatest(at(F.col("t")), F.lit(0))
    upto = F.least(F.coalesce(at(F.col("after.t")), F.col("m")) - 1, F.col("m") - 1)
    d = d.where(first <= upto).withColumn("g", F.explode(F.sequence(first, upto))).withColumn("at", F.col("t0") + F.col("g") / rules.rate)
    y = F.when(F.col("at") == F.col("t"), F.col("p")).otherwise(F.col("p") + (F.col("after.p") - F.col("p")) * (F.col("at") - F.col("t")) / (F.col("after.t") - F.col("t")))
    gap = F.least(F.col("at") - F.col("t"), F.col("after.t") - F.col("at"))
    return d.select(*SENSOR, "g", F.col("at").alias("t"), y.alias("y"), (gap <= rules.reach).alias("near"))


def _still(rules: Rules):
    """``smoothed`` for whole series on their grid."""
    f, pad = filters.Filter.of(*filters.butterworth(DEGREE, rules.cutoff, rules.rate)), 3 * (DEGREE + 1)

    def each(d: pd.DataFrame, n: np.ndarray) -> pd.DataFrame:
        x, near = d["y"].to_numpy(dtype=float), d["near"].to_numpy(dtype=bool)
        x = x[np.maximum.accumulate(np.where(np.isnan(x), 0, np.arange(len(x))))]  # held beyond the sensor's end
        y = np.where(near, filters.both_ways(f, x, n, pad), np.nan)
        slope = np.diff(y, prepend=0.0) * rules.rate
        slope[np.cumsum(n) - n] = 0.0
        return d.drop(columns="near").assign(y=y, steady=near & (np.abs(slope) < rules.slope))

    return each


def smoothed(samples: DataFrame, rules: Rules = Rules(), parts: int | None = None, short: int = 1 << 17) -> DataFrame:
    """(kit, sensor, g, t, y, steady): the series on the grid, low-passed without delay, null out of reach; steady where its slope is small.

    Series of kits with up to ``short`` times and grid points are dealt whole, one shuffle for all steps; longer ones are laid
    out in segments.
    """
    shared_dir(samples.sparkSession)
    kits = grids(samples, rules).checkpoint()  # a row a kit
    few = (F.col("m") <= short) & (F.col("longest") <= short)
    points, order = _points(samples), [*SENSOR, "t"]
    dealt = points.join(kits.where(few), "kit").repartition(parts or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SENSOR).sortWithinPartitions(*order)
    d = gridded(dealt.withColumn("after", F.lead(F.struct("t", "p")).over(Window.partitionBy(*SENSOR).orderBy("t"))), rules)
    whole = d.mapInPandas(filters.whole_series("g", _still(rules)), StructType([*[x for x in d.schema.fields if x.name != "near"], StructField("steady", BooleanType())]))
    if kits.where(~few).isEmpty():
        return whole
    laid = segments.fold(segments.segmented(points.join(kits.where(~few), "kit"), SENSOR, ["t"], parts), SENSOR, after=segments.lead(F.struct("t", "p")))
    d = inpainted(gridded(laid, rules), SENSOR, "g", "y", parts)
    d = filters.zero_phase(d, SENSOR, "g", "y", rules.cutoff, rules.rate, "y", DEGREE, parts).withColumn("y", F.when(F.col("near"), F.col("y")))
    d = segments.fold(segments.segmented(d, SENSOR, ["g"], parts), SENSOR, before=segments.lag(F.col("y")))
    slope = F.when(F.col("g") == 0, F.lit(0.0)).otherwise((F.col("y") - F.col("before")) * rules.rate)
    return whole.unionByName(d.select(*SENSOR, "g", "t", "y", (F.col("near") & F.coalesce(F.abs(slope) < rules.slope, F.lit(False))).alias("steady")))


def windows(smooth: DataFrame, rules: Rules = Rules(), parts: int | None = None) -> DataFrame:
    """(kit, first, last): the grid points of each kit's steady stretch; kits without one are left out.

    Of the stretches above the filling pressure the longest counts, those of at least the shortest length before all others;
    the first of equals. One that is too long is cut to its part around the highest pressure.
    """
    # All sensors of a kit are on its grid, so an instant's rows are the kit's sensors.
    instants = smooth.groupBy("kit", "g").agg(F.bool_and("steady").alias("steady"), F.max("y").alias("top"))
    d = segments.segmented(instants.where("steady"), ["kit"], ["g"], parts)
    d = segments.fold(d, ["kit"], before=segments.lag(F.col("g")))
    d = segments.fold(d, ["kit"], block=segments.running_sum(F.when(F.col("before") == F.col("g") - 1, 0).otherwise(1)))
    peak = F.max_by("g", F.struct("top", -F.col("g")))
    blocks = d.groupBy("kit", "block").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.max("top").alias("top"), peak.alias("peak")).where(F.col("top") > rules.full)
    rank = F.struct((F.col("b") - F.col("a")) / rules.rate >= rules.shortest, F.col("b") - F.col("a"), -F.col("a"))
    best = blocks.groupBy("kit").agg(F.max_by(F.struct("a", "b", "peak"), rank).alias("w")).select("kit", "w.*")
    most = round(rules.longest * 60 * rules.rate)
    cut = F.col("b") - F.col("a") + 1 > most
    start = F.greatest(F.col("peak") - most // 2, F.col("a"))
    return best.select("kit", F.when(cut, start).otherwise(F.col("a")).alias("first"), F.when(cut, F.least(start + most - 1, F.col("b"))).otherwise(F.col("b")).alias("last"))


def identify(samples: DataFrame, rules: Rules = Rules(), parts: int | None = None) -> DataFrame:
    """(kit, sensor, mid, guess, role, start, end) of every sensor: its median in the kit's steady window, the role by thresholds, and the
    role after repair to one pipe sensor and as many cylinders as load sensors; null where a kit has no window.

    A window holds at most ``longest`` minutes of the grid, so its medians are exact at a bounded size.
    """
    smooth = smoothed(samples, rules, parts).checkpoint()
    w = windows(smooth, rules, parts)
    met = smooth.join(w, "kit").where(F.col("g").between(F.col("first"), F.col("last")))
    mids = met.groupBy(*SENSOR).agg(F.median("y").alias("mid"))
    span = met.groupBy("kit").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    named = roles(mids, "kit", "sensor", "mid", rules.full, rules.empty).join(span, "kit")
    return samples.select(*SENSOR).distinct().join(named, SENSOR, "left").select(*SENSOR, "mid", "guess", "role", "start", "end")
