"""Operators on ordered series: each partitions by a series key and orders by time and a tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airlattice.functions.columns import haversine, seconds  # noqa: F401  callers take them from here, too
from airlattice.session import shared_dir

from . import segments


def by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def moving_average(df: DataFrame, key: str, order: list[str], x: str, width: int, name: str, size: int = 1 << 20) -> DataFrame:
    """Adds the causal mean of the last ``width`` rows, of fewer while the series is younger."""
    d, run = segments.framed(df, [key], order, width - 1, size=size)
    return d.withColumn(name, F.avg(x).over(run.rowsBetween(-(width - 1), 0))).where("_own").drop("i", "n", "_chunk", "_own")


def with_lag(df: DataFrame, key: str, order: list[str], **columns: Column) -> DataFrame:
    """Adds the named columns' values of the row before."""
    d = segments.segmented(df, [key], order)
    return segments.fold(d, [key], **{c: segments.lag(x) for c, x in columns.items()}).drop("_at", "_segment")


def gradient(x: str, over: WindowSpec, rate: float) -> Column:
    """Change a second at a nominal rate; 0 on the first row. For series that fit in a task, such as a phase's."""
    return F.coalesce((F.col(x) - F.lag(x).over(over)) * rate, F.lit(0.0))


def quarter_band(x: str, over: WindowSpec) -> Column:
    """First-order Butterworth low-pass at a quarter of the rate, from a zero state: its feedback vanishes."""
    return (F.col(x) + F.coalesce(F.lag(x).over(over), F.lit(0.0))) / 2


def first_per_time(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Of rows of one series with equal time the first by ``order``."""
    nth = F.row_number().over(Window.partitionBy(key, time).orderBy(order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def islands(df: DataFrame, key: str, order: list[str], state: Column, parts: int | None = None) -> DataFrame:
    """Adds island: the number of the run of equal ``state`` that a row is in."""
    d = segments.segmented(df.withColumn("_state", state), [key], order, parts)
    d = segments.fold(d, [key], _before=segments.lag(F.struct("_state")))
    change = F.when(F.col("_before").isNotNull() & F.col("_before._state").eqNullSafe(F.col("_state")), 0).otherwise(1)
    d = segments.fold(d, [key], island=segments.running_sum(change))
    return d.drop("_before", "_state", "_at", "_segment")


def gaps(df: DataFrame, key: str, time: str, order: list[str], limit: float) -> DataFrame:
    """Per series: rows, gaps longer than ``limit`` seconds, longest and mean gap, share of such gaps in percent, nominal frequency."""
    d = with_lag(df, key, order, _last=seconds(time)).withColumn("_dt", seconds(time) - F.col("_last"))
    over = F.col("_dt") > limit
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(over, 1).otherwise(0)).alias("n_gaps"),
        F.max("_dt").alias("max_gap"),
        F.avg("_dt").alias("mean_gap"),
        F.try_divide(100.0 * F.sum(F.when(over, 1).otherwise(0)), F.count("_dt")).alias("gap_pct"),
        F.try_divide(F.lit(1.0), F.median(F.when(F.col("_dt") > 0, F.col("_dt")))).alias("frequency"),
    )


def trapezoid(df: DataFrame, key: str, x: str, time: str, order: list[str]) -> DataFrame:
    """Per series: integral over time (energy), duration and their ratio (power)."""
    d = with_lag(df, key, order, _last=seconds(time), _x=F.col(x)).withColumn("_dt", seconds(time) - F.col("_last")).withColumn("_mid", (F.col(x) + F.col("_x")) / 2)
    out = d.groupBy(key).agg(F.sum(F.col("_mid") * F.col("_dt")).alias("energy"), F.sum("_dt").alias("duration"))
    return out.withColumn("power", F.try_divide("energy", "duration"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, at: str, value: str, tie: str, parts: int | None = None) -> DataFrame:
    """As-of join: the right row nearest in time to each left row, the earlier on a tie.

    Both sides meet in one sort by series and time, right rows before left ones of the same time; the neighbours before and
    after are carried along the segments, so neither side is expanded and no series is one task's. Left needs unique ``tie``
    values.
    """
    l = left.select(F.col(key), F.col(time).alias("_t"), F.col(tie).alias("_tie"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    r = right.select(F.col(key), F.col(at).alias("_t"), F.lit(None).cast(left.schema[tie].dataType).alias("_tie"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    point = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("_at"), "_v"))
    both = segments.segmented(l.unionByName(r), [key], ["_t", "_side"], parts)
    met = segments.fold(both, [key], _b=segments.last(point), _a=segments.next_(point)).where("_side = 1")
    back, ahead = seconds("_t") - seconds("_b._at"), seconds("_a._at") - seconds("_t")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    return met.select(key, F.col("_tie").alias(tie), pick["_at"].alias("at"), pick["_v"].alias("value"))


def resample(df: DataFrame, key: str, x: str, time: str, step: int, parts: int | None = None) -> DataFrame:
    """Linear interpolation on a grid of ``step`` seconds within each series' range; equal times keep their least value.

    Each point makes the grid points from itself up to the next one, which is carried along the segments: no series is laid
    out whole.
    """
    points = df.groupBy(key, seconds(time).alias("_s")).agg(F.min(x).alias("_x"))
    d = segments.segmented(points, [key], ["_s"], parts)
    d = segments.fold(d, [key], _next=segments.lead(F.struct("_s", "_x")))
    first, over = F.ceil(F.col("_s") / step), F.ceil(F.coalesce(F.col("_next._s"), F.col("_s")) / step)
    # The last point of a series has a grid point only if it lies on it.
    upto = F.when(F.col("_next").isNull(), F.floor(F.col("_s") / step)).otherwise(over - 1)
    d = d.where(first <= upto).withColumn("g", F.explode(F.sequence(first, upto)))
    part = F.try_divide(F.col("g") * step - F.col("_s"), F.col("_next._s") - F.col("_s"))
    lerp = F.coalesce(F.col("_x") + (F.col("_next._x") - F.col("_x")) * part, F.col("_x"))
    return d.select(key, (F.col("g") * step).cast("long").alias("grid"), lerp.alias("value"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: int = 0, parts: int | None = None) -> DataFrame:
    """Unions of intervals that overlap, touch or lie within ``gap`` (in the unit of the ends): (key, start, end, n)."""
    d = segments.segmented(df, [key], [start, end], parts)
    d = segments.fold(d, [key], _reach=segments.peak_before(F.col(end)))
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0)
    d = segments.fold(d, [key], _island=segments.running_sum(new))
    return d.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def greedy_intervals(df: DataFrame, key: str, start: str, end: str, id_: str, parts: int | None = None) -> DataFrame:
    """Of each key's intervals as many as don't overlap: always the next one to end (then of least id) that starts no sooner than the last has ended.

    Each interval points to the one that would follow it, found along the segments as the least end ahead; the choice is the
    chain from the first, and by doubling the pointers a chain of any length is walked in the logarithm of it. Intervals of
    no length, or with a null, are left out. Ids are unique within a key.
    """
    shared_dir(df.sparkSession)
    i = df.where(F.col(start) < F.col(end)).select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(id_).alias("_id"))
    offered = i.select("_k", F.col("_s").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(df.schema[id_].dataType).alias("_own"), F.struct("_e", "_id").alias("_c"))
    asked = i.select("_k", F.col("_e").alias("_t"), F.lit(0).alias("_side"), F.col("_id").alias("_own"), F.lit(None).cast(offered.schema["_c"].dataType).alias("_c"))
    d = segments.fold(segments.segmented(offered.unionByName(asked), ["_k"], ["_t", "_side"], parts), ["_k"], _next=segments.floor_ahead(F.col("_c")))
    jump = d.where("_side = 0 AND _next IS NOT NULL").select("_k", F.col("_own").alias("_id"), F.col("_next._id").alias("_to")).checkpoint()
    chain = i.groupBy("_k").agg(F.min(F.struct("_e", "_id")).alias("c")).select("_k", "c._id").checkpoint()
    same = F.col("a._k").eqNullSafe(F.col("b._k"))
    while not jump.isEmpty():
        # Pointers of the chain double its length; then each pointer takes two steps at once.
        ahead = chain.alias("a").join(jump.alias("b"), same & (F.col("a._id") == F.col("b._id"))).select("a._k", F.col("b._to").alias("_id"))
        chain = chain.unionByName(ahead).checkpoint()
        jump = jump.alias("a").join(jump.alias("b"), same & (F.col("a._to") == F.col("b._id"))).select("a._k", "a._id", "b._to").checkpoint()
    met = df.alias("d").join(chain.alias("c"), F.col(f"d.{key}").eqNullSafe(F.col("c._k")) & (F.col(f"d.{id_}") == F.col("c._id")), "left_semi")
    return met.select(*[F.col(f"d.`{c}`") for c in df.columns])


def roles(medians: DataFrame, kit: str, sensor: str, mid: str, pipe: float = 4.6, cylinder: float = 0.2) -> DataFrame:
    """Adds guess and role to a table of sensors with the median pressure of their steady time.

    The guess is by threshold; the repair gives each kit one pipe sensor (the highest) and takes half of the rest, the lowest
    first, for cylinders. Ties go by sensor. Windows run over the sensors of a kit.
    """
    n = Window.partitionBy(kit)
    top = F.row_number().over(n.orderBy(F.desc(mid), sensor))
    d = medians.withColumn("guess", F.when(F.col(mid) > pipe, "MBP").when(F.col(mid) < cylinder, "BC").otherwise("WV")).withColumn("_top", top).withColumn("_n", F.count(F.lit(1)).over(n))
    low = F.row_number().over(n.orderBy((F.col("_top") == 1).cast("int"), mid, sensor))
    role = F.when(F.col("_top") == 1, "MBP").when(F.col("_low") <= F.floor((F.col("_n") - 1) / 2), "BC").otherwise("WV")
    return d.withColumn("_low", low).withColumn("role", role).drop("_top", "_n", "_low")
