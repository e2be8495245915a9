"""Ordered series of any size: range-partitioned segments, small states carried from one to the next.

``segmented`` lays rows out by (key, order) over partitions of about equal size, so a key that holds a third of all
rows, or all of them, takes as many tasks as it needs. A partition is a segment; a key that goes on in the next one
hands over a state: a sum, a last value, the row before. Only the first key of a segment takes one over, so the
states number no more than twice the segments; they are scanned in the order of segments and broadcast back. Rows
then need windows within (key, segment) only.

Keys are compared with nulls equal. Rows that tie in the order are handed over in the order they were laid out in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airlattice.session import shared_dir

#: Bits of a row's place within its partition, in ``monotonically_increasing_id``.
PLACE_BITS = 33


def segmented(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted by keys and order over ``parts`` segments (by default as many as shuffles have partitions), with _at
    (grows with the order) and _segment. It is written to the shared folder, so that both hold for every reader."""
    spark = df.sparkSession
    shared_dir(spark)
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return out.withColumn("_segment", F.shiftright("_at", PLACE_BITS).cast("int")).checkpoint()


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """Adds i (gapless from 0 within the keys, in the order) and n (rows of the keys); columns of these names are replaced."""
    d = segmented(df, keys, order, parts)
    per = d.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    run = Window.partitionBy(*keys).orderBy("_segment")
    per = per.withColumn("n", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_shift", F.sum("_n").over(run) - F.col("_n") - F.col("_first"))
    per = per.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_segment").alias("_s"), "n", "_shift")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_segment") == F.col("_s"))
    return d.join(per, same).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_segment", "_s", "_shift", *[f"_k{j}" for j in range(len(keys))])


@dataclass(frozen=True)
class Fold:
    """How a column of an ordered series comes from the rows so far: ``kind`` is sum, last, next, lag, lead, peak or floor."""

    kind: str
    of: Column


def running_sum(of: Column) -> Fold:
    """Sum of all rows of the key up to this one; nulls count as nothing."""
    return Fold("sum", of)


def last(of: Column) -> Fold:
    """The newest value that isn't null, of this row or an earlier one."""
    return Fold("last", of)


def next_(of: Column) -> Fold:
    """The nearest value that isn't null, of this row or a later one."""
    return Fold("next", of)


def lag(of: Column) -> Fold:
    """The value of the row before, null or not; null on a key's first row."""
    return Fold("lag", of)


def lead(of: Column) -> Fold:
    """The value of the row after, null or not; null on a key's last row."""
    return Fold("lead", of)


def peak_before(of: Column) -> Fold:
    """The greatest value of all rows before this one; null on a key's first row."""
    return Fold("peak", of)


def floor_ahead(of: Column) -> Fold:
    """The least value of this row and all later ones; nulls don't count."""
    return Fold("floor", of)


def _state(f: Fold, x: Column) -> Column:
    """What a segment knows of a fold."""
    known = F.when(x.isNotNull(), F.col("_at"))
    return {"sum": lambda: F.sum(x), "peak": lambda: F.max(x), "floor": lambda: F.min(x), "last": lambda: F.max_by(x, known), "next": lambda: F.min_by(x, known), "lag": lambda: F.max_by(F.struct(x.alias("v")), F.col("_at")), "lead": lambda: F.min_by(F.struct(x.alias("v")), F.col("_at"))}[f.kind]()


def _scan(f: Fold, state: str, run: WindowSpec) -> Column:
    """What a segment takes over, from the states of the others of its key."""
    before, after = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(1, Window.unboundedFollowing)
    return {"sum": lambda: F.sum(state).over(before), "peak": lambda: F.max(state).over(before), "floor": lambda: F.min(state).over(after), "last": lambda: F.last(state, ignorenulls=True).over(before), "next": lambda: F.first(state, ignorenulls=True).over(after), "lag": lambda: F.lag(state).over(run), "lead": lambda: F.lead(state).over(run)}[f.kind]()


def _apply(f: Fold, x: Column, carried: Column, keys: list[str]) -> Column:
    """A row's value, from its own segment and what that took over."""
    run = within(keys)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    # A frame up to the last row would be gone through anew for every row; from the end it grows row by row.
    ahead = Window.partitionBy(*keys, "_segment").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    if f.kind == "sum":
        own = F.sum(x).over(so_far)
        return F.coalesce(own + carried, own, carried)
    if f.kind == "peak":
        return F.greatest(F.max(x).over(run.rowsBetween(Window.unboundedPreceding, -1)), carried)
    if f.kind == "floor":
        return F.least(F.min(x).over(ahead), carried)
    if f.kind in ("last", "next"):
        return F.coalesce(F.last(x, ignorenulls=True).over(so_far if f.kind == "last" else ahead), carried)
    point = F.struct(x.alias("v"))
    return F.coalesce(F.lag(point).over(run) if f.kind == "lag" else F.lead(point).over(run), carried)["v"]


def within(keys: list[str]) -> WindowSpec:
    """The rows of one key in one segment, in order."""
    return Window.partitionBy(*keys, "_segment").orderBy("_at")


def fold(d: DataFrame, keys: list[str], **columns: Fold) -> DataFrame:
    """Adds the named columns to rows that ``segmented`` laid out by ``keys``.

    The states of the keys that go on in another segment come from one aggregation; keys that stay within one have none.
    """
    own = d.columns
    d = d.select("*", *[f.of.alias(f"_of_{c}") for c, f in columns.items()])
    names = [f"_key{j}" for j in range(len(keys))]
    alike = lambda n: [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, n, strict=True)]
    # Only the keys that go on in another segment have states to hand over.
    spread = d.groupBy(*keys).agg(F.min("_segment").alias("_a"), F.max("_segment").alias("_b")).where("_a < _b").select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    held = d.join(F.broadcast(spread), alike(names), "left_semi").groupBy(*keys, "_segment").agg(*[_state(f, F.col(f"_of_{c}")).alias(f"_to_{c}") for c, f in columns.items()])
    run = Window.partitionBy(*keys).orderBy("_segment")
    held = held.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_segment").alias("_to"), *[_scan(f, f"_to_{c}", run).alias(f"_in_{c}") for c, f in columns.items()])
    same = [*alike(names), F.col("_segment") == F.col("_to")]
    # At most two keys of a segment go on in another one: no more rows than twice the segments.
    met = d.join(F.broadcast(held), same, "left")
    return met.select(*[F.col(f"`{c}`") for c in own if c not in columns], *[_apply(f, F.col(f"_of_{c}"), F.col(f"_in_{c}"), keys).alias(c) for c, f in columns.items()])


def framed(df: DataFrame, keys: list[str], order: list[str | Column], before: int, after: int = 0, size: int = 1 << 20, parts: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows for frames of at most ``before`` rows back and ``after`` rows ahead, and the window to use; then keep rows where _own.

    Series are cut into chunks of ``size`` rows; rows near an edge also go to the chunk beside theirs, as neighbours only.
    """
    if before > size or after > size:
        raise ValueError("a frame may not be longer than a chunk")
    d = numbered(df, keys, order, parts)
    mine, at = F.floor(F.col("i") / size), F.col("i") % size
    both = F.array_compact(F.array(mine, F.when(at >= size - before, mine + 1), F.when((at < after) & (mine > 0), mine - 1)))
    d = d.withColumn("_chunk", F.explode(both)).withColumn("_own", F.col("_chunk") == F.floor(F.col("i") / size))
    return d, Window.partitionBy(*keys, "_chunk").orderBy("i")
