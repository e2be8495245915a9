"""Density clustering in few dimensions, by grid cells instead of pairs.

Cells are so small that all points of one cell are neighbours. A cell of at least ``least`` points therefore holds core
points only, without a comparison; points of sparser cells, which are fewer than ``least`` a cell, are compared with
the points of the cells around them. Core points of one cell are one cluster, so clusters are components of cells: two
cells are linked if two core points of theirs are neighbours. That is settled on finer cells first, of which a cell
has a bounded number: some pair of them is near whatever the points, or all are apart. Only where neither holds are
points compared, and then only those of the finer cells in doubt, in blocks.

A cell may hold any share of the points: what meets its points is salted by its size.
"""

from __future__ import annotations

from itertools import product
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.session import shared_dir, ship

from .graph import components
from .joins import spread_join

#: Finer cells along a side of a cell, and points of a cell that a task compares at a time.
FINE, BLOCK = 8, 4096


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold a neighbour, for cells whose diagonal is the radius."""
    far = int(sqrt(dims)) + 1
    return [o for o in product(range(-far, far + 1), repeat=dims) if sum(max(abs(k) - 1, 0) ** 2 for k in o) < dims + 1e-9]


def _decide(eps: float, side: float):
    """Of cell pairs with their finer cells: near where any points of two finer cells are neighbours, else the finer cells in doubt."""
    fine = side / FINE

    def run(batches):
        for batch in batches:
            near, left, right = [], [], []
            for step, a, b in zip(batch.column("step").to_pylist(), batch.column("fines").to_pylist(), batch.column("others").to_pylist(), strict=True):
                apart = np.abs(np.array(b)[None, :, :] + np.array(step) * FINE - np.array(a)[:, None, :])
                most = (((apart + 1) * fine) ** 2).sum(axis=2)
                least = ((np.maximum(apart - 1, 0) * fine) ** 2).sum(axis=2)
                sure = bool((most <= eps * eps * (1 - 1e-9)).any())
                doubt = np.zeros((0, 2), int) if sure else np.argwhere(least <= eps * eps * (1 + 1e-9))
                near.append(sure)
                left.append([a[i] for i in np.unique(doubt[:, 0])])
                right.append([b[i] for i in np.unique(doubt[:, 1])])
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_()), pa.array(left, kind), pa.array(right, kind)], ["a", "b", "near", "left", "right"])

    return run


def _meets(eps: float):
    """Whether two blocks of points hold a pair of neighbours."""

    def run(group: pa.Table) -> pa.Table:
        first = np.array(group["first"])
        x = np.array(group["x"].to_pylist(), float)
        a, b = x[first], x[~first]
        met = len(a) and len(b) and any((((b - p) ** 2).sum(axis=1) <= eps * eps).any() for p in a)
        return pa.table({"a": group["a"][:1], "b": group["b"][:1]}) if met else pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})

    return run


def dbscan(points: DataFrame, eps: float, least: int, dims: int, block: int = BLOCK) -> DataFrame:
    """(id, cluster, core) of points (id, x: array of ``dims`` numbers).

    A core point has at least ``least`` points within ``eps``, itself included. Its cluster is the least id of the core points that it
    reaches by steps of at most eps between core points; a point within eps of a core point takes the least cluster of
    those; others have none. Points that are null, of another length or not finite have none either.
    """
    spark = points.sparkSession
    ship(spark)
    shared_dir(spark)
    side = eps / sqrt(dims) * (1 - 1e-9)
    whole = F.col("x").isNotNull() & (F.size("x") == dims) & F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    at = F.transform("x", lambda c: F.floor(c / side))
    name = lambda cell: F.array_join(cell, ",")
    p = points.where(whole).select("id", F.col("x").cast("array<double>").alias("x")).withColumn("at", at).withColumn("cell", name(F.col("at"))).checkpoint()
    sizes = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    p = spread_join(p, sizes, ["cell"], "n", p.count())
    steps = [F.array(*[F.lit(k).cast("long") for k in o]) for o in _offsets(dims)]
    around = F.array(*[name(F.zip_with("at", s, lambda u, v: u + v)) for s in steps])

    # Points of sparse cells meet all points around them.
    asked = p.where(F.col("n") < least).select(F.col("id").alias("own"), F.col("x").alias("own_x"), F.explode(around).alias("cell"))
    ways = F.ceil(F.col("n") / block).cast("int")
    salted = asked.join(sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("n")
    apart = lambda u, v: F.aggregate(F.zip_with(u, v, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t)
    near = p.withColumn("salt", F.pmod(F.xxhash64("id"), ways).cast("int")).join(salted, ["cell", "salt"]).where(apart("own_x", "x") <= eps * eps)
    near = near.select("own", F.col("id").alias("other"), "cell").checkpoint()
    counts = near.groupBy(F.col("own").alias("id")).agg(F.count(F.lit(1)).alias("within"))
    core = p.where(F.col("n") >= least).unionByName(p.where(F.col("n") < least).join(counts.where(F.col("within") >= least), "id").select(*p.columns)).checkpoint()

    # Cells, by their finer cells, and the pairs of cells that may be linked.
    fines = F.zip_with("x", "at", lambda c, a: F.least(F.floor((c - a * side) / (side / FINE)), F.lit(FINE - 1)).cast("long"))
    core = core.withColumn("fine", fines)
    cells = core.groupBy("cell").agg(F.first("at").alias("at"), F.collect_set("fine").alias("fines")).checkpoint()
    zero = (0,) * dims
    ahead = F.array(*[F.struct(s.alias("step"), name(F.zip_with("at", s, lambda u, v: u + v)).alias("b")) for o, s in zip(_offsets(dims), steps, strict=True) if o > zero])
    pairs = cells.select(F.col("cell").alias("a"), "fines", F.explode(ahead).alias("o")).select("a", "fines", "o.*").join(cells.select(F.col("cell").alias("b"), F.col("fines").alias("others")), "b")
    kind = "array<array<bigint>>"
    decided = pairs.select("a", "b", "step", "fines", "others").mapInArrow(_decide(eps, side), f"a string, b string, near boolean, left {kind}, right {kind}").checkpoint()
    doubt = decided.where(~F.col("near") & (F.size("left") > 0))
    sides = doubt.select("a", "b", F.col("a").alias("cell"), F.explode("left").alias("fine"), F.lit(True).alias("first")).unionByName(doubt.select("a", "b", F.col("b").alias("cell"), F.explode("right").alias("fine"), F.lit(False).alias("first")))
    big = sizes.withColumn("ways", ways).drop("n")
    size_a, size_b = big.select(F.col("cell").alias("a"), F.col("ways").alias("ways_a")), big.select(F.col("cell").alias("b"), F.col("ways").alias("ways_b"))
    met = core.select("id", "x", "cell", "fine").join(sides, ["cell", "fine"]).join(size_a, "a").join(size_b, "b")
    mine, theirs = (F.when(F.col("first"), F.col(f"ways_{c}")).otherwise(F.col(f"ways_{d}")) for c, d in ("ab", "ba"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
    met = met.select("a", "b", F.when(F.col("first"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("first"), F.col("other")).otherwise(F.col("own")).alias("j"), "first", "x")
    settled = met.groupBy("a", "b", "i", "j").applyInArrow(_meets(eps), "a string, b string")
    links = decided.where("near").select("a", "b").unionByName(settled).distinct()

    labels = components(links).withColumnsRenamed({"node": "cell"})
    own = cells.select("cell").join(labels, "cell", "left").select("cell", F.coalesce("label", "cell").alias("label"))
    least_of = core.groupBy("cell").agg(F.min("id").alias("least")).join(own, "cell")
    named = least_of.join(least_of.groupBy("label").agg(F.min("least").alias("cluster")), "label").select("cell", "cluster").checkpoint()
    inner = spread_join(core.select("id", "cell"), named.join(sizes, "cell"), ["cell"], "n", core.count()).select("id", "cluster", F.lit(True).alias("core"))
    edge = near.join(core.select(F.col("id").alias("other")), "other", "left_semi").join(named, "cell").groupBy(F.col("own").alias("id")).agg(F.min("cluster").alias("cluster"))
    edge = edge.join(inner.select("id"), "id", "left_anti").withColumn("core", F.lit(False))
    found = inner.unionByName(edge)
    return points.select("id").join(found, "id", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
