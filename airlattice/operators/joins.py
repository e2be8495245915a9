"""Joins that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, key: str | None = None) -> DataFrame:
    """Points within closed intervals, on whole numbers (such as epoch seconds).

    Intervals are spread over the buckets of ``width`` that they touch and points fall in one, so the join is an
    equi-join on (key, bucket) that shuffles as any other. Choose ``width`` near the usual length of an interval.
    """
    buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    wide = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(buckets))
    near = points.withColumn("_bucket", F.floor(F.col(at) / width))
    on = ["_bucket", key] if key else ["_bucket"]
    return near.join(wide, on).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def rank_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], key: str) -> DataFrame:
    """Pairs the k-th row of each side within a key."""
    l = left.withColumn("pair", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    r = right.withColumn("pair", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return l.join(r, [key, "pair"])


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two tables by key: left_only, right_only or both."""
    l = left.select(F.col(key), F.lit(True).alias("_l")).dropDuplicates([key])
    r = right.select(F.col(key), F.lit(True).alias("_r")).dropDuplicates([key])
    where = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")
    return l.join(r, key, "full").select(key, where.alias("presence"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], prefer_new: bool = True) -> DataFrame:
    """Merge by composite key (null-safe): one row a key, of the preferred side and first by ``order`` within it."""
    both = old.withColumn("_rank", F.lit(1 if prefer_new else 0)).unionByName(new.withColumn("_rank", F.lit(0 if prefer_new else 1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", *order))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_rank")


def union_common(parts: list[DataFrame], origin: str) -> DataFrame:
    """Union on the columns that all parts have, in the order of the first, with the number of the part."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts[1:])]
    out = None
    for i, p in enumerate(parts):
        own = p.select(*common, F.lit(i).alias(origin))
        out = own if out is None else out.unionByName(own)
    return out


def differences(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Of the keys that both tables have: how many, how many whose values differ beyond the tolerance, and the greatest difference."""
    d = left.withColumnRenamed(value, "_x").join(right.withColumnRenamed(value, "_y"), keys).withColumn("_d", F.abs(F.col("_x") - F.col("_y")))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_d") > tolerance).cast("int")).alias("n_beyond"), F.max("_d").alias("most"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, block: int = 256, part_rows: int = 20_000) -> DataFrame:
    """The k nearest vectors of each query vector by squared Euclidean distance, itself excluded: (query_id, id, distance, nth).

    A stated set of queries meets all vectors in blocks: the queries are split into blocks of about ``block`` rows and the
    vectors into parts of about ``part_rows``; each task computes one block against one part, keeping k of each query.
    """
    import heapq

    import numpy as np
    import pyarrow as pa

    n = max(1, -(-queries.count() // block))
    spread = max(1, -(-vectors.count() // part_rows))
    q = queries.select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_), F.lit(n)).alias("b"), F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"), F.lit(False).alias("is_query"), F.pmod(F.xxhash64(id_), F.lit(spread)).cast("int").alias("part"))

    def run(group: pa.Table) -> pa.Table:
        ask = np.array(group["is_query"])
        ids = group["id"].to_numpy()
        v = group["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
        a, b = x[ask], x[~ask]
        out: list[tuple] = []
        if len(a) and len(b):
            d = (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)
            for i, own in enumerate(ids[ask]):
                near = [(float(((a[i] - b[j]) ** 2).sum()), int(ids[~ask][j])) for j in np.argsort(d[i], kind="stable")[: k + 1]]
                out += [(int(own), y, s) for s, y in heapq.nsmallest(k, [z for z in near if z[1] != own])]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    found = q.unionByName(v).groupBy("b", "part").applyInArrow(run, "query_id long, id long, distance double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def spread_join(rows: DataFrame, marks: DataFrame, keys: list[str], weight: str, total: int, share: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with ``marks``, one row a key (nulls equal), where a few keys may hold most rows.

    ``weight`` is the number of rows of a key and ``total`` that of all rows. Keys that hold a ``share``-th of all rows or
    more, of which there are at most ``share``, are broadcast and leave their rows where they are; rows of other keys
    meet theirs by shuffle, none of them more than total / share in one place.
    """
    names = [f"_m{j}" for j in range(len(keys))]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    marks = marks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in marks.columns if c not in keys])
    heavy = F.col(weight) * share >= max(total, 1)
    hot = F.broadcast(marks.where(heavy))
    apart = rows.join(hot.select(*names), same, "left_anti").join(marks.where(~heavy), same)
    return rows.join(hot, same).unionByName(apart).drop(*names)


def keyed_join(rows: DataFrame, marks: DataFrame, keys: list[str], weight: str, few: bool, total: int) -> DataFrame:
    """``spread_join``, but with all marks broadcast where they are ``few``: then rows stay where they are, whatever share of them a key holds."""
    if not few:
        return spread_join(rows, marks, keys, weight, total)
    names = [f"_m{j}" for j in range(len(keys))]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    marks = marks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in marks.columns if c not in keys])
    return rows.join(F.broadcast(marks), same).drop(*names)
