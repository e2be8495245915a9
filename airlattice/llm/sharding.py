"""Sharding by sampled splitters: near-equal bytes in every shard, equal texts side by side.

A record's key is a 63-bit position: the checksum of its text, then a hash of its ``doc_id``. So equal texts lie
side by side, and a group of copies of any size can still be cut. A sample of keys, each drawn with odds in
proportion to its size, gives quantile boundaries of many more ranges than shards. Exact sizes of the ranges
follow; an overfull range is cut again with splitters drawn inside it. Records then go to their range, where
running sums, added to the exact size of all ranges before, give each record its place in the whole order; the
place decides shard and slot. No range meets another, and the driver holds numbers of ranges only.

Ties: records of equal position are ordered by hash of text and by ``doc_id``; repeated rows are alike, so
their order shows in nothing but their slots. Nulls: a null text has size 1, as an empty one. A range that holds
one position only can't be cut. An empty table gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.session import shared_dir

from .words import text_of

#: Bytes of a range, least and most ranges, and sampled keys a range: the sample is MOST_RANGES * PER_RANGE longs at most.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES, PER_RANGE = 64 << 20, 64, 4096, 32
#: A range of so many times the mean is overfull. It is cut again until it isn't, or until no new splitter falls into it.
OVERFULL = 1.5
LAW = "bytes"


def with_position(docs: DataFrame) -> DataFrame:
    """Adds size, text_crc32, _position and _hash; what follows needs no text."""
    text = text_of("text")
    df = docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text)).withColumn("_hash", F.xxhash64(text))
    low = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 33)
    return df.withColumn("_position", F.shiftleft("text_crc32", 31).bitwiseOR(low))


def draw(keys: DataFrame, per_byte: float) -> list[int]:
    """Positions drawn with odds size * per_byte, by hash, so that reruns agree."""
    u = F.shiftrightunsigned(F.xxhash64("_position", F.lit("draw")), 11) / float(1 << 53)
    return sorted(r[0] for r in keys.where(u < F.col("size") * per_byte).select("_position").collect())


def range_of(splitters: list[int]):
    edges = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, position.to_numpy(), side="right").astype(np.int32))

    return of


def measure(keys: DataFrame, splitters: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, least and greatest position by range."""
    by = keys.groupBy(range_of(splitters)("_position").alias("r")).agg(F.sum("size"), F.count(F.lit(1)), F.min("_position"), F.max("_position"))
    return {r[0]: tuple(r)[1:] for r in by.collect()}  # MOST_RANGES rows and those of a few rounds of cutting


def splitters(keys: DataFrame, total: int) -> tuple[list[int], dict]:
    n = min(max(LEAST_RANGES, -(-total // RANGE_BYTES)), MOST_RANGES)
    sample = draw(keys, n * PER_RANGE / max(total, 1))
    edges = sorted({sample[i] for i in range(PER_RANGE, len(sample), PER_RANGE)})
    sizes = measure(keys, edges)
    while True:
        full = [r for r, (b, _, lo, hi) in sizes.items() if b > OVERFULL * total / n and hi > lo]
        # About 8 splitters for each mean size within the overfull ranges, all drawn in one pass.
        more = sorted({*edges, *draw(keys.where(range_of(edges)("_position").isin(full)), 8 * n / total)}) if full else edges
        if more == edges:
            break
        edges = more
        sizes = measure(keys, edges)
    return edges, sizes


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    shared_dir(spark)
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    placed = with_position(docs.select(*[F.col(f"`{c}`") for c in own]))
    keys = placed.select("_position", "size").checkpoint()
    total = keys.agg(F.sum("size")).first()[0] or 0
    edges, sizes = splitters(keys, total)
    starts, b, n = [], 0, 0
    for r in sorted(sizes):
        starts.append((r, b, n))
        b, n = b + sizes[r][0], n + sizes[r][1]
    start = F.broadcast(spark.createDataFrame(starts, "_r int, _bytes long, _rows long"))
    order = Window.partitionBy("_r").orderBy("_position", "_hash", "doc_id")
    out = placed.withColumn("_r", range_of(edges)("_position")).join(start, "_r")
    out = out.withColumn("_before", F.col("_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = out.withColumn("_nth", F.col("_rows") + F.row_number().over(order) - 1)
    # A record belongs to the shard that its middle byte falls into.
    shard = F.least(F.floor((F.col("_before") + F.col("size") / 2) * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")
    out = out.withColumn("shard", shard)
    first = F.broadcast(out.select("shard", "_nth").groupBy(F.col("shard").alias("_shard")).agg(F.min("_nth").alias("_first")))
    out = out.join(first, F.col("shard") == F.col("_shard"))
    return out.select(*[F.col(f"`{c}`") for c in own], "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_nth") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
