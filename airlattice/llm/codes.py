"""Vector code compression: product quantisation by weighted Lloyd over distinct integer parts.

1. A component x becomes floor(``SCALE`` * x); a vector is cut into ``PARTS`` equal consecutive parts.
2. Equal parts of one position are deduplicated into weighted distinct rows, which are written once; a vector that a
   third of the table repeats is one row from here on.
3. Each Lloyd round is one pass over the distinct rows: tasks assign them to the nearest entry (squared Euclidean
   distance in integers, ties to the lower index) and send weighted sums by position and entry, so the driver holds the
   ``PARTS * ENTRIES`` entries only. An entry becomes the floor of its mean; an unused one stays.
4. Codes and errors of the distinct rows are joined back to the vectors' parts. Parts that make up more than a share of
   all are broadcast, at most ``SHARE`` of them; the others meet by shuffle, where no key is hot any more.

Left out: a vector that is null or empty, holds a null or non-finite component, or whose length is no multiple of PARTS or
isn't that of the kept vector of least vec_id (then of least components). Integers saturate at +-``LIMIT``, so that sums
of squares stay exact. Ties: repeated rows are kept and alike; initial entries go by vec_id (null last), then components.
Fewer than ENTRIES vectors give as many entries. A null label is a label. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.operators.joins import spread_join
from airlattice.session import shared_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 27
#: Rows of a batch that are compared with the entries at a time.
SLICE = 8192


def integers(vector: str) -> Column:
    """Components as integers; all floors go down."""
    bound = F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, bound), -bound)).cast("int"))


def whole(vector: str) -> Column:
    """Whether a vector has components, and only finite ones."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, x), F.lit(False))


def kept(vectors: DataFrame) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, label, parts: array of arrays) of the vectors to encode, and the first ones' integers."""
    rows = vectors.where(whole("embedding") & (F.size("embedding") % PARTS == 0)).select("vec_id", "label", integers("embedding").alias("v"))
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).first()
    if least is None:
        return rows.select("vec_id", "label", F.array().cast("array<array<int>>").alias("parts")), []
    rows = rows.where(F.size("v") == len(least["v"]))
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()]  # ENTRIES vectors
    width = len(least["v"]) // PARTS
    parts = F.array(*[F.slice("v", k * width + 1, width) for k in range(PARTS)])
    return rows.select("vec_id", "label", parts.alias("parts")), first


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of ``x``, the lower of equals, and the squared distance."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), SLICE):
        apart = np.stack([((x[at : at + SLICE] - e) ** 2).sum(axis=1) for e in entries], axis=1)
        code[at : at + SLICE] = best = apart.argmin(axis=1)
        error[at : at + SLICE] = apart[np.arange(len(best)), best]
    return code, error


def lloyd(books: np.ndarray):
    """Weighted sums (position, entry, weight, sums) of a task's distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        weights, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            position, weight, x = batch.column("position").to_numpy(), batch.column("weight").to_numpy(), matrix(batch.column("part"), width)
            for p in np.unique(position):
                mine = position == p
                code, _ = nearest(x[mine], books[p])
                heavy = x[mine] * weight[mine][:, None]
                for e in np.unique(code):
                    weights[p, e] += weight[mine][code == e].sum()
                    sums[p, e] += heavy[code == e].sum(axis=0)
        p, e = np.nonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(weights[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["position", "entry", "weight", "sums"])

    return run


def train(distinct: DataFrame, first: list[list[int]], rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component)."""
    width = len(first[0]) // PARTS
    books = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = distinct.mapInArrow(lloyd(books), "position int, entry int, weight long, sums array<long>")
        totals = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        for r in sent.groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *totals).collect():  # PARTS * ENTRIES rows
            books[r["position"], r["entry"]] = np.array(r[3:], np.int64) // r["weight"]
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """The distinct parts with code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, x = batch.column("position").to_numpy(), matrix(batch.column("part"), books.shape[2])
            code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(position):
                mine = position == p
                code[mine], error[mine] = nearest(x[mine], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<int>, weight long, code long, error long")


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks."""
    shared_dir(vectors.sparkSession)
    rows, first = kept(vectors)
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    # Equal rows share a key and come apart again at the end.
    key = F.struct("vec_id", "label", F.xxhash64("parts").alias("x"), F.hash("parts").alias("h"))
    exploded = rows.select(key.alias("row"), F.posexplode("parts").alias("position", "part"))
    distinct = exploded.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")).checkpoint()
    books = train(distinct, first)
    marks = coded(distinct, books).checkpoint()
    total = marks.agg(F.sum("weight")).first()[0]
    met = spread_join(exploded, marks, ["position", "part"], "weight", total)
    digits = [F.max(F.when(F.col("position") == p, F.col("code"))).alias(f"c{p}") for p in range(PARTS)]
    out = met.groupBy("row").agg(*digits, F.sum("error").alias("errors"), (F.count(F.lit(1)) / PARTS).cast("int").alias("copies"))
    code = F.format_string("%02x" * PARTS, *[F.col(f"c{p}") for p in range(PARTS)])
    out = out.select("row.vec_id", "row.label", code.alias("code"), F.expr("errors div copies").alias("error"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies"), books


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    out, books = encode(vectors)
    out = out.checkpoint()
    per = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    met = spread_join(out, per, ["label"], "weight", out.count())
    return met.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


#: A round of Lloyd: nearest entries of the distinct parts, then the floors of their weighted means.
ROUND_SQL = """
a{r} AS MATERIALIZED (SELECT d.pos, d.part, any_value(weight) AS weight, min(list_sum(list_transform(range(1, len(part) + 1), lambda j: (part[j] - entry[j]) * (part[j] - entry[j]))) * 16 + e) AS best
  FROM d JOIN b{r} USING (pos) GROUP BY d.pos, d.part),
"""
MEAN_SQL = """
u{r} AS (SELECT pos, best % 16 AS e, j, CAST(floor(CAST(sum(weight * part[j]) AS DOUBLE) / sum(weight)) AS BIGINT) AS m FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM a{r}) GROUP BY pos, best % 16, j),
m{r} AS (SELECT pos, e, list(m ORDER BY j) AS entry FROM u{r} GROUP BY pos, e),
b{n} AS MATERIALIZED (SELECT b{r}.pos, b{r}.e, coalesce(m{r}.entry, b{r}.entry) AS entry FROM b{r} LEFT JOIN m{r} USING (pos, e)),
"""
#: For vectors of one length.
SQL = (
    """
WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, row, pos, v[pos * (len(v) // 8) + 1 : (pos + 1) * (len(v) // 8)] AS part FROM k, (SELECT unnest(range(8)) AS pos)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS weight FROM p GROUP BY pos, part),
b0 AS MATERIALIZED (SELECT pos, row - 1 AS e, part AS entry FROM p WHERE row <= 16),
"""
    + "".join((ROUND_SQL + MEAN_SQL).format(r=r, n=r + 1) for r in range(ROUNDS))
    + ROUND_SQL.format(r=ROUNDS)
    + """
c AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b6),
v AS (SELECT vec_id, label, row, string_agg('0' || lower(to_hex(best % 16)), '' ORDER BY pos) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM p JOIN a6 USING (pos, part) GROUP BY vec_id, label, row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v, c
"""
)
