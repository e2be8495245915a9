"""N-gram Jaccard join: MinHash banding, verified on full shingle sets, closed to classes.

1. Every document becomes its set of five-word shingles; documents of equal sets are one node.
2. MinHash signatures are cut into bands; band and row counts are chosen so that a pair at the threshold meets in
   some band with probability ``RECALL``. Nodes shuffle on band hashes.
3. A bucket of up to ``ALL_PAIRS`` nodes proposes all its pairs, which are verified as rows of a join. The nodes of larger
buckets are dealt into blocks of at most about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles, so that nodes that hang
together by such buckets share blocks. Each pair of blocks that meets in a large bucket is one group: it has the nodes of
those buckets once, forms all their pairs that meet in a large bucket and in no small one, and verifies them by matrix
products. It gives each node's number of links and a forest of the links, so a group of near copies of any size costs a
few rows a member and block, and no pair is left out.
4. Pairs are verified on full sets, and classes are the connected components of the verified links.

Result: one row a document with class_id (least doc_id of its class), class_size (documents) and n_links (verified
links of its set to different sets).

Nulls: a null text is empty; all empty texts are one node without links. A text of fewer than five words has one
shingle. A null doc_id is kept and counts in its class; the class takes the least doc_id that isn't null.
Repeated rows are copies. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.session import shared_dir

from .hashing import WordIds, mix, shingles, texts
from .words import text_of

THRESHOLD, RECALL, ROWS = 0.8, 0.999, 6
ALL_PAIRS, BLOCK_NODES, BLOCK_SHINGLES = 16, 512, 1_000_000
#: Shingles of a block that are multiplied at a time.
SLICE = 4096
#: Not read any more: large buckets have no rounds.
LAST_ROUND = 4


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` rows with which a pair at the threshold meets with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def signer(bands: int, rows: int):
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**64, bands * rows, dtype=np.uint64, endpoint=False)

    def sign(found: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(found), 2048):
            part = (np.multiply.outer(factors, found[at : at + 2048]) + shifts[:, None]).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        key = np.arange(bands, dtype=np.uint64)
        for row in mix(least.reshape(bands, rows)).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        return key.view(np.int64)

    return sign


def nodes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, node, bands): bands is empty where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sign = WordIds(), signer(bands, rows)
        for batch in batches:
            node, keys = [], []
            for text in texts(batch, "text"):
                found = shingles(ids.of(text.split()))
                node.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True))
                keys.append(sign(found) if len(found) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "text_hash", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_ = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_hash"), "text")
    return rows_.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, found): the shingle sets of the wanted (node, row), one each; ``row`` names one document, so copies don't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            found = [shingles(ids.of(text.split())).view(np.int64) for text in texts(batch, "text")]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "found"])

    own = docs.select(F.xxhash64("doc_id", F.xxhash64(text_of("text"))).alias("row"), "text")
    met = own.join(wanted.select("node", "row"), "row")
    # A repeated row comes more than once.
    return met.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, found array<long>")


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, linked) of pairs (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("found_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (similarity(F.col("found_a"), F.col("found_b")) >= threshold - 1e-12).alias("linked"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)))
    row_l, row_r = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    order_l, order_r = np.argsort(flat_l, kind="stable"), np.argsort(flat_r, kind="stable")
    flat_l, row_l, flat_r, row_r = flat_l[order_l], row_l[order_l], flat_r[order_r], row_r[order_r]
    both = np.intersect1d(flat_l, flat_r)
    for at in range(0, len(both), SLICE):
        some, dense = both[at : at + SLICE], []
        for flat, row, n in ((flat_l, row_l, len(left)), (flat_r, row_r, len(right))):
            lo, hi = np.searchsorted(flat, some[0]), np.searchsorted(flat, some[-1], side="right")
            place = np.minimum(np.searchsorted(some, flat[lo:hi]), len(some) - 1)
            hit = some[place] == flat[lo:hi]
            x = np.zeros((n, len(some)), np.float32)
            x[row[lo:hi][hit], place[hit]] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of edges that join n nodes as all edges (a, b) do."""
    parent, kept = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def block_links(threshold: float):
    """(a, b, n_links) of a pair of blocks: links of node ``a``, and without n_links an edge of the forest."""

    def run(group: pa.Table) -> pa.Table:
        node, block = group["node"].to_numpy(), group["block"].to_numpy()
        first, second = group["first"][0].as_py(), group["second"][0].as_py()
        found = [x.values.to_numpy() for x in group["found"]]
        keys = np.stack([x.values.to_numpy() for x in group["bands"]])
        small = [set(x.as_py() or ()) for x in group["small"]]
        rare = np.array([[int(k) in s for k in row] for row, s in zip(keys, small, strict=True)]).reshape(keys.shape)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        meet, apart = np.zeros((len(left), len(right)), bool), np.zeros((len(left), len(right)), bool)
        for j in range(keys.shape[1]):
            same = keys[left, j][:, None] == keys[right, j][None, :]
            meet |= same
            apart |= same & rare[left, j][:, None]
        meet &= ~apart
        if first == second:
            meet = np.triu(meet, 1)
        used_l, used_r = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
        if not len(used_l):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        left, right, meet = left[used_l], right[used_r], meet[np.ix_(used_l, used_r)]
        shared = shared_counts([found[i] for i in left], [found[i] for i in right])
        size = np.array([len(x) for x in found])
        linked = meet & (shared / (size[left][:, None] + size[right][None, :] - shared) >= threshold - 1e-12)
        x, y = np.nonzero(linked)
        kept = forest(len(node), left[x], right[y])
        degree = np.bincount(left, linked.sum(axis=1), len(node)) + np.bincount(right, linked.sum(axis=0), len(node))
        some = np.flatnonzero(degree)
        none = lambda n, kind: pa.nulls(n, kind)
        return pa.table({
            "a": pa.array(np.r_[node[some], node[left[x[kept]]]], pa.int64()),
            "b": pa.concat_arrays([none(len(some), pa.int64()), pa.array(node[right[y[kept]]], pa.int64())]),
            "n_links": pa.concat_arrays([pa.array(degree[some].astype(np.int64)), none(len(kept), pa.int64())]),
        })

    return run


def large_links(large: DataFrame, small: DataFrame, one: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``block_links`` for the buckets of ``large`` (band, node, leader); ``small`` (band, node) has the other buckets."""
    star = large.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    hang = components(star)  # every node of a large bucket is in it
    sized = hang.join(sets.select("node", F.size("found").alias("n_found")), "node")
    per = sized.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n_found") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    dealt = sized.join(per, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))).alias("block")).checkpoint()
    placed = large.select("band", "node").join(dealt, "node").checkpoint()
    seen = placed.select("band", "block").distinct()
    met = placed.join(seen.withColumnRenamed("block", "other"), "band")
    groups = met.select(F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "block").distinct()
    rare = small.join(dealt.select("node"), "node").groupBy("node").agg(F.collect_list("band").alias("small"))
    full = sets.join(dealt.select("node"), "node").join(one.select("node", "bands"), "node").join(rare, "node", "left")
    return groups.join(full, "node").groupBy("first", "second").applyInArrow(block_links(threshold), "a long, b long, n_links long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the links (a, b); nodes without links are left out.

    Every round takes the least label of the neighbours and then the label of that label, so chains halve.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = met.join(up, "label").select("node", "old", F.least("label", "top").alias("label")).checkpoint()
        if new.where("label != old").isEmpty():
            return labels
        labels = new.drop("old")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, class_node (least node), class_id, class_size and n_links of every document."""
    shared_dir(docs.sparkSession)
    all_ = nodes(docs, bands_for(threshold, recall, rows), rows).checkpoint()
    # A node's bands are the same in every copy.
    one = all_.groupBy("node").agg(F.first("bands").alias("bands"), F.min(F.xxhash64("doc_id", "text_hash")).alias("row"))
    keys = one.select("node", F.explode_outer("bands").alias("band")).where("band is not null")
    buckets = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    met = keys.join(buckets, "band").checkpoint()
    small = met.where(F.col("n") <= ALL_PAIRS)
    few = small.select("band", F.col("node").alias("a")).join(small.select("band", F.col("node").alias("b")), "band").where("a < b").select("a", "b")
    pairs = few.distinct().checkpoint()
    large = met.where(F.col("n") > ALL_PAIRS)
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(large.select("node")).distinct()
    sets = sets_of(docs, one.join(wanted, "node")).checkpoint()
    links = verify(pairs, sets, threshold).where("linked").select("a", "b").checkpoint()
    blocks = large_links(large, small, one, sets, threshold).checkpoint()
    labels = components(links.unionAll(blocks.where("b is not null").select("a", "b")))
    ends = [links.select(F.col(x).alias("node"), F.lit(1).cast("long").alias("n")) for x in ("a", "b")]
    counted = blocks.where("b is null").select(F.col("a").alias("node"), F.col("n_links").alias("n"))
    degree = ends[0].unionAll(ends[1]).unionAll(counted).groupBy("node").agg(F.sum("n").alias("n_links"))
    marks = labels.join(degree, "node")
    docs_ = all_.select("doc_id", "text_hash", "node").join(marks, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = docs_.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return docs_.join(per, "label").select("doc_id", "text_hash", F.col("label").alias("class_node"), "class_id", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that of least doc_id, nulls last, and of least text hash; a repeated row stays once."""
    found = classes(docs.select("doc_id", "text"), threshold)
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    best = found.groupBy("class_node").agg(F.min(rank).alias("best"))
    kept = best.select(F.xxhash64("best.doc_id", "best.text_hash").alias("_kept"))
    keyed = docs.withColumn("_kept", F.xxhash64("doc_id", F.xxhash64(text_of("text"))))
    return keyed.join(kept, "_kept", "left_semi").dropDuplicates(["_kept"]).drop("_kept")
