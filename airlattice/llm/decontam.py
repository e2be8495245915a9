"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly [native].

A document is contaminated by a benchmark item where at least ``THRESHOLD`` of the item's distinct five-word
shingles occur in it. The item is short and the document long, so their Jaccard similarity says little; the
search is for containment. The hash of a shingle is its rank. An item of n shingles is known by its least
floor((1 - t) * n) + 1 ranks: a document that holds a share t of them misses at most (1 - t) * n, so it holds one of
those for certain. Items are partitioned by size (powers of two), and each partition has a bound: the greatest of the
ranks that its items are known by. A document's signature is its shingles below the bounds of the partitions that it is
large enough for (fewer than t shingles of the partition's least item can contain none of its items): a MinHash sketch by
threshold, about a fifth of the shingles. Signatures meet the items' ranks, and candidates are verified on full sets.

Items of fewer than five words have one shingle, the whole item, and are looked for as such. An item without
words contaminates nothing. Nulls: a null text is empty; rows with a null ``doc_id`` or ``item_id`` are treated
as any other. Repeated rows give one result. Matching is on words as they are written. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.session import shared_dir

from .words import SHINGLE, chain, hashes, text_of, words

THRESHOLD = 0.8
#: Shingles of all items up to which the ranks that items are known by, and each item's set once, are sent to every task: 8 bytes a shingle.
SMALL_ITEMS = 200_000
#: Shingles from which an item is long, a power of two as the partitions are.
LONG_ITEM = 1024
#: Contaminated documents up to which their keys (two longs) are sent to every task.
FEW_FOUND = 500_000


def windows(hash_: Column, length: int) -> Column:
    """Hashes of all ``length``-word windows, from those of the words; length 1 to 5."""
    if length == 1:
        return hash_
    pairs = chain(hash_, hash_, 1)
    if length == 2:
        return pairs
    if length == 3:
        return chain(pairs, hash_, 2)
    n = F.greatest(F.size(hash_) - 3, F.lit(0))
    fours = F.zip_with(F.slice(pairs, 1, n), F.slice(pairs, 3, n), lambda a, b: F.xxhash64(a, b))
    return fours if length == 4 else chain(fours, hash_, 4)


def with_shingles(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """Adds _shingles: hashes of the windows of all the lengths."""
    df = df.withColumn("_hash", hashes(words(text_of(text))))
    return df.withColumn("_shingles", F.concat(*[windows(F.col("_hash"), n) for n in lengths])).drop("_hash")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[int], list[tuple[int, int, int]]]:
    """(item_id, item_set, n_item, sketch) of the items with words; the window lengths they need; partitions (least size, bound, shingles)."""
    df = items.select("item_id", "text").withColumn("_length", F.least(F.size(words(text_of("text"))), F.lit(SHINGLE)))
    lengths = sorted(r[0] for r in df.select("_length").distinct().collect() if r[0])  # 1 to 5
    parts = [with_shingles(df.where(F.col("_length") == n), "text", [n]) for n in lengths]
    if not parts:
        return df.select("item_id", F.array().cast("array<bigint>").alias("item_set"), F.lit(0).alias("n_item"), F.array().cast("array<bigint>").alias("sketch")).where("false"), [], []
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionAll(p)
    all_ = all_.select("item_id", F.array_sort(F.array_distinct("_shingles")).alias("item_set")).distinct()
    all_ = all_.withColumn("n_item", F.size("item_set"))
    keep = F.floor(F.col("n_item") * (1 - threshold) + 1e-9).cast("int") + 1
    all_ = all_.withColumn("sketch", F.slice("item_set", F.lit(1), keep))
    by = all_.groupBy(F.floor(F.log2("n_item")).alias("part")).agg(F.min("n_item").alias("least"), F.max(F.array_max("sketch")).alias("bound"), F.sum("n_item").alias("n"))
    rows = by.collect()  # 31 at most
    return all_, lengths, sorted((r.least, r.bound, r.n) for r in rows)


def signature(shingles: Column, partitions: list[tuple[int, int, int]], threshold: float) -> Column:
    """The shingles below the greatest bound of the partitions that the document is large enough for."""
    bound = F.lit(None).cast("long")
    for least, top, _ in partitions:
        enough = F.size(shingles) >= F.lit(-(-int(round(least * threshold * 10**9)) // 10**9))
        bound = F.greatest(bound, F.when(enough, F.lit(top).cast("long")))
    return F.filter(shingles, lambda h: F.coalesce(h <= bound, F.lit(False)))


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment): contaminated documents and the items in them."""
    shared_dir(docs.sparkSession)
    found, lengths, partitions = sketches(items, threshold)
    enough = F.ceil(F.col("n_item") * threshold - 1e-9)
    base = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_hash"), "text")
    base = with_shingles(base, "text", lengths or [SHINGLE]).drop("text")
    signed = base.withColumn("_signature", signature(F.col("_shingles"), partitions, threshold))
    shared = F.size(F.array_intersect("_shingles", "item_set")).alias("n_shared")
    fits = (F.col("rank") == F.col("probe")) & (F.size("_shingles") >= enough)

    def at_once(found: DataFrame) -> DataFrame:
        """Every task has the ranks and the sets, so a hit is verified where it is found; no text or set is shuffled."""
        side = F.broadcast(found.select("item_id", "n_item", F.explode("sketch").alias("probe")))
        hit = signed.select("doc_id", "text_hash", "_shingles", F.explode_outer("_signature").alias("rank")).join(side, fits)
        sets = F.broadcast(found.select(F.col("item_id").alias("_i"), F.col("n_item").alias("_m"), "item_set"))
        hit = hit.join(sets, F.col("_i").eqNullSafe(F.col("item_id")) & (F.col("_m") == F.col("n_item")))
        return hit.select("doc_id", "text_hash", "item_id", "n_item", shared)

    def by_pairs(found: DataFrame) -> DataFrame:
        """Signatures and sketches shuffle on the rank, then only the pairs that met, once each, fetch their sets."""
        side = found.select("item_id", "n_item", F.explode("sketch").alias("probe"))
        size = signed.select("doc_id", "text_hash", F.size("_shingles").alias("_n"), F.explode_outer("_signature").alias("rank"))
        met = size.join(side, (F.col("rank") == F.col("probe")) & (F.col("_n") >= enough)).select("doc_id", "text_hash", "item_id", "n_item").distinct().checkpoint()
        met = met.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("item_id").alias("_i"), F.col("n_item").alias("_m"))
        same = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("text_hash"))
        wanted = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_hash"), "text").join(met.select("_d", "_t").distinct(), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        with_doc = met.join(with_shingles(wanted, "text", lengths).drop("text"), same)
        with_both = with_doc.join(found.select("item_id", "item_set", "n_item"), F.col("_i").eqNullSafe(F.col("item_id")) & (F.col("_m") == F.col("n_item")))
        return with_both.select("doc_id", "text_hash", "item_id", "n_item", shared)

    # A long item meets a document that holds it at thousands of ranks: such pairs are made distinct before they are verified.
    short, long = found.where(F.col("n_item") < LONG_ITEM), found.where(F.col("n_item") >= LONG_ITEM)
    pairs = at_once(short) if sum(m for least, _, m in partitions if least < LONG_ITEM) <= SMALL_ITEMS else by_pairs(short)
    if any(least >= LONG_ITEM for least, _, _ in partitions):
        pairs = pairs.unionAll(by_pairs(long))
    pairs = pairs.withColumn("n_shared", F.when(F.col("n_shared") >= enough, F.col("n_shared")))
    pairs = pairs.groupBy("doc_id", "text_hash", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared")).where("n_shared is not null")
    return pairs.select("doc_id", "text_hash", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the contaminated ones. Their keys are found once and counted: few go to every task, so no text is shuffled."""
    shared_dir(docs.sparkSession)
    bad = search(docs, items, threshold).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct().checkpoint()
    side = F.broadcast(bad) if bad.count() <= FEW_FOUND else bad
    keyed = docs.withColumn("_text_hash", F.xxhash64(text_of("text")))
    return keyed.join(side, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_text_hash") == F.col("_bad_hash")), "left_anti").drop("_text_hash")
