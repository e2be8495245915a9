"""SimHash near-duplicates: a byte-position inverted index with count filtering, verified and closed to components.

1. A text's fingerprint has bit j set where over half of its 4-word shingles' XXH64 hashes have it; equal fingerprints are
   one node.
2. Two fingerprints that differ in at most ``DISTANCE`` = 4 of 64 bits differ in at most 4 of 8 bytes, so they share at
   least ``LEAST_SHARED`` = 4 positional bytes. The index posts a fingerprint under bytes *with their positions*. A list
   of one positional byte would hold a 256th of all nodes, so lists are intersected first: a posting is a triple of
   positional bytes, and the ``TRIPLES`` are a covering: every choice of four positions holds one of them. Lists then
   hold a share of 2**-24, and no pair that reaches the count is missed.
3. Within a list the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum fall out, and
   the rest are verified on all bits. A task walks a list as a search: a node is compared with those not reached yet and
   reaches its links, so near copies leave the search at once, and a list gives a forest of its links, no pair rows. A
   list of more than ``BLOCK`` nodes is cut into blocks, each pair of which is one group.
4. Components of the forests' links are those of all links.

Result: doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component).

Nulls and empty texts have fingerprint zero, which links as any other. Fewer than four words are one shingle. A null
doc_id is kept; it counts in no component_id unless there is no other. Repeated rows are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from airlattice.operators.graph import components
from airlattice.operators.joins import spread_join
from airlattice.session import shared_dir

from .hashing import texts

WORDS, SEED = 4, 42
BYTES, DISTANCE = 8, 4
LEAST_SHARED = BYTES - DISTANCE
#: Nodes of a list that one task searches at a time (8 bytes each), and shingles whose bits are counted at a time.
BLOCK, SLICE = 16_384, 16_384


def covering(groups: tuple[tuple[int, ...], ...] = ((0, 1, 2), (3, 4, 5), (6, 7))) -> list[tuple[int, ...]]:
    """Triples of positions of which every four positions hold one.

    A triple counts if its positions lie in one group, or two in one group and one in the group after it, in turn. Four positions
    in three groups lie 4+0+0 (not with these sizes), 3+1+0 (the three), 2+2+0 (one of both groups is before the other in turn)
    or 2+1+1 (two, and the one in the next group).
    """
    out = [g for g in groups if len(g) == 3]
    for k, g in enumerate(groups):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in groups[(k + 1) % len(groups)]]
    return sorted(out)


TRIPLES = covering()


def fingerprint(text: bytes) -> int:
    """Of a text's bytes; only A to Z are folded."""
    words = text.lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    stops = ends[k - 1 :].tolist()
    seen, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, SLICE):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)], "<u8")
        seen += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(seen * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node): the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long")


def postings(node: Column) -> Column:
    """Keys of the lists that a node is in: the number of the triple above its three bytes."""

    def byte(position: int) -> Column:
        return F.shiftrightunsigned(node, 8 * position).bitwiseAND(F.lit(255))

    keys = []
    for number, triple in enumerate(TRIPLES):
        key = F.lit(number).cast("long")
        for position in triple:
            key = F.shiftleft(key, 8).bitwiseOR(byte(position))
        keys.append(key)
    return F.array(*keys)


def linked(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` reach the least number of positional bytes shared with ``one``, and then differ in few enough bits."""
    apart = others ^ one
    shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(shared >= LEAST_SHARED)
    return near[np.bitwise_count(apart[near]) <= DISTANCE]


def search(nodes: np.ndarray, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links among ``nodes``; with ``other``, of the links between the two."""
    sides = [nodes] if other is None else [nodes, other]
    left = [s.copy() for s in sides]  # not reached yet
    edges = []
    for side in range(len(sides)):
        while len(left[side]):
            ahead, left[side] = [(side, left[side][-1])], left[side][:-1]
            while ahead:
                at, one = ahead.pop()
                to = 1 - at if other is not None else at
                hit = linked(one, left[to])
                if len(hit):
                    found = left[to][hit]
                    edges += [(int(one), int(x)) for x in found]
                    ahead += [(to, x) for x in found]
                    left[to] = np.delete(left[to], hit)
    return edges


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (list, first, second, block, node) that come sorted by the first three."""
    held = None

    def of(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        nodes, block = group["node"], group["block"]
        if group["first"][0] == group["second"][0]:
            return search(nodes)
        mine = block == group["first"][0]
        return search(nodes[mine], nodes[~mine])

    def answer(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in ("list", "first", "second", "block", "node")}
        rows["node"] = rows["node"].view(np.uint64)
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        n = len(rows["node"])
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for c in ("list", "first", "second"):
            change |= rows[c][1:] != rows[c][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.append(starts, n))
        # The last group may go on in the next batch.
        held = {c: v[starts[-1] :].copy() for c, v in rows.items()}
        starts, sizes = starts[:-1], sizes[:-1]
        two = starts[(sizes == 2) & (rows["first"][starts] == rows["second"][starts])]
        a, b = rows["node"][two], rows["node"][two + 1]
        near = np.bitwise_count(a ^ b) <= DISTANCE  # few bits apart leave enough bytes shared
        edges = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for k in np.flatnonzero((sizes > 2) | (sizes == 2) & (rows["first"][starts] != rows["second"][starts])):
            edges += of({c: v[starts[k] : starts[k] + sizes[k]] for c, v in rows.items()})
        yield answer(edges)
    if held is not None:
        yield answer(of(held))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of distinct ``nodes`` that join them as all links of at most DISTANCE bits do."""
    posted = nodes.select("node", F.explode(postings(F.col("node"))).alias("list"))
    # Lists longer than a block, with their number of blocks: nodes * triples / BLOCK of them at most.
    long = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    met = posted.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Each pair of blocks is a group: a node goes to one with every block of its list.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = met.select("list", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node")
    dealt = placed.repartition("list", "first", "second").sortWithinPartitions("list", "first", "second")
    return dealt.mapInArrow(forests, "a long, b long").distinct()


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    shared_dir(docs.sparkSession)
    found = fingerprints(docs).checkpoint()
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).checkpoint()
    labels = components(links(nodes.select("node"), block))
    marked = nodes.join(labels, "node", "left").select("node", "least", "copies", F.coalesce("label", "node").alias("label"))
    per = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    marks = marked.join(per, "label").select("node", "copies", "component_id").checkpoint()
    # A fingerprint may be that of a third of all documents.
    return spread_join(found, marks, ["node"], "copies", found.count()).select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
