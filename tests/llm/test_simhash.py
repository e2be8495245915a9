"""Fingerprints and components against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from airlattice.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def components_of(points):
    """Least label of each point's component, labels being the points' own order."""
    points, parent = sorted(points), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in combinations(points, 2):
        if (a ^ b).bit_count() <= 4:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def plain(docs):
    marks = [(d[0], plain_fingerprint(d[1])) for d in docs]
    label = components_of({f for _, f in marks})
    least = {}
    for i, f in marks:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(label[f])) for i, f in marks), key=repr)


def found(spark, docs, schema=SCHEMA, **options):
    return sorted((tuple(r) for r in simhash.near_copies(spark.createDataFrame(docs, schema), **options).collect()), key=repr)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([60, 300, 900]))
        out.append(" ".join(base))
        for _ in range(4):
            near = base.copy()
            near[rng.randrange(len(near))] = "other"
            out.append(" ".join(near))
    return out


def test_documents_against_all_pairs(spark):
    docs = [(i, t, "en") for i, t in enumerate(texts(3))]
    docs += [(500, None, "en"), (501, "", None), (502, " \t\n", "en"), (503, "One", "en"), (504, "oNE", "en"), (505, "É é", "en"), (506, "a b c", None), (507, "a b\x0bc\x0c d", "en")]
    docs += [docs[0], docs[0], (None, docs[1][1], "en"), (None, "alone and without a number", "en"), (600, "lorem ipsum dolor " * 40_000, "en")]
    assert found(spark, docs) == plain(docs)
    extra = [(*d, 1, "x", 2) for d in docs[:30]]
    assert found(spark, extra, SCHEMA + ", node long, fingerprint string, component_id int") == plain(docs[:30])


def test_empty_table(spark):
    assert found(spark, []) == []


def test_every_count_is_met_by_a_triple():
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def cloud(seed):
    """Dense balls, chains of far ends, and pairs at 4 and 5 bits with bits in 4 bytes each."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    points = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(5):
        centre = rng.getrandbits(64)
        points |= {flip(centre, rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(80)}
    x = rng.getrandbits(64)
    for _ in range(40):
        points.add(x := flip(x, rng.choice([4, 4, 5])))
    for n in (4, 5):
        for _ in range(30):
            y = rng.getrandbits(64)
            points |= {y, y ^ sum(1 << (8 * p + rng.randrange(8)) for p in rng.sample(range(8), n))}
    return points


@pytest.mark.parametrize("block", [7, 64, 16_384])
def test_links_of_any_block_size_join_all_pairs(spark, block):
    from airlattice.operators.graph import components

    points = cloud(block)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    nodes = spark.createDataFrame([(signed(p),) for p in points], "node long")
    links = simhash.links(nodes, block)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links.collect())
    got = {r.node: r.label for r in components(links).collect()}
    mine = {}
    for p, label in components_of(points).items():
        mine.setdefault(label, set()).add(signed(p))
    theirs = {}
    for p in points:
        theirs.setdefault(got.get(signed(p), signed(p)), set()).add(signed(p))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_a_dense_group_gives_few_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(63)
    points = {centre ^ sum(1 << b for b in rng.sample(range(63), 2)) for _ in range(1500)}
    links = simhash.links(spark.createDataFrame([(p,) for p in points], "node long"), 256)
    assert links.count() <= len(simhash.TRIPLES) * len(points)
