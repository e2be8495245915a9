import random

import pytest

from airlattice.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] == sets[j]
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                parent[root(i)] = root(j)
                if not same:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    out = {}
    for i, (d, t) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out[d] = (min(x for x in group if x is not None) if any(x is not None for x in group) else None, len(group), len(links[i]))
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in jaccard.classes(docs).collect()}


def test_small_groups_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, " "), (10**6 + 4, "one two"), (10**6 + 5, "one\ntwo"), (None, "one two")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("last", [0, 4])
def test_large_group_is_one_class(spark, monkeypatch, last):
    monkeypatch.setattr(jaccard, "LAST_ROUND", last)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):  # near copies, each with its own changes: not all are linked to each other
        w = list(words)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(400)] = f"x{d}_{rng.random()}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(f"q{d}_{i}" for i in range(100))) for d in range(20)]
    got, want = found(spark, rows), brute(rows)
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}


@pytest.mark.parametrize("block", [512, 16])
def test_large_group_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block, raising=False)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(90):
        w = list(words)
        for _ in range(rng.randint(1, 3) if d < 60 else rng.randint(4, 12)):
            w[rng.randrange(400)] = f"x{d}_{rng.random()}"
        rows.append((d, " ".join(w)))
    got, want = found(spark, rows), brute(rows)
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}
    # Pairs that lie at the threshold may meet in no band.
    sums = [sum(x[2] for x in y.values()) for y in (got, want)]
    assert all(got[d][2] <= want[d][2] for d in got) and sums[0] >= 0.999 * sums[1]


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 7)
    rng = random.Random(5)
    import numpy as np

    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.int64) for _ in range(20)]
    want = [[len(set(a) & set(b)) for b in sets[8:]] for a in sets[:8]]
    assert jaccard.shared_counts(sets[:8], sets[8:]).tolist() == want


def test_keep_one(spark):
    rows = [(3, "a b c d e f", "z"), (1, "a b c  d e f", "y"), (1, "a b c  d e f", "y"), (None, "a b c d e f", None), (7, "other text entirely", "x"), (None, "lonely words of no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c  d e f", "y"), (7, "other text entirely", "x"), (None, "lonely words of no id", "x")], key=str)
    assert jaccard.keep_one(docs.where("false")).collect() == []


def test_bands():
    for t in (0.5, 0.8, 0.9):
        b = jaccard.bands_for(t, 0.999, 6)
        assert 1 - (1 - t**6) ** b >= 0.999 > 1 - (1 - t**6) ** (b - 1)
