import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.llm import lm


def brute(rows):
    """Counts, base and unquantised back-off scores; no hot words but the start."""
    docs = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        docs.append((doc_id, zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2, w))
    c = Counter(x for _, held, w in docs if not held for x in [*w, b" end"])
    n, v = c.total(), len(c)
    base = lambda x: log10((c[x] + 1) / (n + v + 1))
    out = []
    for doc_id, held, w in docs:
        t = [*w, b" end"]
        out.append((doc_id, held, len(t), sum(c[x] > 0 for x in t), n, sum(map(base, t))))
    return out


def opened(values):
    parts, (n, bits) = lm.EliasFano.encode(values)
    return lm.EliasFano(*(parts[x] for x in lm.EliasFano.PARTS), n, bits), sum(a.nbytes for a in parts.values())


def test_levels():
    rng = np.random.default_rng(1)
    for universe, n in ((10, 10), (1000, 3), (10**12, 5000), (70000, 0), (1 << 40, 1), (70000, 40000), (10**9, 200000)):
        values = np.unique(rng.integers(0, universe, n))
        ef, size = opened(values)
        assert (ef.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 500)]) if n else rng.integers(0, universe, 500)
        at = np.searchsorted(values, asked)
        assert (ef.successor(asked, np.zeros(len(asked), int), np.full(len(asked), len(values)))[0] == at).all()
        there = np.isin(asked, values)
        assert (ef.find(asked) == np.where(there, at, -1)).all()
        if len(values) > 1000:  # low bits, two or three of unary, as much again for the counts
            assert size * 8 / len(values) < ef.bits + 7


def test_children_by_pointers():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([np.arange(50) * 1000, rng.integers(0, 50000, 3000), 7000 + np.arange(1000)]))
    parents, words = keys // 1000, keys % 1000
    pointers, raised = lm.Level.sequences(parents, words, 50)
    assert (np.diff(pointers) > 0).all() and (np.diff(raised) > 0).all()
    level = lm.Level(opened(pointers)[0], opened(raised)[0])
    asked = np.arange(50000)
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (level.find(np.arange(50), asked // 1000, asked % 1000) == want).all()


def test_two_levels():
    rng = np.random.default_rng(3)
    v, w = (rng.zipf(1.4, 3000) % 80 for _ in range(2))
    order = np.lexsort((w[:2000], v[:2000]))
    trie = lm.Trie.build(v[:2000][order], None, w[:2000][order], 80)
    two, total = Counter(zip(v[:2000], w[:2000])), Counter(v[:2000].tolist())
    kinds = Counter(a for a, _ in two)
    log, rest = trie.score(v, None, w)
    for i, (a, x) in enumerate(zip(v, w)):
        want = log10((two[a, x] - lm.DISCOUNT) / total[a]) if (a, x) in two else log10(lm.DISCOUNT * kinds[a] / total[a]) if a in total else 0
        assert rest[i] == ((a, x) not in two) and log[i] == pytest.approx(want, abs=0.05)


def test_trie_against_dictionaries():
    rng = np.random.default_rng(2)
    v, u, w = (rng.zipf(1.5, 4000) % 60 for _ in range(3))
    order = np.lexsort((w[:3000], u[:3000], v[:3000]))
    trie = lm.Trie.build(v[:3000][order], u[:3000][order], w[:3000][order], 60)
    three, two = Counter(zip(v[:3000], u[:3000], w[:3000])), Counter(zip(v[:3000], w[:3000]))
    kinds3, kinds2, tot3, tot2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), k in three.items():
        kinds3[a, b] += 1
        tot3[a, b] += k
    for (a, _), k in two.items():
        kinds2[a] += 1
        tot2[a] += k
    log, rest = trie.score(v, u, w)
    d = lm.DISCOUNT
    for i, (a, b, x) in enumerate(zip(v, u, w)):
        want, left = 0.0, False
        if (a, b, x) in three:
            want = log10((three[a, b, x] - d) / tot3[a, b])
        else:
            if (a, b) in tot3:
                want += log10(d * kinds3[a, b] / tot3[a, b])
            if (a, x) in two:
                want += log10((two[a, x] - d) / tot2[a])
            else:
                left = True
                if a in tot2:
                    want += log10(d * kinds2[a] / tot2[a])
        assert rest[i] == left and log[i] == pytest.approx(want, abs=0.05)


@pytest.mark.parametrize("order", [2, 3])
def test_whole_table(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in lm.score(docs, order).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    for doc_id, held, n, known, train, base in want:
        r = got[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held out, the model beats the base


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, "a b a b"), (2, "a b a b"), (3, "Ä b\x0bc"), (9, "  "), (4, "the " * 500), (5, "of the " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs).collect()], key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert lm.score(docs.where("false")).collect() == []


def back_off(rows, order):
    """Unquantised back-off scores of all documents, by dictionaries over the whole table."""
    docs = []
    for doc_id, text in rows:
        docs.append((doc_id, zlib.crc32(str(doc_id).encode()) % 7 == 2, ["<s>", "<s>", *text.split(), "</s>"]))
    count = [Counter() for _ in range(3)]
    for _, held, t in docs:
        for i in range(2, len(t) * (not held)):
            for k in range(3):
                count[k][tuple(t[i - k : i + 1])] += 1
    total, kinds = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for k in range(3):
        for gram, n in count[k].items():
            total[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1
    size = total[0][()] + len(count[0]) + 1

    def log(gram):
        k, d = len(gram) - 1, lm.DISCOUNT
        if not k:
            return log10((count[0][gram] + 1) / size)
        if gram in count[k]:
            return log10((count[k][gram] - d) / total[k][gram[:-1]])
        return log(gram[1:]) + (log10(d * kinds[k][gram[:-1]] / total[k][gram[:-1]]) if gram[:-1] in total[k] else 0)

    return {d: (len(t) - 2, sum(log(tuple(t[i - order + 1 : i + 1])) for i in range(2, len(t)))) for d, _, t in docs}


@pytest.mark.parametrize(("order", "shard_events"), [(2, 2_000_000), (2, 150), (3, 2_000_000), (3, 150)])
def test_hot_contexts_keep_whole_counts(spark, monkeypatch, order, shard_events):
    monkeypatch.setattr(lm, "SHARD_EVENTS", shard_events)
    rng = np.random.default_rng(5)
    rows = [(d, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.5, rng.integers(1, 25)), 300))) for d in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = back_off(rows, order)
    got = {r.doc_id: r.score for r in lm.score(docs, order).collect()}
    assert set(got) == set(want)
    for d, (n, score) in want.items():
        assert got[d] == pytest.approx(score, abs=2e-3 * n)


def test_hot_words_are_bounded_and_exact(spark):
    """At ten thousand shards every word of a small table is a candidate by itself, but no more than the bound are kept."""
    import random

    from airlattice.llm.hashing import WordIds

    rng = random.Random(4)
    rows = [(i, " ".join(["the"] * 30 + ["of"] * 3 + [f"w{rng.randrange(10**7)}" for _ in range(300)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(7)
    ids, words = WordIds(), Counter(w for _, t in rows for w in t.split())
    n = sum(words.values())
    for finest in (20, 100, 20_000):
        found = lm.candidates(docs, finest)
        assert len(found) <= 2 * finest and {ids[w.encode()] for w, c in words.items() if c * finest >= n} <= set(found.tolist())
    got = lm.heavy(docs, 10, n)
    assert got == {ids[w.encode()]: c for w, c in words.items() if 100 * c > n} and len(got) == 1
