import zlib
from collections import defaultdict

import numpy as np

from airlattice.llm import mixing, sharding


def targets(sizes):
    """Targets by raising and capping until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_takings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, None, "x", None, 0), (5, " ", "x", "empty", 1), (6, "a few more words", "x", "é", 1), (6, "a few more words", "x", "é", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    sizes, most = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    want = targets(dict(sizes))
    got = mixing.plan(mixing.keyed(docs)).collect()
    assert len(got) == docs.count()
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    again = mixing.plan(mixing.keyed(docs.repartition(3))).collect()
    key = lambda r: (r.mix_key, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.taken(docs.where("false")).collect() == []


def test_pivot_keeps_mass_and_expectations():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    runs = [mixing.pivot(size, p, [i], False) for i in range(3000)]
    for out in runs[:200]:
        assert abs((size * out).sum() - (size * p).sum()) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.05


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copies = spark.range(1000, 1400).selectExpr("id as doc_id", "'the same text in a third of all rows' as text")
    docs = docs.union(copies).union(spark.createDataFrame([(None, None), (None, None), (1, "")], docs.schema)).withColumnRenamed("doc_id", "doc_id")
    out = sharding.assign(docs).collect()
    assert len(out) == docs.count()
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        b = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        size[r.shard] += len(b) + 1
        slots[r.shard].append(r.slot)
    most = max(r["size"] for r in out)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs.where("false")).collect() == []


def test_repeated_rows_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 700)
    docs = spark.range(100_000).selectExpr("cast(1 as long) as doc_id", "'five words of a copy' as text", "'a' as source", "id % 3 as other").unionAll(spark.range(50).selectExpr("id", "'other words'", "'b'", "id"))
    rows = mixing.numbered(mixing.keyed(docs))
    groups = rows.where("source = 'a'").selectExpr(f"pmod(mix_key, {100_000 // mixing.GROUP}) as g").groupBy("g").count().agg({"count": "max"}).first()[0]
    assert rows.count() == 100_050 and groups <= 2000
    out = mixing.plan(mixing.keyed(docs)).selectExpr("source", "target", "copies * size AS taken").groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r.target - r["sum(taken)"]) <= 5 for r in out) and len(out) == 2
    mixed = mixing.mix(docs)
    want = {r.source: r["sum(taken)"] for r in out}
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert got == {"a": want["a"] // 5, "b": want["b"] // 2} and mixed.columns == docs.columns
    by = [r["count"] for r in mixed.where("source = 'a'").groupBy("other").count().collect()]
    assert len(by) == 3 and max(by) - min(by) < 0.05 * sum(by)
