import random

from airlattice.llm import decontam


def grams(text):
    w = (text or "").encode().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, items):
    out = set()
    for i, t in items:
        want = grams(t)
        if not want:
            continue
        n = len(next(iter(want)))
        for d, text in docs:
            w = (text or "").encode().split()
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if len(want & have) >= 0.8 * len(want) - 1e-9:
                out.add((d, i, len(want), len(want & have)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as item_id", "1 as n_item")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.search(d, b).collect()}, d, b


def cases(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(4)
    for k in range(30):  # items with some words changed, inside other text
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((5000 + k, " ".join(["before"] * rng.randint(0, 9) + w + ["after"] * 3)))
    docs += [(9000, None), (9001, ""), (9002, "x two words y"), (9002, "x two words y"), (None, docs[-1][1])]
    return docs, items + [(100, None), (101, ""), (102, "two words"), (103, "words"), (None, items[0][1]), (0, items[0][1])]


def test_pairs_match_brute_force(spark, sf):
    docs, items = cases(spark, sf)
    got, d, b = run(spark, docs, items)
    want = brute(docs, items)
    assert got == want and len(want) > 20
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    bad = {(x[0]) for x in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if i not in bad)


def test_many_items_take_the_other_way(spark, sf, monkeypatch):
    docs, items = cases(spark, sf)
    monkeypatch.setattr(decontam, "SMALL_ITEMS", 10)
    assert run(spark, docs, items)[0] == brute(docs, items)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.search(docs, items).collect() == []
    assert decontam.clean(docs, items).count() == 1
    assert decontam.search(docs.where("false"), items).collect() == []


def test_an_item_of_fifty_thousand_words(spark):
    """Ranks are sent around without the items' sets, so a long item costs as much as its words."""
    rng = random.Random(12)
    item = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    text = " ".join(item)
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, " ".join(item[:41_000])), (3, " ".join(item[:30_000])), (4, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    found = decontam.search(docs, spark.createDataFrame([(7, text), (8, "w1 w2 w3 w4 w5")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 7), (2, 7), (4, 8)]
