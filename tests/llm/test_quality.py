import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row

from airlattice.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def check(docs, labels):
    out = quality.judge(docs, labels).collect()
    for r in out:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.text)
        assert q.kept is not None and not (q.kept and q.base_failed)
    return out


def test_base_and_verdicts_on_a_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = check(docs, labels)
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert len(out) == docs.count()
    assert all(r.quality.kept or r.quality.base_failed for r in out if label.get(r.doc_id) == 1)
    assert not any(r.quality.kept for r in out if label.get(r.doc_id) == 0)


def test_edges(spark):
    schema = "doc_id long, text string, quality string, label_id long, good int"
    texts = [None, "", " \t\n ", "a", "a b c a b c", "a b c b c a b c b", "x " * 400, "  　 é|é\n\né|é\nq", ("w%d " * 60) % tuple(range(60))]
    docs = spark.createDataFrame([(i if i else None, t, "own", 7, 1) for i, t in enumerate(texts)] + [(3, "a", "own", 7, 1)], schema)
    labels = spark.createDataFrame([(8, 1), (8, 1), (None, 0), (4, None)], "doc_id long, quality int")
    check(docs, labels)
    assert check(docs.where("false"), labels) == []
    assert check(docs, labels.where("false"))[-1].label_id == 7


def test_model_matches_brute_force(spark):
    xxhash = pytest.importorskip("xxhash")
    h = lambda b, seed=42: (v := xxhash.xxh64(b, seed=seed).intdigest()) - (v >> 63 << 64)
    pair = lambda a, b: h(b.to_bytes(8, "little", signed=True), seed=h(a.to_bytes(8, "little", signed=True)) % 2**64)

    def features(text, n):
        w = text.split()
        one = [h(x.encode()) for x in w]
        return [x % n for x in one] + [pair(a, b) % n for a, b in zip(one, one[1:])]

    from math import log

    rows = [(1, "good words here"), (2, "bad | bad | bad"), (3, "more good words"), (4, None), (5, "good bad more"), (7, "words here | good"), (9, "bad bad | here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {1: 1, 2: 0, 3: 1, 5: 1, 7: 1, 9: 0}
    labels = spark.createDataFrame(list(kinds.items()), "doc_id long, quality int")
    n = 50
    split = lambda text: [[x for x in features(text or "", n)][: len((text or "").split())], features(text or "", n)[len((text or "").split()) :]]
    known = {r.label_id: r for r in quality.labelled(labels).collect()}
    assert {d: r.good for d, r in known.items()} == kinds
    fits = {d for d, r in known.items() if r.fits}
    assert fits == {d for d, g in kinds.items() if g and zlib.crc32(str(d).encode()) % 5}
    want = []
    for k in range(2):
        raw, target = Counter(x for _, t in rows for x in split(t)[k]), Counter(x for d, t in rows if d in fits for x in split(t)[k])
        nr, nt = raw.total() + n, target.total()
        prior = quality.PRIOR * nt
        want += [round(1e6 * log((target[i] * nr / (raw[i] + 1) + prior) / (nt + prior))) for i in range(n)]
    got = quality.ratios(docs, quality.labelled(labels), n, 2)
    assert got == want
    # Verdicts, threshold included.
    score = {d: sum(want[x] for x in split(t)[0]) + sum(want[n + x] for x in split(t)[1]) for d, t in rows}
    size = {d: len((t or "").split()) for d, t in rows}
    out = [[score[d] // size[d] for d, g in kinds.items() if g == k and d not in fits] for k in (1, 0)]
    least = quality.cut(*out)
    assert quality.fit_threshold(docs, quality.labelled(labels), got, 2, n) == least
    for r in quality.judge(docs, labels, n).collect():
        q = r.quality
        assert q.base_failed and not q.kept
        if size[r.doc_id]:
            assert abs(q.score - score[r.doc_id] / size[r.doc_id] / 1e6) < 1e-12


def test_verdict_of_every_document(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = [r.quality for r in quality.judge(docs, labels).collect()]
    assert all(q.kept == (not q.base_failed and q.score >= q.threshold) for q in out)
    assert sum(q.kept for q in out) >= 0.85 * sum(not q.base_failed for q in out)


def test_cut():
    assert quality.cut([], [1]) is None and quality.cut([1], []) is None
    assert quality.cut([10, 12, 14], [1, 2, 3]) == 7
    assert quality.cut([10, 12, 14], [1, 2, 11]) == 7  # a bad document is kept before a good one goes
    assert quality.cut([1], [5]) == 1


def test_all_labels_count(spark):
    """More than 5,000 labels of a kind: the target and the threshold are read from all of them, also where they are shuffled."""
    docs = spark.range(7000).selectExpr("id AS doc_id", "CASE WHEN id < 6000 THEN 'good words here' ELSE 'bad | text' END AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id < 6000 AS INT) AS quality")
    known = quality.labelled(labels)
    assert known.count() == 7000
    fits = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(6000))
    assert known.where("fits").count() == fits > 4500
    model = quality.ratios(docs, known, 50, 1)
    few = quality.meet(docs, known, "left")
    many = quality.meet(docs, known, "left", sent=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    by = quality.with_score(quality.with_grams(docs, "text", 1, 50), model).selectExpr("doc_id", "CAST(floor(llr_micro / n_words) AS BIGINT) AS s").collect()
    rest = [(r.doc_id, r.s) for r in by if r.doc_id >= 6000 or zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert quality.fit_threshold(docs, known, model, 1, 50) == quality.cut([s for d, s in rest if d < 6000], [s for d, s in rest if d >= 6000])


@pytest.mark.parametrize("good, bad", [([10, 12, 14], [1, 2, 3]), ([10, 12, 14], [1, 2, 11]), ([1], [5]), ([], [1])])
def test_threshold_over_a_table(spark, good, bad):
    """The same threshold as from lists: documents of one word whose score is given by the model."""
    rows = [(i, f"w{s}", g, s) for i, (g, s) in enumerate([(1, s) for s in good] + [(0, s) for s in bad])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2], False) for r in rows], "label_id long, good int, fits boolean")
    grams = {r.doc_id: r._grams[0] for r in quality.with_grams(docs, "text", 1, 1 << 16).collect()}
    model = [0] * (1 << 16)
    for i, _, _, s in rows:
        model[grams[i]] = s
    assert quality.fit_threshold(docs, known, model, 1, 1 << 16) == quality.cut(good, bad)
