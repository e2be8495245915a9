import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from airlattice.llm import pii, pii_examples, toxicity

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans():
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1", "2.3", "12", "+1 ", "(555)", "-", " ", "4111 1111 1111 1111", "x", "%", "a.b@c-d.e.f", "255", "é", "+44 20 7946 0958", "\n", "٣", "0001"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("1" * 200_000 + "x" * 200_000 + "@") == []


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9000 + i, f"call +1 (555) 555-{1000 + i} or write to someone.{i}@mail.example.com from 10.0.{i}.7 today") for i in range(30)] + [(None, None), (1, "")]


def test_table_and_viterbi(spark, sf):
    rows = texts(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows[:-1]:
        base = brute(t or "")
        r = by[d]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))
    field = pii.field()
    words = [(t or "").encode().split() for _, t in rows]
    classes = np.array([field.words[w] for x in words for w in x], np.int32)
    size = np.array([len(x) for x in words])
    edge = np.r_[0, np.cumsum(size)]
    breaks = np.zeros(len(classes), bool)
    breaks[edge[:-1][size > 0]] = True
    labels = field.decode(classes, breaks)
    assert (labels > 0).any()
    for i, n in enumerate(size):
        if not 0 < n < 2000:
            continue
        c, table = classes[edge[i] : edge[i + 1]], np.stack(field.scores)
        hot = np.array(field.marked)[c]
        score = np.zeros((n, pii.LABELS))
        for j in range(n):
            for p in range(pii.PLACES):
                if 0 <= j + p - pii.REACH < n:
                    score[j] += table[c[j + p - pii.REACH], p]
            if not hot[max(0, j - 1) : j + 2].any():
                score[j, 1:] = -1e9  # neither marked nor beside a marked word
        best, back = score[0], []
        for t in range(1, n):
            step = best[:, None] + field.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert (labels[edge[i] : edge[i + 1]] == path[::-1]).all()


def added(text):
    field, base, words = pii.field(), pii.base_spans(text), text.encode("utf-8", "replace").split()
    classes = np.array([field.words[w] for w in words], np.int32)
    return base, pii.added_spans(text, field.decode(classes, np.arange(len(words)) == 0), base)


def test_field_on_held_out_sentences():
    right, gold, wrong = Counter(), Counter(), Counter()
    for text, spans in pii_examples.examples(400, seed=91):
        base, more = added(text)
        want = [s for s in spans if not any(b < s[2] and s[1] < e for _, b, e in base)]
        gold.update(s[0] for s in want)
        right.update(s[0] for s in want if s in more)
        wrong.update(s[0] for s in more if s not in want)
    found = right.total() + wrong.total()
    print({k: (right[k], gold[k], wrong[k]) for k in pii.FIELD_KINDS})
    assert right.total() >= 0.9 * found and all(right[k] >= 0.8 * gold[k] and gold[k] > 5 for k in pii.FIELD_KINDS)


@pytest.mark.parametrize("text", ["the number 9807915762804490 is on the box", "version 3.10.2 of 2024-03-17", "commit 7 of order 100-4567-22", "at 12:30 on page 118 with @ann", ""])
def test_field_leaves_look_alikes(text):
    assert added(text) == ([], [])


def test_planted_spans(spark):
    planted = ["call (555) 123-4567 now", "host 10[.]2[.]3[.]4 is down", "write to jane[at]example.com today", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file', "pay with card 4111.1111.1111.1111 please"]
    want = ["phone:5:19", "ip:5:19", "email:9:28", "secret:9:49", "card:14:33"]
    docs = spark.createDataFrame(list(enumerate(planted)) * 3 + [(9, "words " * 200_000 + planted[0])], "doc_id long, text string")
    got = [(r.doc_id, r.n_added, r.n_spans, r.spans) for r in pii.find(docs).collect()]
    assert sorted(got)[:-1] == sorted((i, 1, 1, w) for i, w in enumerate(want) for _ in range(3))
    assert sorted(got)[-1] == (9, 1, 1, "phone:1200005:1200019")
    assert pii.find(docs.where("false")).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string")
    assert [(r.n_added, r.spans) for r in pii.find(docs).collect()] == [(0, ""), (0, "")]


@pytest.mark.parametrize("near", ["josé@example.com", "zoë@example.org", "jane@localhost"])
def test_field_adds_emails_without_digits(spark, near):
    names = ["ann", "bob", "carla", "dieter", "eve"]
    rows = [(i, f"please write to {names[i % 5]}@example.com today about the order") for i in range(60)]
    rows += [(100, f"please write to {near} today about the order"), (101, "please write to them today about the order")]
    got = {r.doc_id: (r.n_email, r.n_added, r.spans) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == (0, 1, f"email:16:{16 + len(near)}")
    assert got[101] == (0, 0, "") and all(got[d][:2] == (1, 0) for d in range(60))


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for d in range(300):
        w = [word() for _ in range(60)]
        toxic = d % 3 == 0
        if toxic:
            for _ in range(rng.randint(2, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "Nasty,", "rotten!", "vileness"]))
        rows.append((d, " ".join(w)))
        if d < 200:
            labels.append((d, int(toxic)))
    rows += [(None, None), (1000, ""), (1001, "vile " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as severity")
    known = spark.createDataFrame([*labels, (None, 1), (0, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    held = [(out[d].toxic, d % 3 == 0) for d in range(200, 300)]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.severity <= 2 for r in out.values()) and not out[1000].toxic and out[1001].toxic
    assert not any(r.toxic for r in toxicity.score(docs, known.where("toxic = 0")).collect())
    assert toxicity.score(docs.where("false"), known).collect() == []


def test_fit_and_scores_by_brute_force(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for d in range(400):
        w = [f"w{rng.randint(0, 60)}" for _ in range(30)]
        grade = (d % 4 == 0) + (d % 8 == 0)
        w += rng.sample(["vile,", "Nasty", "rotten!", "awful"], rng.randint(1, 2) if grade == 1 else 4 if grade == 2 else 0)
        rng.shuffle(w)
        rows.append((d, " ".join(w)))
        labels.append((d, int(grade > 0), int(grade < 2)))
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    sample = toxicity.sample(docs, known)
    assert Counter(g for _, g in sample) == {0: 300, 1: 50, 2: 50}  # repeated rows come once
    model = toxicity.fit(sample)

    def features(text):
        cores = {w.lower().strip(toxicity.PUNCTUATION.decode()) for w in text.split()} - {""}
        ids = toxicity.WordIds()
        return {ids[x] >> (64 - toxicity.BITS) for c in cores for x in (c.encode(), c.encode()[:4] + b"~")}

    assert sorted((sorted(f), g) for f, g in sample) == sorted((sorted(features(t)), int(1 - q + x)) for (_, t), (_, x, q) in zip(rows, labels))

    def loss(weights, cuts):
        total = 0.0
        for f, g in sample:
            s = sum(weights[x] for x in f)
            above = [1.0, *(1 / (1 + np.exp(c - s)) for c in cuts), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total / len(sample) + toxicity.RIDGE / 2 * (weights**2).sum()

    # At the fitted point every direction is uphill or flat: no step by finite differences gains much.
    best = loss(model.weights, model.cuts)
    used = np.flatnonzero(model.weights)
    assert 4 <= len(used) <= 30 and best < 0.35
    for f in used:
        for step in (-0.05, 0.05):
            other = model.weights.copy()
            other[f] += step
            assert loss(other, model.cuts) > best - 2e-4
    for k in (0, 1):
        for step in (-0.05, 0.05):
            cuts = model.cuts.copy()
            cuts[k] += step
            assert loss(model.weights, cuts) > best - 2e-4
    out = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    for d, t in rows:
        s = sum(model.weights[x] for x in features(t))
        assert abs(out[d].severity - sum(1 / (1 + np.exp(c - s)) for c in model.cuts)) < 1e-8
    mean = [np.mean([out[d].severity for d, x, q in labels if x + (1 - q) == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.2 < mean[1] < mean[2]


def test_telling_features():
    held, toxic = np.array([100, 100, 3, 40, 200]), np.array([10, 60, 3, 0, 20])
    assert toxicity.telling(held, toxic, 0.1).tolist() == [1, 2, 3]


@pytest.mark.parametrize("zeros", [300, 5000])
def test_runs_of_digits_of_any_length(zeros):
    long = "0" * zeros
    assert pii.base_spans(long + "1.2.3.4 x") == [("ip", 0, zeros + 7)] and pii.base_spans(f"1.2.3.{long}9 x") == [("ip", 0, zeros + 7)]
    assert pii.base_spans(f"{'9' * zeros}.2.3.4") == [] and pii.base_spans("4" * zeros) == [] and pii.base_spans("+" + "4" * zeros) == []
    assert pii.base_spans(f"{long}@{long}.{long} ")[0][0] == "email"


def test_grades_on_held_out_fifths():
    """Mean severity rises with the grade on labels that the model hasn't seen; grades come from the other labels' lexicon, not from the model."""
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").drop_duplicates("doc_id").set_index("doc_id")
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").groupby("doc_id").agg(toxic=("toxic", "max")).join(docs, how="inner")
    features = toxicity.Features()
    rows = [(np.array(sorted(features.of((t or "").encode())), np.int32), int(x)) for t, x in zip(labels.text, labels.toxic)]
    fold = np.random.default_rng(0).integers(0, 5, len(rows))
    severity, grade = np.zeros(len(rows)), np.zeros(len(rows), int)
    for k in range(5):
        known = [(np.frombuffer(f, np.int32), y) for f, y in sorted({(f.tobytes(), y) for (f, y), at in zip(rows, fold) if at != k})]
        model, terms = toxicity.fit(toxicity.graded(known)), toxicity.lexicon(known)
        held = sorted(int(np.isin(f, terms).sum()) for f, y in known if y)
        for i in np.flatnonzero(fold == k):
            f, y = rows[i]
            severity[i] = model.severity([sum(model.weights[x] for x in f)])[0]
            grade[i] = 1 + (np.isin(f, terms).sum() > held[(len(held) - 1) // 2]) if y else 0
    means = [severity[grade == g].mean() for g in (0, 1, 2)]
    flagged = severity >= toxicity.FLAG
    severe = severity >= toxicity.SEVERE
    print("mean severity by grade", np.round(means, 3), "toxic caught", round(flagged[grade > 0].mean(), 3), "clean flagged", round(flagged[grade == 0].mean(), 4), "severe found", round(severe[grade == 2].mean(), 3))
    assert means[0] < 0.1 < 0.4 < means[1] < 1 < means[2]
    assert flagged[grade > 0].mean() > 0.88 and flagged[grade == 0].mean() < 0.02
    assert severe[grade == 2].mean() > 0.75 and severe[grade == 1].mean() < 0.05
