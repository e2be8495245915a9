"""Corner cases that all operators on documents share: clashing columns, repeated rows, very long texts, an empty table."""

import pytest

from airlattice.llm import codes, decontam, jaccard, lm, merkle, mixing, quality, sharding, simhash, tokens, toxicity, urls

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
BASE = [(1, "the quick brown fox jumps over the lazy dog " * 9, "en", "a", 5), (2, "one two three four five six", "en", "b", 5), (2, "one two three four five six", "en", "b", 5), (3, LONG, "fr", "a", 9), (4, None, None, None, None), (5, "", "en", "a", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "slot", "shard", "node", "label", "n", "i", "key", "score", "word", "taken", "quality", "item_id", "text_hash", "leaf", "root", "severity", "tree", "digest", "held_out", "_text_hash", "_r", "_position")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog")], "item_id long, text string")


OPERATORS = {
    "lm": lambda s, d: lm.score(d),
    "tokens": lambda s, d: tokens.count(d),
    "sharding": lambda s, d: sharding.assign(d).select("doc_id", "size", "text_crc32", "shard"),
    "mixing": lambda s, d: mixing.taken(d).select("doc_id", "size", "source_size", "target", "taken"),
    "jaccard": lambda s, d: jaccard.classes(d).select("doc_id", "class_id", "class_size", "n_links"),
    "quality": lambda s, d: quality.judge(d, labels(s)).select("doc_id", "quality.*"),
    "decontam": lambda s, d: decontam.search(d, items(s)).select("doc_id", "item_id", "n_shared"),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "simhash": lambda s, d: simhash.near_copies(d),
    "merkle": lambda s, d: merkle.verify(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(spark, name):
    docs = spark.createDataFrame(BASE, SCHEMA)
    clash = docs.selectExpr("*", *[f"'x' as {c}" for c in CLASH])
    found, same = (sorted(map(repr, OPERATORS[name](spark, d).collect())) for d in (docs, clash))
    assert found == same
    if name != "decontam":
        assert len(found) == len(BASE)
    assert OPERATORS[name](spark, docs.where("false")).count() == 0


def test_pages_with_clashing_columns_and_repeats(spark):
    rows = [(1, "https://example.com/en/7/x"), (1, "https://example.com/en/7/x"), (2, "https://b.net/de/" + "a/" * 50_000), (3, None), (4, ""), (5, "no scheme")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    clash = pages.selectExpr("*", *[f"'x' as {c}" for c in ("host", "path", "rule", "verdict", "score", "threshold", "html")])
    out = [sorted(map(repr, urls.judge(d.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict").collect())) for d in (pages, clash)]
    assert out[0] == out[1] and len(out[0]) == len(rows)


def test_vectors_that_repeat(spark):
    rows = [(i % 7, [float(i % 7)] * 8, None) for i in range(40)]
    out = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == 40 and len({(r.vec_id, r.code, r.error) for r in out}) == 7
