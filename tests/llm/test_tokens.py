import random

import pytest

from airlattice.llm import tokens

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = tokens.vocabulary_path()
    lib = tokenizers.Tokenizer.from_file(path)
    return tokens.Counter(path), lambda t: len(lib.encode(t, add_special_tokens=False).ids)


def test_random_texts(pair):
    mine, lib = pair
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "!", "é", "日本", "1", "23", "\u00a0", "\u3000", "<|endoftext|>", "\t", "😀", "ing", "'ll", "\x1c", "\x85", "²", "\u0301", "x" * 50]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert mine.tokens(t) == lib(t), t


def test_long_texts(pair):
    mine, lib = pair
    for t in ("a" * 3000, " " * 700, "ab " * 50000, "\n a" * 30000, "é" * 2000, "word\n" * 20000):
        assert mine.tokens(t) == lib(t)


def test_composition_is_associative(pair):
    mine, _ = pair
    rng = random.Random(2)
    for _ in range(300):
        a, b, c = ("".join(rng.choice(["ab", " ", "\n", "x", "  ", "'s", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(3))
        f = lambda m: m[1] + mine.piece(m[0]) + (mine.piece(m[2]) if m[2] is not None else 0)
        x, y, z = map(mine.chunk, (a, b, c))
        assert f(mine.compose(mine.compose(x, y), z)) == f(mine.compose(x, mine.compose(y, z)))


def test_small_chunks(pair, monkeypatch):
    mine, lib = pair
    monkeypatch.setattr(tokens, "CHUNK", 7)
    for t in ("one two  three\n four's five", "nospacesatallhere" * 3, "a  b   c d'll e", "\n\n x y z "):
        assert mine.ordinary(t) == lib(t)


def test_bounds_of_memory(pair, monkeypatch):
    _, lib = pair
    monkeypatch.setattr(tokens, "STATES", 50)
    monkeypatch.setattr(tokens, "PIECES", 10)
    mine = tokens.Counter(tokens.vocabulary_path())
    t = "bounded memory must not change any count of tokens whatever the words are " * 20
    assert mine.tokens(t) == lib(t)


def test_table(spark, sf, pair):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count(docs).collect():
        n = pair[1](texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2)], "doc_id long, text string, n_tokens int")
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count(odd).collect()) == [(0, 0, False)] * 2
