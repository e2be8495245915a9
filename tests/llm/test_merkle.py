"""The manifest against one written plainly over lists, with planted corner cases."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airlattice.llm import merkle, registry
from oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, text):
    return sha(enc(doc[0]) + enc(doc[3]) + enc(doc[2]) + enc(doc[4]) + enc(text))


def tree(nodes):
    """Root, and for each node the (run, slot) pairs up to it."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            path.append((level[i - i % 3 : i - i % 3 + 3], i % 3))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(docs):
    by = defaultdict(list)
    for d in docs:
        by[d[3]].append(d)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = {}
    for s in names:
        rows = sorted(by[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        parts[s] = (rows, *tree([leaf(d, d[1]) for d in rows]))
    root, tops = tree([parts[s][1] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        rows, subroot, paths = parts[s]
        for d, path in zip(rows, paths, strict=True):
            path = path + top
            text = d[1]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf(d, text)
            for run, slot in path:
                h = sha("".join(run[:slot] + [h] + run[slot + 1 :]))
            proof = sha("".join(x for run, slot in path for j, x in enumerate(run) if j != slot))
            out.append((d[0], leaf(d, d[1]), subroot, root, proof, h, h == root))
    return sorted(out, key=repr)


def found(spark, docs, schema=SCHEMA):
    return sorted((tuple(r) for r in merkle.verify(spark.createDataFrame(docs, schema)).collect()), key=repr)


def doc(i, text="a b\nc", source="s", lang="en", n=5):
    return (i, text, lang, source, n)


def test_shapes_nulls_ties_and_long_texts(spark):
    docs = [doc(i, f"line {i}\nend") for i in range(30)]  # ten runs, then four, two and one
    docs += [doc(i, source="é") for i in range(100, 104)] + [doc(200, source="z")] + [doc(300, source=""), doc(301, source=None), doc(302, source=None)]
    docs += [doc(7, "line 7\nend"), doc(7, "line 7\nend"), doc(7, "other")]  # repeated rows and a tie
    docs += [doc(None), doc(None, None), doc(12, None), doc(400, "", lang=None, n=None), doc(401, "x\n" * 200_000, source="big")]
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 729, 730, 2200])
def test_sizes_around_powers_of_three_and_blocks(spark, n):
    docs = [doc(i, f"t{i}\n") for i in range(n)]
    assert found(spark, docs) == plain(docs)


def test_many_sources(spark):
    docs = [doc(i, f"t{i}\n", source=f"s{i % 760}") for i in range(1000)]
    assert found(spark, docs) == plain(docs)


def test_extra_columns_and_empty_table(spark):
    docs = [doc(i) for i in range(5)]
    extra = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA + ", leaf string, i int, root string")
    assert sorted((tuple(r) for r in merkle.verify(extra).collect()), key=repr) == plain(docs)
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_change_is_seen(spark):
    docs = spark.createDataFrame([doc(i, source=f"s{i % 4}") for i in range(40)], SCHEMA)
    for text in (F.concat("text", F.lit(" ")), F.lit(None).cast("string"), F.upper("text")):
        rows = merkle.manifest(docs, text).select((merkle.fold(F.col("changed"), F.col("ancestors")) == F.col("root")).alias("same")).collect()
        assert len(rows) == 40 and not any(r.same for r in rows)


def test_query_matches_sql(spark, sf):
    assert compare(spark, sf, "op13_merkle_manifest", registry.queries()["op13_merkle_manifest"], registry.oracle_sql()["op13_merkle_manifest"]) == 200
