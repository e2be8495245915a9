"""Merkle manifest of a dataset: every document's proof against one root, from parent preimages.

A document is a leaf, the digest of its columns. Per source, leaves are numbered in the order of doc_id; every three
consecutive nodes are one parent, whose *preimage* is their digests side by side and whose digest is that of its preimage.
Sources' roots, in order, form a tree of the same kind above.

Up: ``BAND`` levels are built at a time. Nodes are grouped into blocks of 3**BAND, so a shuffle serves several levels and
a source of any size spreads over its blocks; a block keeps the preimages of its levels and hands its one top node to the
next band. Down: from the last band to the leaves, blocks join the ancestors of their top node, and each member adds
those within the block. A leaf then has its ancestors' preimages and its slot in each: cutting its own 64 characters out
leaves its siblings (the proof); putting another digest there folds a changed leaf up to a root.

Order: sources by code point with null first; leaves by doc_id (null first), then by leaf, so repeated rows are leaves of
their own and alike. Nulls: any column may be null and is encoded as ``-``; a null doc_id is never tampered with. An
empty table gives no rows. Other columns are ignored. Depth grows with the logarithm of a source's size, the driver
sees only whether another band is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.operators.segments import numbered
from airlattice.session import shared_dir

#: Children of a node, levels built in one shuffle, and characters of a digest.
WAYS, BAND, DIGEST = 3, 6, 64
BLOCK = WAYS**BAND
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ANCESTOR = "struct<preimage:string,slot:int>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def encoded(c: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(text: Column) -> Column:
    return digest(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in COLUMNS]))


def tampered_text() -> Column:
    """The text as a tamperer leaves it: without newlines where 2 divides the checksum of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def height(n: Column) -> Column:
    """Levels above n nodes of which each has WAYS children at most."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(33)), lambda k: F.pow(F.lit(float(WAYS)), k) < n))


def preimages(kids: Column, levels: Column) -> Column:
    """Of nodes in order: the preimages of their parents, grandparents and so on, an array for each level."""

    def level(below: Column, digest_of) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / WAYS).cast("int"))
        return F.transform(runs, lambda k: F.array_join(F.transform(F.slice(below, k * WAYS + 1, F.lit(WAYS)), digest_of), ""))

    first = level(kids, lambda kid: kid["digest"])
    rest = F.slice(F.sequence(F.lit(2), F.lit(BAND)), F.lit(1), F.greatest(levels - 1, F.lit(0)))
    grown = F.aggregate(rest, F.array(first), lambda done, _: F.concat(done, F.array(level(F.element_at(done, -1), digest))))
    return F.when(levels == 0, F.array().cast("array<array<string>>")).otherwise(grown)


def up(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each band, from (tree, n, i, digest, payload), and the root of each tree (tree, root)."""
    bands, roots = [], None
    while True:
        kid = F.struct("i", "digest", *payload)
        blocks = nodes.groupBy("tree", "n", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        blocks = blocks.withColumn("preimages", preimages(F.col("kids"), F.least(F.lit(BAND), height(F.col("n"))))).checkpoint()
        bands.append(blocks)
        top = F.when(F.size("preimages") == 0, F.col("kids")[0]["digest"]).otherwise(digest(F.element_at("preimages", -1)[0]))
        tops = blocks.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("i"), top.alias("digest"))
        ended = tops.where("n = 1").select("tree", F.col("digest").alias("root"))
        roots = ended if roots is None else roots.unionAll(ended)
        nodes, payload = tops.where("n > 1"), []
        if nodes.isEmpty():
            return bands, roots


def own_ancestors() -> Column:
    """Of a kid of a block: its parent's preimage within the block and its slot there, its grandparent's, and so on."""
    place = F.col("kid.i") % BLOCK
    step = lambda level: F.pow(F.lit(float(WAYS)), level).cast("long")
    pick = lambda p, level: F.struct(F.element_at(p, (F.floor(place / step(level + 1)) + 1).cast("int")).alias("preimage"), (F.floor(place / step(level)) % WAYS).cast("int").alias("slot"))
    return F.transform("preimages", pick).cast(f"array<{ANCESTOR}>")


def down(bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, kid, ancestors, subroot, root) of every node of the first band; ``tops`` (tree, above, subroot, root) says what is above each tree."""
    known = [F.col("known.tree") == F.col("b.tree"), F.col("known.block") == F.col("b.block")]
    above = None
    for blocks in reversed(bands):
        tree_tops = blocks.where(F.col("n") <= BLOCK).select("tree", "block").join(tops, "tree")
        above = tree_tops if above is None else above.unionByName(tree_tops)
        # One row a block on both sides.
        met = blocks.alias("b").join(above.alias("known"), known).select("b.tree", "kids", "preimages", "above", "subroot", "root")
        kids = met.select("tree", F.explode("kids").alias("kid"), "preimages", "above", "subroot", "root")
        kids = kids.select("tree", "kid", F.concat(own_ancestors(), F.col("above")).alias("ancestors"), "subroot", "root")
        above = kids.select("tree", F.col("kid.i").alias("block"), F.col("ancestors").alias("above"), "subroot", "root")
    return kids


def siblings(a: Column) -> Column:
    """A preimage without the slot's own digest."""
    return F.concat(F.substr(a["preimage"], F.lit(1), a["slot"] * DIGEST), F.substr(a["preimage"], (a["slot"] + 1) * DIGEST + 1))


def replaced(a: Column, by: Column) -> Column:
    """A preimage with another digest in the slot."""
    return F.concat(F.substr(a["preimage"], F.lit(1), a["slot"] * DIGEST), by, F.substr(a["preimage"], (a["slot"] + 1) * DIGEST + 1))


def fold(leaf: Column, ancestors: Column) -> Column:
    """The root that a leaf leads to, given its siblings."""
    return F.aggregate(ancestors, leaf, lambda h, a: digest(replaced(a, h)))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, changed, ancestors, subroot, root) of every document; ``changed`` is the leaf of the ``tampered`` text.

    Texts are read once and turned into digests at once; nothing else is shuffled.
    """
    shared_dir(docs.sparkSession)
    # A tree's name sorts as its source does, with null first, and is never null.
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    text = F.col("text")
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_of(text).alias("digest"), leaf_of(text if tampered is None else tampered).alias("changed")).checkpoint()
    bands, subroots = up(numbered(leaves, ["tree"], ["doc_id", "digest"]), ["doc_id", "changed"])
    # Above the sources' roots stands one more tree.
    named = numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["all"], ["name"]).withColumnRenamed("all", "tree")
    high, root = up(named, ["name"])
    none = F.array().cast(f"array<{ANCESTOR}>")
    paths = down(high, root.select("tree", none.alias("above"), F.lit("").alias("subroot"), "root"))
    tops = paths.select(F.col("kid.name").alias("tree"), F.col("ancestors").alias("above"), F.col("kid.digest").alias("subroot"), "root").checkpoint()
    source = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return down(bands, tops).select(source.alias("source"), "kid.doc_id", F.col("kid.digest").alias("leaf"), "kid.changed", "ancestors", "subroot", "root")


def verify(docs: DataFrame) -> DataFrame:
    """The proof of every document, and whether its tampered copy still verifies."""
    proof = digest(F.array_join(F.transform("ancestors", siblings), ""))
    folded = fold(F.col("changed"), F.col("ancestors"))
    out = manifest(docs, tampered_text()).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Checksums, leaves, both trees by recursion, and each leaf's ancestors folded as lists.
SQL = r"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS k, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree FROM documents),
c AS (SELECT *, doc_id IS NOT NULL AND list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda j: CAST(ascii(k[j]) AS BIGINT))),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) & 1 = 1 AS hit FROM d),
e AS (SELECT doc_id, tree, coalesce(strlen(k) || ':' || k, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS other FROM c),
l AS MATERIALIZED (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM e),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
u AS (SELECT tree, 0 AS lvl, i, leaf AS h, n FROM n
  UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(n / 3.0) AS BIGINT) FROM u WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
s AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j, count(*) OVER () AS m FROM u WHERE n = 1),
v AS (SELECT 0 AS lvl, j AS i, subroot AS h, m AS n FROM s
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(n / 3.0) AS BIGINT) FROM v WHERE n > 1 GROUP BY lvl, i // 3, n),
p AS (SELECT tree, lvl, i // 3 AS parent, string_agg(h, '' ORDER BY i) AS pre FROM u WHERE n > 1 GROUP BY tree, lvl, i // 3),
q AS (SELECT lvl, i // 3 AS parent, string_agg(h, '' ORDER BY i) AS pre FROM v WHERE n > 1 GROUP BY lvl, i // 3),
a AS (SELECT n.tree, n.i, p.lvl, pre, CAST((n.i // CAST(pow(3, p.lvl) AS BIGINT)) % 3 AS INTEGER) AS slot FROM n JOIN p ON n.tree = p.tree AND p.parent = n.i // CAST(pow(3, p.lvl + 1) AS BIGINT)
  UNION ALL SELECT n.tree, n.i, 1000 + q.lvl, pre, CAST((s.j // CAST(pow(3, q.lvl) AS BIGINT)) % 3 AS INTEGER) FROM n JOIN s USING (tree) JOIN q ON q.parent = s.j // CAST(pow(3, q.lvl + 1) AS BIGINT)),
f AS (SELECT tree, i, string_agg(substr(pre, 1, slot * 64) || substr(pre, slot * 64 + 65), '' ORDER BY lvl) AS sib, list({'p': pre, 's': slot} ORDER BY lvl) AS up FROM a GROUP BY tree, i),
r AS (SELECT n.doc_id, leaf, subroot, (SELECT h FROM v WHERE n = 1) AS root, sha256(coalesce(sib, '')) AS proof_sha256,
  list_reduce(list_prepend({'p': changed, 's': 0}, coalesce(up, [])), lambda x, y: {'p': sha256(substr(y.p, 1, y.s * 64) || x.p || substr(y.p, y.s * 64 + 65)), 's': 0}).p AS folded_root
  FROM n JOIN s USING (tree) LEFT JOIN f USING (tree, i))
SELECT *, folded_root = root AS verified FROM r
"""
