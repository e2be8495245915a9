"""Mixing sources to target weights by pivotal dependent rounding.

Each source's share of all words gives it a target; a source holds at most ``CAP`` times its words, and the
excess goes to the others by weight. Every document of a source is then expected ``target / source_size``
times. The whole part of that number is taken at once; the fraction is rounded by the pivotal method: two
documents with fractional mass meet, and mass moves at random from one to the other, with odds that keep both
expectations, until one of them is taken or left. The mass of a source never changes, so its words end within
one document of its target.

Rounding runs as a reduction tree: documents meet in groups of about ``GROUP`` of one source, each group passes
its one unfinished document up, and ``FAN`` groups meet at the next level, until a source has one left. A hot
source merely has more groups. Groups are dealt by hash and the random numbers are seeded by group, so reruns agree.

Nulls: a null text has no words, a null source is a source of its own, last in order; a null ``doc_id`` is a
value. Repeated rows are rounded each by itself: they are counted first and numbered from their counts, so they are
spread over the groups as any other documents, however many there are. An empty table gives no rows. A document without
words is taken 0 words. Input columns named like an output column are replaced; ``mix`` needs columns that can be hashed
(no maps).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.session import shared_dir

from .words import text_of

WEIGHTS = (5, 2, 1)
CAP = 3
GROUP, FAN = 512, 64
#: Sources up to which the table of targets is sent to every task (some 40 bytes each).
FEW_SOURCES = 100_000
#: Equal rows that one step numbers or copies at a time.
BLOCK = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(mix_source, source_size, n_docs, target) from rows with source and size.

    The targets fill up like water: weight times a level, or ``cap`` times the size where that is less. The level
    follows from running sums over the sources by rising ratio of cap to weight. Both windows order the table of
    sources, not of documents.
    """
    by = sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    by = by.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("_cap", F.col("source_size") * float(cap))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("mix_source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), zero)
    by = by.withColumn("_level", left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), zero)))
    free = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    by = by.withColumn("_free", F.first(free, ignorenulls=True).over(whole))
    return by.select("mix_source", "source_size", "n_docs", F.least(F.col("_cap"), F.coalesce(F.col("_free") * F.col("_w"), F.col("_cap"))).alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, seed: list[int], last: bool) -> np.ndarray:
    """Copies of fractional documents, rounded so that the sum of size * p stays; all but one end at 0 or 1, with ``last`` that one too."""
    rng = np.random.default_rng(seed)
    u = rng.random(len(p) + 1)
    out, held, mass = np.zeros(len(p)), -1, 0.0
    for j in range(len(p)):
        own, got = float(size[j]), float(size[j]) * float(p[j])
        if held < 0:
            held, mass = j, got
            continue
        room = float(size[held])
        up, down = min(room - mass, got), min(mass, own - got)  # to the held one; from it
        if u[j] * (up + down) < down:
            mass, got, full, none = mass + up, got - up, room - mass <= got, got <= room - mass
            if full:  # the held one is taken
                out[held] = 1
                held, mass = (-1, 0.0) if none else (j, got)
            else:  # the other one is left
                out[j] = 0
        else:
            mass, got, full, none = mass - down, got + down, own - got <= mass, mass <= own - got
            if full:  # the other one is taken
                out[j] = 1
                if none:
                    out[held], held, mass = 0, -1, 0.0
            else:  # the held one is left
                out[held] = 0
                held, mass = j, got
    if held >= 0:
        q = min(max(mass / float(size[held]), 0.0), 1.0)
        out[held] = float(u[-1] < q) if last else q
    return out


def _level(level: int, last: bool):
    def rounded(group: pa.Table) -> pa.Table:
        # Large documents meet first, so that what is left over at the end is small.
        at = np.lexsort((group["mix_key"].to_numpy(), -group["size"].to_numpy()))
        group = group.take(pa.array(at))
        seed = [level, int(group["mix_seed"][0].as_py()), int(group["mix_group"][0].as_py())]
        p = pivot(group["size"].to_numpy(), group["mix_p"].to_numpy(), seed, last)
        return group.set_column(group.schema.get_field_index("mix_p"), "mix_p", pa.array(p))

    return rounded


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with mix_key changed to differ among equal rows: those are counted where they lie, then dealt out by number in blocks."""
    names = rows.columns
    n = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("mix_n"))
    last = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x))
    blocks = n.select(*names, "mix_n", last(F.floor((F.col("mix_n") - 1) / BLOCK)).alias("mix_block"))
    each = blocks.select(*names, "mix_block", last(F.least(F.lit(BLOCK - 1), F.col("mix_n") - F.col("mix_block") * BLOCK - 1)).alias("mix_nth"))
    return each.select(*[c for c in names if c != "mix_key"], F.xxhash64("mix_key", "mix_block", "mix_nth").alias("mix_key"), F.col("mix_key").alias("mix_row"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (with source, size and mix_key, a hash) with source_size, target, copies and mix_row (the given mix_key)."""
    spark = rows.sparkSession
    shared_dir(spark)
    rows = numbered(rows).checkpoint()  # the texts are read once
    goal = targets(rows, weights, cap).checkpoint()
    stats = goal.agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("most")).first()
    side = F.broadcast(goal) if stats.n <= FEW_SOURCES else goal
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.floor(q)).otherwise(F.lit(0).cast("long"))
    rows = rows.join(side, rows["source"].eqNullSafe(goal["mix_source"])).drop("mix_source")
    rows = rows.withColumn("mix_whole", whole).withColumn("mix_p", F.when(F.col("size") > 0, q - F.floor(q)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("mix_seed", F.crc32(F.coalesce("source", F.lit("\x00"))))
    # Rounding errors leave a source that is taken once, or CAP times, with a hair of mass more or less.
    near = F.round("mix_p", 12)
    rows = rows.withColumn("mix_whole", F.col("mix_whole") + (near >= 1).cast("long")).withColumn("mix_p", F.when((near <= 0) | (near >= 1), 0.0).otherwise(F.col("mix_p")))
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP), F.lit(1))
    rows = rows.withColumn("mix_group", F.pmod(F.col("mix_key"), groups)).drop("n_docs")
    done, level, most = [rows.where("mix_p = 0")], 0, -(-(stats.most or 1) // GROUP)
    todo = rows.where("mix_p > 0")
    while True:
        out = todo.groupBy("mix_seed", "source", "mix_group").applyInArrow(_level(level, most <= 1), todo.schema).checkpoint()
        if most <= 1:
            done.append(out)
            break
        done.append(out.where("mix_p in (0, 1)"))
        todo = out.where("mix_p not in (0, 1)").withColumn("mix_group", F.floor(F.col("mix_group") / FAN))
        level, most = level + 1, -(-most // FAN)
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x.select(out.columns))
    return out.withColumn("copies", (F.col("mix_whole") + F.col("mix_p")).cast("long")).drop("mix_whole", "mix_p", "mix_seed", "mix_group")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and mix_key of every document."""
    t = text_of("text")
    return docs.select("doc_id", "source", word_count(t).alias("size"), F.xxhash64("doc_id", t, "source").alias("mix_key"))


def taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words) of every document."""
    out = plan(keyed(docs), weights, cap)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, with the columns of ``docs``.

    Rows are numbered among those of equal doc_id, text and source, as the plan numbers them; rows that are equal in all
    columns are one row with the sum of their copies. Rows of many copies are dealt out in blocks before they are written.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64("doc_id", text_of("text"), "source").alias("mix_key")
    own = docs.select(F.struct(*names).alias("mix_doc"), F.xxhash64(*names).alias("mix_row"), key)
    alike = own.groupBy("mix_key", "mix_row").agg(F.count(F.lit(1)).alias("mix_n"))
    upto = F.sum("mix_n").over(Window.partitionBy("mix_key").orderBy("mix_row").rowsBetween(Window.unboundedPreceding, 0))
    spans = alike.select("mix_key", "mix_row", (upto - F.col("mix_n")).alias("mix_a"), (upto - 1).alias("mix_b"))
    blocks = spans.select("*", F.explode(F.sequence(F.floor(F.col("mix_a") / BLOCK), F.floor(F.col("mix_b") / BLOCK))).alias("mix_block"))
    base = F.col("mix_block") * BLOCK
    nth = F.explode(F.sequence(F.greatest("mix_a", base) - base, F.least(F.col("mix_b"), base + BLOCK - 1) - base)).alias("mix_nth")
    each = blocks.select("mix_key", "mix_row", "mix_block", nth).select("mix_row", F.xxhash64("mix_key", "mix_block", "mix_nth").alias("mix_key"))
    due = each.join(plan(keyed(docs), weights, cap).select("mix_key", "copies"), "mix_key").groupBy("mix_row").agg(F.sum("copies").alias("copies")).where("copies > 0")
    met = own.select("mix_doc", "mix_row").dropDuplicates(["mix_row"]).join(due, "mix_row")
    copy = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("mix_copy")
    few = met.where(F.col("copies") <= BLOCK).select("mix_doc", copy(F.col("copies")))
    blocks = met.where(F.col("copies") > BLOCK).select("mix_doc", "mix_row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))).alias("mix_block"))
    many = blocks.repartition("mix_row", "mix_block").select("mix_doc", copy(F.least(F.lit(BLOCK).cast("long"), F.col("copies") - F.col("mix_block") * BLOCK)))
    return few.unionAll(many).select("mix_doc.*")
