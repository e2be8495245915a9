"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus [native].

Two multinomials over hashed word n-grams (words and pairs of adjacent words, in bucket ranges of their own) are counted:
one over every document (raw), one over four fifths of all documents that ``labels`` mark as good (target).
The target is smoothed with the raw multinomial as its prior, so an n-gram that the target has never seen counts against a
document, and the more so the more the corpus has of others. A document's score is the sum of its log ratios by its
number of words. The good documents left out of the target, and all bad ones, set the threshold: the cut that rejects the
fewest good documents and keeps the fewest bad ones, a good one weighing ``GOOD_WEIGHT`` bad ones. It decides every document.

All ratios are rounded to whole millionths before they are added, so sums don't depend on their order and
reruns agree. An input column named ``quality`` is replaced. Nulls: a null text is empty, and so fails the base rules; a null ``doc_id`` never meets a
label. A document that is labelled twice takes its lower label. Without labels of both kinds the method
keeps whatever passes the base rules. Repeated rows are decided alike. Other columns are left as they are.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.operators.statistics import running_sums

from .words import chain, hashes, text_of, words

#: Buckets of the n-grams of each length, and their greatest length (1 or 2).
BUCKETS, ORDER = 1 << 16, 2
#: Labels that are sent to all tasks at most; more of them meet their documents by shuffle.
SENT = 1_000_000
SYMBOLS = r"[#*$%&|<>]"
#: Weight of the raw multinomial in the target, as a share of the target's n-grams.
PRIOR = 0.02
#: Bad documents that may be kept for a good one that isn't rejected.
GOOD_WEIGHT = 20
#: Millionths in a nat.
MICRO = 1_000_000


def with_grams(df: DataFrame, text: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Adds _words, _hash (of words) and _grams (buckets of all n-grams: words in the first range, pairs in the second)."""
    df = df.withColumn("_words", words(text_of(text))).withColumn("_hash", hashes(F.col("_words")))
    place = lambda h, first: F.transform(h, lambda x: (F.pmod(x, F.lit(buckets)) + first).cast("int"))
    one = place(F.col("_hash"), 0)
    return df.withColumn("_grams", F.concat(one, place(chain(F.col("_hash"), F.col("_hash"), 1), buckets)) if order > 1 else one)


def symbols(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(SYMBOLS)).cast("long")


def labelled(labels: DataFrame) -> DataFrame:
    """(label_id, good, fits): all labelled documents; four fifths of the good ones fit the target, all others the threshold."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good")).where("good in (0, 1)")
    return one.withColumn("fits", (F.col("good") == 1) & (F.crc32(F.col("label_id").cast("string")) % 5 != 0))


def meet(docs: DataFrame, known: DataFrame, how: str, sent: int = SENT) -> DataFrame:
    """``docs`` (doc_id, text) with their labels, however many there are."""
    few = known.limit(sent + 1).count() <= sent
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known.hint("merge"), F.col("doc_id") == F.col("label_id"), how)


def log_ratios(raw: list[int], target: list[int]) -> list[int]:
    """Log ratio of each bucket in millionths; the target has the raw multinomial (with add-one smoothing) as its prior. Zeros where no target is known."""
    if not any(target):
        return [0] * len(raw)
    n_raw, n_target = sum(raw) + len(raw), sum(target)
    prior = PRIOR * n_target
    return [round(MICRO * log((t * n_raw / (r + 1) + prior) / (n_target + prior))) for t, r in zip(target, raw, strict=True)]


def ratios(docs: DataFrame, known: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """Log ratios of the buckets of words and, at order 2, of pairs."""
    marked = meet(docs, known.where("fits"), "left").withColumn("target", F.col("label_id").isNotNull().cast("long"))
    counts = (
        with_grams(marked, "text", order, buckets)
        .select(F.explode_outer("_grams").alias("bucket"), "target")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    )
    raw, target = [0] * (buckets * order), [0] * (buckets * order)
    found = counts.where("bucket is not null").toArrow()  # as many rows as buckets
    for b, r, t in zip(*(found[c].to_pylist() for c in ("bucket", "raw", "target")), strict=True):
        raw[b], target[b] = r, t
    out: list[int] = []
    for k in range(0, len(raw), buckets):
        out += log_ratios(raw[k : k + buckets], target[k : k + buckets])
    return out


def with_score(df: DataFrame, model: list[int]) -> DataFrame:
    """Adds llr_micro (sum of the ratios, bigint) and n_words to rows of ``with_grams``."""
    table = df.sparkSession.createDataFrame([(model,)], "model array<int>").scalar()
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get("_model", g))
    return df.withColumn("_model", table).withColumn("llr_micro", total).withColumn("n_words", F.size("_words").cast("long")).drop("_model")


def cut(good: list[int], bad: list[int]) -> int | None:
    """Least score to keep: the middle of the best gap between scores. None without scores of both kinds.

    For lists; ``fit_threshold`` finds the same over a table of any size.
    """
    if not good or not bad:
        return None
    scores = sorted(set(good) | set(bad))
    n_good, n_bad = len(good), len(bad)
    lost, kept = dict.fromkeys(scores, 0), dict.fromkeys(scores, 0)
    for s in good:
        lost[s] += 1
    for s in bad:
        kept[s] += 1
    best, least, rejected, passed = scores[0], 1.0, 0, n_bad  # keep all
    for s, after in zip(scores, scores[1:]):
        rejected, passed = rejected + lost[s], passed - kept[s]
        loss = (GOOD_WEIGHT * rejected / n_good + passed / n_bad)
        if loss < least:
            best, least = (s + after) // 2 + 1, loss
    return best


def fit_threshold(docs: DataFrame, known: DataFrame, model: list[int], order: int = ORDER, buckets: int = BUCKETS) -> int | None:
    """Least mean score of a word, in millionths, that is kept; from all labelled documents that the target hasn't seen.

    Documents are counted by score, and the counts summed up in the order of scores, by ranges.
    """
    scored = with_score(with_grams(meet(docs, known.where("not fits"), "inner"), "text", order, buckets), model).where("n_words > 0")
    # One score a label: a document that is repeated counts once.
    by = scored.groupBy("label_id", "good").agg(F.min(F.floor(F.col("llr_micro") / F.col("n_words"))).alias("score"))
    per = by.groupBy("score").agg(F.sum((F.col("good") == 1).cast("long")).alias("lost"), F.sum((F.col("good") != 1).cast("long")).alias("kept"))
    sums = running_sums(per, [F.col("score")], {"lost": "rejected", "kept": "refused"})
    n_good, n_bad, least, most = sums.agg(F.max("rejected"), F.max("refused"), F.min("score"), F.max("score")).first()
    if not n_good or not n_bad:
        return None
    loss = GOOD_WEIGHT * F.col("rejected") / F.lit(n_good) + (F.lit(n_bad) - F.col("refused")) / F.lit(n_bad)
    best = sums.where(F.col("score") < most).select(loss.alias("loss"), "score").where("loss < 1").agg(F.min(F.struct("loss", "score")).alias("b")).first()["b"]
    if best is None:  # keep all
        return least
    after = sums.where(F.col("score") > best["score"]).agg(F.min("score")).first()[0]
    return (best["score"] + after) // 2 + 1


def base_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows of ``with_grams`` with n_words.

    n_repeat_words counts the words covered by three-word windows whose 64-bit hash occurs twice or more. The hashes
    that do are found in the sorted windows. Where they are few, each window is looked up among them; where they
    are many, windows are sorted with their positions instead.
    """
    lines = F.filter(F.split(text_of(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_window", chain(chain(F.col("_hash"), F.col("_hash"), 1), F.col("_hash"), 2)).withColumn("_lines", lines)
    df = df.withColumn("_sorted", F.sort_array("_window"))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, j: h == F.get("_sorted", j + 1))))
    few = F.array_compact(F.transform("_window", lambda h, i: F.when(F.array_contains("_twice", h), i)))
    df = df.withColumn("_keyed", F.when(F.size("_twice") > 64, F.sort_array(F.transform("_window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_keyed", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_keyed", j + 1)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter("_keyed", same), lambda x: x["i"]))
    df = df.withColumn("_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 64, few).otherwise(many))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": symbols(text),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """``docs`` with a struct column ``quality``: the base counts, base_failed, score, threshold and kept."""
    known = labelled(labels)
    model = ratios(docs, known, buckets, order)
    least = fit_threshold(docs, known, model, order, buckets)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"]).alias("_row"), F.col("text").alias("_text"))
    out = base_columns(with_score(with_grams(own, "_text", order, buckets), model), "_text")
    passes = F.lit(True) if least is None else (F.col("llr_micro") >= least * F.col("n_words"))
    score = F.col("llr_micro") / F.when(F.col("n_words") > 0, F.col("n_words")) / MICRO
    fields = [F.col(c) for c in BASE] + [score.alias("score"), F.lit(None if least is None else least / MICRO).cast("double").alias("threshold"), (~F.col("base_failed") & passes).alias("kept")]
    return out.select("_row", F.struct(*fields).alias("quality")).select("_row.*", "quality")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    The row number has no meaning: a filter that needs it can't be pushed into the projections below, where it would
    spell out every array expression many times over.
    """
    judged = judge(docs, labels, **options).withColumn("_row_number", F.monotonically_increasing_id())
    return judged.where(F.col("quality.kept") & (F.col("_row_number") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
