"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. ``labels`` say only toxic or not, so the third grade comes from
evidence beside them and beside the model: the labelled documents are halved by hash, each half yields a lexicon of
features that its toxic documents hold more often than chance allows, and a toxic document of the *other* half is severe if
it holds more of them than the median toxic document does. Where all hold the same number, there is no third grade and
one cut is fitted. One weight vector serves every threshold: the probability of a grade
above k is logistic(score - cut_k) with cut_0 < cut_1, and the expected severity is the sum of these probabilities.
Each distinct word of a text gives two hashed features: the word, lower-cased and without punctuation at its ends, and
its first four bytes. The score is the sum of their weights over the distinct words, so length alone adds nothing.

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` of least hash of each kind). A feature gets a
weight if the documents that hold it differ in their share of toxic ones from the sample's by more than chance: the
Chernoff bound on such a share, over as many features as the sample has, is below one. The weights, of either sign, and
the cuts are those of the greatest likelihood with a ridge.

Every document is scored over its whole text. Nulls and empty texts have the severity of a text without features.
A null ``doc_id`` meets no label. A document that is labelled twice takes its higher label; other labels are ignored. A doc_id that several documents share brings one of them to the
sample. Without labels of both kinds every severity is 0. Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.session import ship

from .hashing import WordIds, texts

BITS, SAMPLE = 18, 4_000
EPOCHS, RATE, RIDGE = 400, 0.3, 1e-3
#: The second cut lies at most so far above the first.
FURTHEST = 8.0
PREFIX = 4
#: Expected severities from which a document counts as toxic, and as of grade 2.
FLAG, SEVERE = 0.2, 1.5
PUNCTUATION = b".,;:!?()[]{}\"'*#$%&|<>-_~`^=+/\\"


class Features(dict):
    """The two features of a word, remembered up to a bound; None for words of punctuation only."""

    def __init__(self):
        self.ids = WordIds()

    def __missing__(self, word: bytes) -> tuple[int, int] | None:
        if len(self) >= 1_000_000:
            self.clear()
        core = word.lower().strip(PUNCTUATION)
        self[word] = pair = (self.ids[core] >> (64 - BITS), self.ids[core[:PREFIX] + b"~"] >> (64 - BITS)) if core else None
        return pair

    def of(self, text: bytes) -> set[int]:
        return {int(f) for w in set(text.split()) if (pair := self[w]) for f in pair}


class Weights(dict):
    """The weighted features of a word, remembered up to a bound; most words have none."""

    def __init__(self, dense: np.ndarray):
        self.dense, self.features = dense, Features()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 1_000_000:
            self.clear()
        pair = self.features.__missing__(word)
        self.features.clear()
        self[word] = own = tuple(int(f) for f in pair if self.dense[f]) if pair else ()
        return own

    def of(self, text: bytes) -> float:
        """Sum of the weights of a text's distinct features; fsum doesn't depend on their order."""
        found = {f for own in map(self.__getitem__, set(text.split())) if own for f in own}
        return fsum(self.dense[f] for f in found)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights shared by both thresholds, and the cuts."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def severity(self, score: np.ndarray) -> np.ndarray:
        return logistic(np.asarray(score)[:, None] - self.cuts).sum(axis=1)


def gradients(w: np.ndarray, cuts: np.ndarray, doc: np.ndarray, col: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the mean negative log likelihood, by weights and by cuts, and its value; feature ``col`` is in document ``doc``."""
    n, at = len(y), np.arange(len(y))
    score = np.bincount(doc, w[col], minlength=n)
    above = np.column_stack([np.ones(n), logistic(score[:, None] - cuts), np.zeros(n)])
    p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
    slope = above * (1 - above)  # of each cumulative probability by the score
    hi, lo = slope[at, y], slope[at, y + 1]
    d = -(hi - lo) / p / n
    # Cut k bounds grade k from above and grade k + 1 from below.
    gc = np.array([np.sum(((y == k + 1) * hi - (y == k) * lo) / p) / n for k in (0, 1)])
    return np.bincount(col, d[doc], minlength=len(w)), gc, float(-np.log(p).mean())


def telling(held: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Features whose documents (``held``, of them ``toxic``) are toxic more or less often than by chance at ``share``."""
    q = toxic / held
    with np.errstate(divide="ignore", invalid="ignore"):
        far = held * (np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0))
    return np.flatnonzero(far > log(len(held)))


def descend(doc: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by full-batch Adam."""
    w, cuts = np.zeros(n_features), np.array([0.0, 1.0])
    m, v = [np.zeros_like(w), np.zeros(2)], [np.zeros_like(w), np.zeros(2)]
    for epoch in range(1, EPOCHS + 1):
        gw, gc, _ = gradients(w, cuts, doc, col, y)
        for i, (x, g) in enumerate(((w, gw + RIDGE * w), (cuts, gc))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            x -= RATE / (1 + epoch / 60) * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-9)
        cuts[1] = min(max(cuts[1], cuts[0] + 1e-3), cuts[0] + FURTHEST)
    return w, cuts


def fit(rows: list[tuple[np.ndarray, int]]) -> Ordinal | None:
    """From features (distinct, as numbers) and grades."""
    y = np.array([g for _, g in rows], int)
    if not (y == 0).any() or not (y > 0).any():
        return None
    doc = np.repeat(np.arange(len(rows)), [len(found) for found, _ in rows])
    features, col = np.unique(np.concatenate([found for found, _ in rows]), return_inverse=True)
    dense = np.zeros(1 << BITS)
    chosen = telling(np.bincount(col), np.bincount(col, y[doc] > 0), (y > 0).mean()) if len(col) else np.zeros(0, int)
    place = np.full(len(features), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[col] >= 0
    w, cuts = descend(doc[kept], place[col[kept]], y, len(chosen))
    dense[features[chosen]] = w
    return Ordinal(dense, cuts)


def lexicon(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Features that toxic documents hold more often than by chance."""
    if not rows:
        return np.zeros(0, np.int32)
    y = np.array([t for _, t in rows])
    features, col = np.unique(np.concatenate([found for found, _ in rows]), return_inverse=True)
    if not len(features) or not y.any() or y.all():
        return np.zeros(0, np.int32)
    held, toxic = np.bincount(col), np.bincount(col, np.repeat(y, [len(found) for found, _ in rows]))
    chosen = telling(held, toxic, y.mean())
    return features[chosen[toxic[chosen] / held[chosen] > y.mean()]]


def graded(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """Grades from features and labels of toxicity: how much of the other half's lexicon a toxic document holds."""
    half = [zlib.crc32(found.tobytes()) % 2 for found, _ in rows]
    known = [lexicon([r for r, h in zip(rows, half, strict=True) if h != k]) for k in (0, 1)]
    n = [int(np.isin(found, known[h]).sum()) if toxic else 0 for (found, toxic), h in zip(rows, half, strict=True)]
    toxic = sorted(c for c, (_, t) in zip(n, rows, strict=True) if t)
    middle = toxic[(len(toxic) - 1) // 2] if toxic else 0
    return [(found, (1 + (c > middle)) if t else 0) for (found, t), c in zip(rows, n, strict=True)]


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[tuple[np.ndarray, int]]:
    """Features and grades of at most ``limit`` labelled documents of each kind, those of least hash; one document a label."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    pick = lambda known: one.where(known).orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    known = docs.select("doc_id", "text").join(F.broadcast(pick("y > 0").unionAll(pick("y = 0"))), F.col("doc_id") == F.col("label_id"))
    known = known.groupBy("label_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features.of(t)) for t in texts(batch, "text")], pa.list_(pa.int32())), batch.column("y")], ["f", "y"])

    rows = known.select("text", "y").mapInArrow(run, "f array<int>, y int").toArrow()
    # Copies of a text would each count as evidence; the order of rows must not show in the sums.
    found: set[tuple[bytes, int]] = set()
    for chunk in rows.to_batches():
        flat, at = chunk["f"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(chunk["f"].value_lengths().to_numpy())])
        found.update((flat[a:b].tobytes(), y) for a, b, y in zip(at[:-1], at[1:], chunk["y"].to_pylist(), strict=True))
    return graded([(np.frombuffer(f, np.int32), y) for f, y in sorted(found)])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), grade (0 below FLAG, 2 from SEVERE on) and toxic of every document."""
    ship(docs.sparkSession)
    model = fit(sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.weights) if model else None
        for batch in batches:
            if weights is None:
                severity = np.zeros(batch.num_rows)
            else:
                severity = model.severity([weights.of(t) for t in texts(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(severity, 9))], ["doc_id", "severity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double")
    toxic = F.col("severity") >= FLAG
    return out.withColumn("grade", F.when(F.col("severity") >= SEVERE, 2).when(toxic, 1).otherwise(0)).withColumn("toxic", toxic)
