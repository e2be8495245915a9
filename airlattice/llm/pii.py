"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns give the base spans (email, ip, card, phone), which always stay. The field labels words O, B-kind or
I-kind, with one kind more (secret: keys, tokens, passwords). It is trained on the small labelled table of
``pii_examples``, so a model doesn't depend on the corpus. Its features are the shapes of a word and of the two words on
either side, and the identity of the words that the table has. Decoding is by Viterbi in numpy batches. A word with a
digit, @, + or a bracketed "at" or "dot" is marked; words that are neither marked nor beside a marked one are O. Where O
beats every other label of a word by more than its transitions can repay, O is certain, and the chain falls into short
segments that are decoded side by side. Decoded spans that don't touch a base span are added if they have their kind's own
form: a card number must pass its check digit, an address its ranges, a phone number has 7 to 15 digits.

Nulls and empty texts have no spans. Spans are in code points, end exclusive. Repeated rows are treated alike. Whole texts
are scanned, of any length. An empty table gives no rows; input columns are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airlattice.session import ship

from .pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field: those of the patterns, and one that only the field finds.
FIELD_KINDS = (*KINDS, "secret")
EPOCHS, RATE, DECAY = 100, 0.2, 1e-3
LABELS = 1 + 2 * len(FIELD_KINDS)  # O, then B and I of each kind
#: Words on either side whose features a word's score has.
REACH = 2
PLACES = 2 * REACH + 1

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SYMBOLS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails inside a run of digits would fail from any later digit of the run: the look-behind skips those.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, MARK = re.compile(r"[0-9]"), re.compile(r"[0-9@+]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
BRACKETED = re.compile(rb"[\[({](?:at|dot)[\])}]", re.IGNORECASE)
EDGES = "\"'`.,;:!?()[]{}<>#$%&*="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each has one @, and begins where the run of local symbols before it does."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL_SYMBOLS:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# --- word shapes -----------------------------------------------------------------------------------------------


def marked(word: bytes) -> bool:
    return any(48 <= c <= 57 for c in word) or b"@" in word or b"+" in word or BRACKETED.search(word) is not None


def shape(word: bytes) -> tuple[str, ...] | None:
    """Features of a marked word; None for others."""
    if not marked(word):
        return None
    text = word.decode("utf-8", "replace")
    core = text.strip(EDGES)
    digits = "".join(c for c in core if c in "0123456789")
    runs: list[str] = []
    for c in core:
        k = "d" if c in "0123456789" else "x" if c.islower() or ord(c) >= 128 else "X" if c.isupper() else c
        if not runs or runs[-1] != k:
            runs.append(k)
    n = len(digits)
    size = str(n) if n < 5 else "5+" if n < 7 else "7+" if n < 9 else "9+" if n < 12 else "12+" if n < 20 else "20+"
    letters = sum(c.isalpha() for c in core)
    kind = "hex" if len(core) >= 16 and letters and not core.strip("0123456789abcdefABCDEF") else "mix" if len(core) >= 16 and letters and n and core.replace("_", "").isalnum() else "num" if n == len(core) else "other"
    out = ["shape:" + "".join(runs[:12]), "digits:" + size, "dots:%d" % min(core.count("."), 4), "colons:%d" % min(core.count(":"), 3), "at:%d" % ("@" in core or BRACKETED.search(word) is not None), "begin:" + text[0] if not text[0].isalnum() else "begin:a", "long:%d" % min(len(core) // 8, 5), "kind:" + kind]
    groups = re.findall("[0-9]+", core)
    if 2 <= len(groups) <= 5:
        out.append("groups:" + "-".join(str(min(len(g), 9)) for g in groups))
    if 12 <= n <= 19:
        out.append("check:%d" % luhn(digits))
    return tuple(out)


class Words(dict):
    """Classes of words, remembered up to a bound."""

    def __init__(self, field: Field):
        self.field = field

    def __reduce__(self):
        return Words, (self.field,)

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[w] = n = self.field.class_of(self.field.features_of(w))
        return n


def cue(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES.replace("=", "").replace(":", "")) or "-"


class Field:
    """Weights of a linear-chain conditional random field over the shapes of a word and its neighbours."""

    def __init__(self, features: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.features, self.emit, self.move = features, emit, move  # emit: [places, features, labels]; feature 0 is a plain word
        self.classes: dict[tuple | None, int] = {}
        self.scores: list[np.ndarray] = []
        self.marked: list[bool] = []
        self.words = Words(self)
        self.class_of(None)
        # What a label could gain over O by its two transitions, at most, with an edge on either side or not.
        gain = np.maximum((move - move[:, :1]).max(axis=0), 0) + np.maximum((move - move[:1]).max(axis=1), 0)
        self.gain = gain[1:] + 1e-9

    def features_of(self, w: bytes) -> tuple[str, ...] | None:
        """Those of a marked word; of another word its identity, if the labelled table has it."""
        found = shape(w)
        if found is None and (name := "word:" + cue(w)) in self.features:
            return (name,)
        return found

    def class_of(self, s: tuple | None) -> int:
        n = self.classes.get(s)
        if n is None:
            ids = [0] if s is None else [self.features[f] for f in s if f in self.features]
            self.classes[s] = n = len(self.scores)
            self.scores.append(self.emit[:, ids].sum(axis=1))
            self.marked.append(s is not None and not s[0].startswith("word:"))
        return n

    def sure(self, score: np.ndarray) -> np.ndarray:
        """Where O is the label whatever its neighbours are."""
        return score[:, 0] > (score[:, 1:] + self.gain).max(axis=1)

    def decode(self, classes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Labels of the words of many texts laid end to end; breaks marks the first word of each text."""
        n = len(classes)
        out = np.zeros(n, np.int8)
        hot = np.array(self.marked)[classes]
        text = np.cumsum(breaks)
        near = hot.copy()
        near[1:] |= hot[:-1] & (text[1:] == text[:-1])
        near[:-1] |= hot[1:] & (text[1:] == text[:-1])
        at = np.flatnonzero(near)
        if not len(at):
            return out
        table = np.stack(self.scores)  # [classes, places, labels]
        score = np.zeros((len(at), LABELS))
        for p in range(PLACES):
            other = at + p - REACH
            there = (other >= 0) & (other < n)
            there[there] = text[other[there]] == text[at[there]]
            score[there] += table[classes[other[there]], p]
        open_ = at[~self.sure(score)]
        if not len(open_):
            return out
        edge = np.r_[breaks, True]
        place = np.searchsorted(at, open_)  # rows of score; those of a segment are neighbours
        first = np.r_[True, (np.diff(open_) > 1) | breaks[open_[1:]]]
        start, length = place[first], np.diff(np.r_[np.flatnonzero(first), len(open_)])
        for n in np.unique(length):
            rows = start[length == n]
            for part in np.array_split(rows, -(-len(rows) * n // 200_000)):
                out[at[part][:, None] + np.arange(n)] = self.viterbi(score, part, n, edge[at[part]], edge[at[part] + n])
        return out

    def viterbi(self, score: np.ndarray, at: np.ndarray, n: int, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Best labels of segments of n words; a sure O lies on either side, or the edge of a text (opens, closes)."""
        best = score[at] + np.where(opens[:, None], 0, self.move[0])
        back = np.zeros((n, len(at), LABELS), np.int8)
        for t in range(1, n):
            step = best[:, :, None] + self.move
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + score[at + t]
        best = best + np.where(closes[:, None], 0, self.move[:, 0])
        path = np.zeros((len(at), n), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(at))
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        return path


def word_labels(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """BIO labels of words by the spans that they overlap."""
    out, i = [], 0
    for s, e in words:
        while i < len(spans) and spans[i][2] <= s:
            i += 1
        if i < len(spans) and spans[i][1] < e:
            k = 1 + 2 * FIELD_KINDS.index(spans[i][0])
            out.append(k if spans[i][1] >= s else k + 1)
        else:
            out.append(0)
    return out


def train(table: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """Maximum likelihood with a ridge, by full-batch Adam over the sentences of a labelled table."""
    features = {"": 0}
    windows: list[tuple[list, list]] = []
    for text, spans in table:
        at = [m.span() for m in WORD.finditer(text)]
        words = [text[s:e].encode() for s, e in at]
        shapes = [shape(w) or ("word:" + cue(w),) for w in words]
        windows.append((shapes, word_labels(at, spans)))
    seen = Counter(f for xs, _ in windows for s in xs for f in s)
    for f, n in seen.items():
        if n > 1 or not f.startswith("word:"):
            features.setdefault(f, len(features))
    n, t, f = len(windows), max(len(x) for x, _ in windows), len(features)
    x = np.zeros((n, t + 2 * REACH, f), np.float32)
    gold, mask, near = np.zeros((n, t), int), np.zeros((n, t), bool), np.zeros((n, t + 2), bool)
    for i, (xs, ys) in enumerate(windows):
        for j, s in enumerate(xs):
            # Every third sentence knows its plain words as such only: most words of a corpus are not in the table.
            known = [features[g] for g in s if g in features and not (i % 3 == 0 and g.startswith("word:"))]
            x[i, j + REACH, known or [0]] = 1
            near[i, j : j + 3] |= not s[0].startswith("word:")
        gold[i, : len(ys)], mask[i, : len(ys)] = ys, True
    # As in decoding, a word that is neither marked nor beside a marked one is O, whatever the features say.
    near = near[:, 1:-1] & mask
    gold *= near
    at = np.nonzero(near)
    places = [np.ascontiguousarray(x[at[0], at[1] + p]) for p in range(PLACES)]
    del x
    emit, move = np.zeros((PLACES, f, LABELS)), np.zeros((LABELS, LABELS))
    m = [np.zeros_like(emit), np.zeros_like(move)]
    v = [np.zeros_like(emit), np.zeros_like(move)]
    one = np.eye(LABELS)[gold] * mask[:, :, None]
    gold_pairs = np.einsum("ija,ijb->ab", one[:, :-1] * mask[:, 1:, None], one[:, 1:])
    for epoch in range(1, EPOCHS + 1):
        local = sum(places[p] @ emit[p].astype(np.float32) for p in range(PLACES)).astype(float)
        odds = np.zeros((n, t, LABELS))
        odds[:, :, 0] = 1
        odds[at] = np.exp(local - local.max(axis=1, keepdims=True))
        step = np.exp(move)
        # Forward and backward in probabilities, scaled at every word.
        fore, back, scale = np.ones((n, t, LABELS)), np.ones((n, t, LABELS)), np.ones((n, t, 1))
        fore[:, 0] = odds[:, 0] / odds[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, t):
            nxt = (fore[:, j - 1] @ step) * odds[:, j]
            scale[:, j] = np.where(mask[:, j, None], nxt.sum(axis=1, keepdims=True), 1)
            fore[:, j] = np.where(mask[:, j, None], nxt / scale[:, j], fore[:, j - 1])
        for j in range(t - 2, -1, -1):
            back[:, j] = np.where(mask[:, j + 1, None], (odds[:, j + 1] * back[:, j + 1] / scale[:, j + 1]) @ step.T, 1)
        p = fore * back
        p /= p.sum(axis=2, keepdims=True)
        wrong = ((p - one)[at] / n).astype(np.float32)
        grad = np.stack([y.T @ wrong for y in places]).astype(float)
        ahead = odds[:, 1:] * back[:, 1:] / scale[:, 1:] * mask[:, 1:, None]
        edge = (step * np.einsum("ija,ijb->ab", fore[:, :-1], ahead, optimize=True) - gold_pairs) / n
        for w, g, mm, vv in ((emit, grad + DECAY * emit, m[0], v[0]), (move, edge + DECAY * move, m[1], v[1])):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            w -= RATE * (mm / (1 - 0.9**epoch)) / (np.sqrt(vv / (1 - 0.99**epoch)) + 1e-8)
    return Field(features, emit, move)


def has_form(kind: str, text: str) -> bool:
    """Whether a decoded span has its kind's own form."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "email":
        return "@" in text.strip("@") or BRACKETED.search(text.encode("utf-8", "replace")) is not None
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)
    if kind == "ip":
        parts = re.split(r"\.|\[\.\]|\(\.\)", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) or re.fullmatch(r"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", text) is not None
    return len(text) >= 7 and any(c.isalpha() for c in text) and bool(digits)


def added_spans(text: str, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Decoded spans that touch no base span and have their kind's form, without punctuation at their ends."""
    at, out, j = [m.span() for m in WORD.finditer(text)], [], 0
    for i in np.flatnonzero(labels):
        if i < j:
            continue
        k, j = (labels[i] - 1) // 2, i + 1
        while j < len(labels) and labels[j] == 2 * k + 2:
            j += 1
        kind, s, e = FIELD_KINDS[k], at[i][0], at[j - 1][1]
        after, before = (EDGES, EDGES.replace("(", "") if kind == "phone" else EDGES)
        while e > s and text[e - 1] in (after if kind != "secret" else "\"'`.,;:)]}<>#$%&*="):
            e -= 1
        if kind == "secret" and e - s > 2 and text[e - 2 : e] == "!!":
            e -= 2
            e -= text[e - 1] in "\"'"
        while s < e and text[s] in before:
            s += 1
        if s < e and has_form(kind, text[s:e]) and not any(b < e and s < f for _, b, f in base):
            out.append((kind, s, e))
    return out


_field: list[Field] = []


def field() -> Field:
    """The field trained on the labelled table; the same on every call."""
    if not _field:
        _field.append(train(examples()))
    return _field[0]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, n_added, n_spans (base and added), and all spans, of every document."""
    ship(docs.sparkSession)
    model = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            all_ = list(base)
            # Without a marked word all labels are O.
            some = [i for i, x in enumerate(texts) if MARK.search(x)]
            flat, sizes = [], []
            for i in some:
                words = texts[i].encode("utf-8", "replace").split()
                flat += map(model.words.__getitem__, words)
                sizes.append(len(words))
            if flat:
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                breaks = np.zeros(edges[-1], bool)
                breaks[edges[:-1][np.array(sizes) > 0]] = True
                labels = model.decode(np.array(flat, np.int32), breaks)
                for j in np.unique(np.searchsorted(edges, np.flatnonzero(labels), side="right") - 1):
                    i = some[j]
                    more = added_spans(texts[i], labels[edges[j] : edges[j + 1]], base[i])
                    all_[i] = sorted(base[i] + more, key=lambda s: (s[1], FIELD_KINDS.index(s[0])))
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            extra = pa.array([len(a) - len(b) for a, b in zip(all_, base, strict=True)], pa.int64())
            total = pa.array(list(map(len, all_)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, extra, total, pa.array(map(joined, all_), pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "n_added", "n_spans", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, n_spans long, spans string")
