"""Language-model scoring with Elias-Fano n-gram tries, sharded by context.

Every token of every document is an event: a word after its context, the word before it (order 2), and the word before
that (order 3). Events are packed by the hash of the context and shuffled once. So one task has all events of its contexts: it counts those of training
documents, builds its shard of the model from the counts, and scores all its events with it. A shard is a trie over
contexts read backwards: context v with its successors w, and at order 3 below it the words u before v, each with its
own successors. Each level has two monotone Elias-Fano sequences: pointers to where the children of each node of the
level above begin, and the children's words, which rise within a node and are stored on top of the last value before it.
A child is found by a successor search between two pointers, relative to that value. Bits stay packed: low bits at their
exact width, high bits in unary with counts for each 64 of them, so an element takes some four bits more than its low
ones. Probabilities (absolute discounting with back-off) are quantised to 256 values a level. All levels of a shard lie
in one memory-mapped file, which the task removes when its shard is scored.

What a shard doesn't know is the unigram probability of a word unseen after its context: such events leave the
shard as (document, word) and meet the shards' own context counts, which are the counts of words, in a second, small
shuffle. Document sums are added up by document.

Hot contexts: the events of a word of more than 1 / (2 * shards) of the tokens, or of one in a hundred, and of the start, are dealt over several
shards, so no task has much more than its share unless one pair of words is that frequent. The counts stay whole, so a
score doesn't depend on the number of shards. At order 2, and for the start, the hash of the successor deals: a pair's
count is whole in one shard, the context's total is its exact count of tokens, and its back-off weight, which needs the
number of its kinds of successors over all shards, is added in the second shuffle. At order 3 the hash of the word before
deals: what follows two words is whole in one shard, and pairs of a hot word and its successor are counted in the second
shuffle, for the events that fall back to them. Heavy words are found exactly: a word that is hot overall is hot in some
partition.

Nulls: a null text is empty and still has its end token; a null doc_id counts as the empty text in the hold-out
rule. Repeated rows are documents of their own. Without training documents every probability is that of the base.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.session import shared_dir

from .hashing import WordIds, mix, release, texts

FOLDS, HELD = 7, 2
DISCOUNT = 0.75
#: Events of a shard on average; tokens that a task packs at a time; words that a task counts, and events it scores, at a time.
SHARD_EVENTS, BLOCK_TOKENS, COUNTED, SCORED = 2_000_000, 1_500_000, 400_000, 500_000
#: Words whose hashes a task that packs remembers; bytes of packets that it sends at a time.
REMEMBERED, SENT = 100_000, 4_000_000
#: Bytes of text that a token takes, about: only the number of shards and what counts as hot depend on it.
TOKEN_BYTES = 6
#: A word of one in so many tokens is hot whatever the number of shards.
HOT = 100
#: Order of the model.
ORDER = 3
# No word holds a space, so these two are no word's hash but by chance.
START, END = (WordIds()[x] for x in (b" start", b" end"))


# --- compact levels --------------------------------------------------------------------------------------------


class EliasFano:
    """A rising sequence in packed bits: the low bits of each element, its high bits in unary, and counts that lead into those.

    Bits lie in 64-bit words. ``ones`` and ``zeros`` hold, for each word of the unary part, how many bits of their kind
    come before it: a select searches them, then halves the word.
    """

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.bits = low, high, ones, zeros, n, bits

    @classmethod
    def encode(cls, values: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[int, int]]:
        """Parts of a sequence of non-negative numbers, and its length and number of low bits."""
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max((most // max(n, 1)).bit_length() - 1, 0)
        low = np.zeros(-(-n * bits // 8) + 16, np.uint8)
        for at in range(0, n if bits else 0, 1 << 16):  # a multiple of 8 elements ends with a byte
            some = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            body = np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :bits], bitorder="little")
            low[at * bits // 8 :][: len(body)] = body
        unary = np.zeros(-(-(n + (most >> bits) + 1) // 64) * 64, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)][:-1]
        zeros = 64 * np.arange(len(high)) - ones
        low = low[: len(low) // 8 * 8].view(np.uint64)
        return {"low": low, "high": high, "ones": ones.astype(np.uint32), "zeros": zeros.astype(np.uint32)}, (n, bits)

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the one, or zero, that has ``i`` of its kind before it."""
        counts = self.ones if one else self.zeros
        at = np.searchsorted(counts, i.astype(np.uint32), side="right") - 1
        word = self.high[at] if one else ~self.high[at]
        left = (i - counts[at]).astype(np.uint8)
        place = at << 6
        for width in (32, 16, 8, 4, 2, 1):
            half = word & np.uint64((1 << width) - 1)
            n = np.bitwise_count(half)
            up = left >= n
            word = np.where(up, word >> np.uint64(width), half)
            left -= n * up
            place += width * up
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        shift = (at & 63).astype(np.uint64)
        at >>= 6
        # A shift by 64 isn't defined: it is done in two steps.
        both = (self.low[at] >> shift) | ((self.low[at + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return both & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Elements by number."""
        return ((self._select(i, True) - i) << self.bits) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first element from ``begin`` on, before ``end``, that isn't less than x, else ``end``; and whether it is x."""
        top = 64 * len(self.high) - self.n - 1  # the last zero
        h = x >> self.bits
        over = h > top
        h = np.minimum(h, top)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)
        at = np.clip(np.where(over, end, start), begin, end)
        stop = np.clip(self._select(h, False) - h, at, end)
        want = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        live = np.flatnonzero(at < stop)
        # Halve the run of each element's high part; runs are long where a context has many successors.
        lo, hi, low = at[live], stop[live], want[live]
        while len(live):
            mid = (lo + hi) >> 1
            less = self._low(mid) < low
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            more = lo < hi
            at[live[~more]] = lo[~more]
            live, lo, hi, low = live[more], lo[more], hi[more], low[more]
        same = np.zeros(len(x), bool)
        inside = np.flatnonzero(at < stop)
        same[inside] = self._low(at[inside]) == want[inside]
        return at, same

    def find(self, x: np.ndarray) -> np.ndarray:
        """Number of x, or -1."""
        at, same = self.successor(x, np.zeros(len(x), np.int64), np.full(len(x), self.n))
        return np.where(same, at, -1)


class Level:
    """Children of the nodes of the level above: pointers to where each parent's children begin, and the children's words.

    Both are Elias-Fano sequences. Words rise within a parent only, so each parent's are stored on top of the last
    value before them; a child is found by a successor search between two pointers, relative to that value.
    """

    def __init__(self, pointers: EliasFano, words: EliasFano):
        self.pointers, self.words = pointers, words

    @staticmethod
    def sequences(parents: np.ndarray, words: np.ndarray, n_parents: int) -> tuple[np.ndarray, np.ndarray]:
        """Pointers and raised words of children in the order of (parent, word); every parent has some."""
        begin = np.searchsorted(parents, np.arange(n_parents + 1))
        last = words[begin[1:] - 1].astype(np.int64) + 1
        return begin, (np.cumsum(last) - last)[parents] + words + 1

    def find(self, parent: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of children, or -1: ``parent`` has the parents asked for, ``of`` the place there of each word's parent."""
        if not len(word):
            return np.zeros(0, np.int64)
        begin, end = self.pointers.access(parent), self.pointers.access(parent + 1)
        base = np.where(begin > 0, self.words.access(np.maximum(begin - 1, 0)), 0)
        at, same = self.words.successor(base[of] + word + 1, begin[of], end[of])
        return np.where(same, at, -1)


def heads(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and the run of each row."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.r_[starts, len(values)])


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a codebook of up to 256 values, each the mean of an equal share of the values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    distinct, inverse = np.unique(values, return_inverse=True)
    if len(distinct) <= 256:
        return inverse.astype(np.uint8), distinct.astype(np.float32)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    codes = np.searchsorted(edges, values, side="right")
    n = np.bincount(codes, minlength=len(edges) + 1)
    return codes.astype(np.uint8), (np.bincount(codes, values, minlength=len(edges) + 1) / np.maximum(n, 1)).astype(np.float32)


class Trie:
    """One shard of the model, in a memory-mapped file that is gone when it is closed."""

    def __init__(self, levels: dict[str, np.ndarray], numbers: dict):
        self.numbers = numbers
        self.file = tempfile.TemporaryFile()
        places, at = {}, 0
        for name, a in levels.items():
            self.file.write(b"\0" * (-at % 8))
            at += -at % 8
            places[name] = (at, a.dtype, len(a))
            self.file.write(a.tobytes())
            at += a.nbytes
        self.file.flush()
        self.bytes = at
        whole = np.memmap(self.file, np.uint8, "r") if at else np.zeros(0, np.uint8)
        self.levels = {k: whole[p : p + n * d.itemsize].view(d) for k, (p, d, n) in places.items()}
        opened = lambda name: EliasFano(*(self.levels[f"{name}_{x}"] for x in EliasFano.PARTS), *numbers[name])
        self.words = opened("words")
        self.below = {x: Level(opened(x + "_pointers"), opened(x)) for x in ("seconds", "pairs", "thirds") if x in numbers}
        self.summed = self.levels["summed"] > 0

    @classmethod
    def build(cls, v: np.ndarray, u: np.ndarray | None, w: np.ndarray, n_words: int, discount: float = DISCOUNT, whole: int | None = None, totals: np.ndarray | None = None) -> Trie:
        """From the training events of a shard, in the order of (v, u, w) or, without u, of (v, w); numbers below n_words.

        Contexts from number ``whole`` on have events in other shards too; ``totals`` has, by number less ``whole``, the
        total of those that are dealt by successor, and 0 for those that are dealt by the word before.
        """
        d = np.int64(n_words)
        whole = n_words if whole is None else whole
        totals = np.zeros(n_words - whole, np.int64) if totals is None else totals
        levels, numbers = {}, {}

        def sequence(name: str, values: np.ndarray) -> None:
            parts, numbers[name] = EliasFano.encode(values)
            levels.update({f"{name}_{x}": a for x, a in parts.items()})

        def level(name: str, parents: np.ndarray, words: np.ndarray, n_parents: int) -> None:
            pointers, raised = Level.sequences(parents, words, n_parents)
            sequence(name + "_pointers", pointers)
            sequence(name, raised)

        def probabilities(name: str, parents: np.ndarray, n_parents: int, counts: np.ndarray, of: np.ndarray) -> None:
            """Of successors with their parents' numbers: quantised log probabilities, and back-off weights of the parents, whose contexts are ``of``."""
            total = np.bincount(parents, counts, minlength=n_parents)
            kinds = np.bincount(parents, minlength=n_parents)
            dealt = np.flatnonzero(of >= whole)
            known = totals[of[dealt] - whole]
            total[dealt[known > 0]] = known[known > 0]
            levels[name + "_p"], levels[name + "_pbook"] = quantise(np.log10((counts - discount) / total[parents]))
            levels[name + "_b"], levels[name + "_bbook"] = quantise(np.log10(discount * kinds / total))

        contexts, n_v = runs(v)
        v = np.repeat(np.arange(len(contexts)), n_v)
        levels["summed"] = np.zeros(len(contexts), np.uint8)
        levels["summed"][contexts >= whole] = totals[contexts[contexts >= whole] - whole] > 0
        sequence("words", contexts.astype(np.int64))
        two, n_two = runs(v * d + w) if u is None else np.unique(v * d + w, return_counts=True)
        level("seconds", two // d, two % d, len(contexts))
        probabilities("seconds", two // d, len(contexts), n_two, contexts)
        del two, n_two
        if u is not None:
            # Events come in the order of (v, u, w), so that runs are all there is to count.
            at, of = heads(v, u)
            level("pairs", v[at], u[at], len(contexts))
            of_pair = v[at]
            at, _ = heads(of, w)
            n_three = np.diff(np.r_[at, len(w)])
            level("thirds", of[at], w[at], len(of_pair))
            probabilities("thirds", of[at], len(of_pair), n_three, contexts[of_pair])
        numbers["whole"] = whole
        return cls(levels, numbers)

    def score(self, v: np.ndarray, u: np.ndarray | None, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of events in the order of (v, u, w), and where the unigram probability of w is still to be added.

        For contexts that aren't whole here, the probability of order 2 (at order 3) or its back-off weight is to be added as
        well; of those that are dealt by successor (the start alone, at order 3), so is the back-off weight of order 3.
        """
        lv, whole = self.levels, self.numbers["whole"]
        log, rest = np.zeros(len(v)), np.ones(len(v), bool)
        at, of = heads(v)
        context = self.words.find(v[at].astype(np.int64))[of]
        seen = np.flatnonzero(context >= 0)

        def search(name: str, some: np.ndarray, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
            """Children ``words`` of ``parents`` for the events ``some``; each parent is opened, and each child searched, once a run."""
            at, of = heads(parents[some], words[some])
            few, of_few = heads(parents[some][at])
            return self.below[name].find(parents[some][at[few]], of_few, words[some][at].astype(np.int64))[of]

        if u is not None:
            pair = np.full(len(v), -1)
            pair[seen] = search("pairs", seen, context, u)
            has = np.flatnonzero(pair >= 0)
            third = search("thirds", has, pair, w)
            hit = third >= 0
            log[has[hit]] = lv["thirds_pbook"][lv["thirds_p"][third[hit]]]
            miss = has[~hit & ~self.summed[context[has]]]
            log[miss] = lv["thirds_bbook"][lv["thirds_b"][pair[miss]]]
            rest[has[hit]] = False
        back = np.flatnonzero(rest & (context >= 0) & ((v < whole) | (u is None)))
        second = search("seconds", back, context, w)
        hit = second >= 0
        log[back[hit]] += lv["seconds_pbook"][lv["seconds_p"][second[hit]]]
        rest[back[hit]] = False
        back = back[~hit & (v[back] < whole)]
        log[back] += lv["seconds_bbook"][lv["seconds_b"][context[back]]]
        return log, rest


# --- packing and scoring ---------------------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and a.dtype != np.uint64 and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        body = a.tobytes() if a.dtype == np.uint64 else zlib.compress(a.tobytes(), 1)  # hashes don't shrink
        parts.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(body)], np.int64).tobytes() + body)
    return b"".join(parts)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size, n = np.frombuffer(data, np.int64, 3, at)
        body = data[at + 24 : at + 24 + n]
        dtype = np.dtype(f"{chr(kind)}{size}")
        out.append(np.frombuffer(body if dtype == np.uint64 else zlib.decompress(body), dtype))
        at += 24 + int(n)
    return out


def steps(words: np.ndarray) -> list[np.ndarray]:
    """Rising hashes as the high 16 bits of their steps, which are mostly 0, and the other 48 bits, packed."""
    step = np.diff(words, prepend=np.uint64(0))
    low = step.view(np.uint8).reshape(-1, 8)[:, :6].ravel()
    return [(step >> np.uint64(48)).astype(np.uint16), np.r_[low, np.zeros(-len(low) % 8, np.uint8)].view(np.uint64)]


def unstep(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    step = np.zeros((len(high), 8), np.uint8)
    step[:, :6] = low.view(np.uint8)[: 6 * len(high)].reshape(-1, 6)
    return np.cumsum(step.view(np.uint64)[:, 0] + (high.astype(np.uint64) << np.uint64(48)), dtype=np.uint64)


def ways_of(v: np.ndarray, by: np.ndarray, hot: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """0, or for hot words (sorted hashes and numbers of ways) 1 and one of its ways by the hash of another word."""
    out = np.zeros(len(v), np.uint64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        is_hot = np.flatnonzero(hot[at] == v)
        out[is_hot] = np.uint64(1) + mix(by[is_hot]) % ways[at[is_hot]]
    return out


def context_of(v: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Hash of a context: that of the word, or of a hot word with its way."""
    out, split = v.copy(), np.flatnonzero(way)
    out[split] = mix(v[split] + way[split].astype(np.uint64))
    return out


def pack(hot: np.ndarray, ways: np.ndarray, shards: int, order_: int):
    """Packets (shard, payload) of a partition's documents (doc_id, held, text)."""

    def packets(block: int, docs: list[tuple], seqs: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in seqs])
        seq = np.concatenate(seqs)  # two starts, the words, an end, of each document
        seqs.clear()
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), n)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
        at = np.flatnonzero(place >= 2)
        head, doc = place[at] == 2, doc[at]
        del place
        v = seq[at - 1]
        way = ways_of(v, seq[at] if order_ == 2 else seq[np.where(head, at, at - 2)], hot, ways)
        shard = (mix(context_of(v, way)) % np.uint64(shards)).astype(np.int32)
        way = way.astype(np.int32)
        del v
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        del shard
        ids = np.array([d[0] if d[0] is not None else 0 for d in docs], np.int64)
        null = np.array([d[0] is None for d in docs], np.uint8)
        held = np.array([d[1] for d in docs], np.uint8)
        out_shard, payload, size = [], [], 0
        for s in range(shards):
            own = order[edges[s] : edges[s + 1]]
            if not len(own):
                continue
            words, inverse = np.unique(np.concatenate([seq[at[own] - back] for back in ((1, 0, 2) if order_ == 3 else (1, 0))]), return_inverse=True)
            k = len(own)
            home = doc[own][head[own]]
            met, d = np.unique(doc[own], return_inverse=True)
            payload.append(squeeze(np.array([block, first]), *steps(words), inverse[:k], inverse[k : 2 * k], inverse[2 * k :], way[own], np.diff(d, prepend=0), met, held[met], home, ids[home].view(np.uint64), null[home]))
            out_shard.append(s)
            size += len(payload[-1])
            if size >= SENT:
                yield sent(out_shard, payload)
                out_shard, payload, size = [], [], 0
        if payload:
            yield sent(out_shard, payload)

    def sent(shard: list[int], payload: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(payload, pa.large_binary())], ["shard", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = WordIds(REMEMBERED), TaskContext.get().partitionId()
        docs, seqs, first, size = [], [], 0, 0
        lead, tail = np.array([START, START], np.uint64), np.array([END], np.uint64)
        for batch in batches:
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch, "text"), strict=True):
                docs.append((doc_id, held))
                seqs.append(np.concatenate([lead, words.of(text.lower().split()), tail]))
                size += len(seqs[-1])
                if size >= BLOCK_TOKENS:
                    yield from packets(block, docs, seqs, first)
                    first, size, docs, seqs = first + len(docs), 0, [], []
        if docs:
            yield from packets(block, docs, seqs, first)
        del words, docs, seqs
        release()

    return run


OUT = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("context", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("doc_id", pa.int64()), ("held_out", pa.bool_())])
OUT_DDL = "kind byte, key long, context long, word long, n long, known long, base double, score double, doc_id long, held_out boolean"


def rows(kind_: int, size: int, **columns) -> pa.Table:
    return pa.table([pa.array(np.full(size, kind_, np.int8)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in OUT], schema=OUT)


def score_shard(hot: np.ndarray, hot_counts: np.ndarray, order_: int):
    """Scores a shard's packets.

    Gives rows of kind 0 (sums of a document), 1 (a document's word without a seen context), 2 (count of a word), 3 (a
    document's hot contexts whose back-off weight is to be added; at order 3 with their words, instead of kind 1) and 4
    (number of kinds of successors of a hot context here; at order 3 the counts of its successors here).
    """

    def scored(group: pa.Table) -> pa.Table:
        packets = [unsqueeze(p.as_py()) for p in group["payload"]]
        for p in packets:
            p[1:3] = [unstep(*p[1:3])]
        words = np.unique(np.concatenate([p[1] for p in packets]))
        local = [np.searchsorted(words, p[1]).astype(np.int32) for p in packets]
        part = lambda i: np.concatenate([at[p[i]] for at, p in zip(local, packets, strict=True)])
        v, w, u = part(2), part(3), part(4) if order_ == 3 else None
        way = np.concatenate([p[5] for p in packets])
        docs, of, held_doc, home, ids, null, n = [], [], [], [], [], [], 0
        for p in packets:
            # The documents of two packets are never the same.
            base = (int(p[0][0]) << 32) + int(p[0][1])
            docs.append(base + p[7].astype(np.int64))
            of.append((n + np.cumsum(p[6].astype(np.int64))).astype(np.int32))
            held_doc.append(p[8])
            home.append(n + np.searchsorted(p[7], p[9]))
            ids.append(p[10].view(np.int64))
            null.append(p[11])
            n += len(p[7])
        packets.clear()
        docs, of, held_doc, home, ids, null = map(np.concatenate, (docs, of, held_doc, home, ids, null))
        held_doc = held_doc == 1
        # Contexts are words, or hot words with their way: those get numbers of their own after the words'.
        c, split = v.copy(), np.flatnonzero(way)
        ways_, number = np.unique(v[split].astype(np.int64) * 2**20 + way[split], return_inverse=True)
        c[split] = len(words) + number
        d = len(words) + len(ways_)
        total = hot_counts[np.searchsorted(hot, words[ways_ >> 20])] if len(ways_) else np.zeros(0, np.int64)
        if u is not None:
            total = np.where(words[ways_ >> 20] == START, total, 0)
        del way, split, number
        if u is None:
            order = np.argsort(c * np.int64(d) + w)
        else:
            order = np.lexsort((w, u, c)) if d >= 1 << 21 else np.argsort((c * np.int64(d) + u) * d + w)
            u = u[order]
        v, w, c = v[order], w[order], c[order]
        of, held = of[order], held_doc[of[order]]
        del order
        trie = Trie.build(c[~held], u[~held] if u is not None else None, w[~held], d, whole=len(words), totals=total)
        log, rest = np.zeros(len(v)), np.zeros(len(v), bool)
        for at in range(0, len(v), SCORED):
            some = slice(at, at + SCORED)
            log[some], rest[some] = trie.score(c[some], u[some] if u is not None else None, w[some])
        # A word is a context as often as it is a token; the start stands for the end.
        count = np.bincount(v[~held], minlength=len(words))
        name = np.where(words == START, np.uint64(END), words)
        at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
        is_hot = hot[at] == words if len(hot) else np.zeros(len(words), bool)
        count[is_hot] = hot_counts[at[is_hot]]
        sums = lambda x: np.bincount(of, x, minlength=len(docs))
        who = np.full(len(docs), -1)
        who[home.astype(np.int64)] = np.arange(len(home))
        first = who >= 0
        doc_id = pa.array(ids[who], mask=~first | (null[who] == 1)) if len(home) else pa.nulls(len(docs), pa.int64())
        out = [rows(0, len(docs), key=docs, n=np.bincount(of, minlength=len(docs)), known=sums(count[v] > 0).astype(np.int64), base=sums(np.log10(count[v] + 1.0)), score=sums(log), doc_id=doc_id, held_out=held_doc)]
        dealt = c >= len(words)
        if u is None:
            part_, n_part = np.unique(of[rest & dealt].astype(np.int64) * d + v[rest & dealt], return_counts=True)
            out.append(rows(3, len(part_), key=docs[part_ // d], context=words[part_ % d].view(np.int64), n=n_part))
            # A hot word's ways don't share a successor.
            pairs, _ = runs(c[dealt & ~held] * np.int64(d) + w[dealt & ~held])
            owner, kinds = np.unique(ways_[pairs // d - len(words)] >> 20, return_counts=True)
            out.append(rows(4, len(owner), context=words[owner].view(np.int64), n=kinds))
        else:
            few = np.flatnonzero(rest & dealt)
            met, pair = np.unique(v[few].astype(np.int64) * d + w[few], return_inverse=True)
            part_, n_part = np.unique(of[few].astype(np.int64) * max(len(met), 1) + pair, return_counts=True)
            at_ = met[part_ % max(len(met), 1)]
            out.append(rows(3, len(part_), key=docs[part_ // max(len(met), 1)], context=words[at_ // d].view(np.int64), word=words[at_ % d].view(np.int64), n=n_part))
            pairs, n_pairs = np.unique(v[dealt & ~held].astype(np.int64) * d + w[dealt & ~held], return_counts=True)
            out.append(rows(4, len(pairs), context=words[pairs // d].view(np.int64), word=words[pairs % d].view(np.int64), n=n_pairs))
            rest &= ~dealt
        left, n_left = np.unique(of[rest].astype(np.int64) * d + w[rest], return_counts=True)
        out.append(rows(1, len(left), key=docs[left // d], word=words[left % d].view(np.int64), n=n_left))
        own = np.unique(v[~held])
        own = own[~is_hot[own]]
        out.append(rows(2, len(own), word=name[own].view(np.int64), n=count[own]))
        return pa.concat_tables(out)

    def run(group: pa.Table) -> pa.Table:
        out = scored(group)
        release()
        return out

    return run


def candidates(docs: DataFrame, finest: int) -> np.ndarray:
    """Hashes that hold those of all words of at least one in ``finest`` tokens, and at most 2 * ``finest`` of them.

    Of each stretch of tokens a task sends the words of at least half that share, with their counts. What is dropped is less than half
    the share of all tokens, so a word that is wanted keeps half of it in the sums; and no more words than 2 * finest can.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, count, n, total = WordIds(REMEMBERED), Counter(), Counter(), 0, 0

        def close() -> None:
            found.update({ids[w]: c for w, c in count.items() if 2 * finest * c >= n})
            count.clear()

        for batch in batches:
            for text in texts(batch, "text"):
                words = text.lower().split()
                count.update(words)
                n += len(words)
                if len(count) > COUNTED:
                    close()
                    total, n = total + n, 0
        close()
        ids.clear()
        release()
        hashes = np.array(list(found), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(hashes), pa.nulls(1, pa.int64())]), pa.array([*found.values(), total + n], pa.int64())], ["word", "n"])

    sums = docs.select("text").mapInArrow(local, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    tokens = sums.where("word is null").agg(F.sum("n")).first()[0] or 0
    return np.array([r.word for r in sums.where("word is not null").where(F.col("n") * 2 * finest >= tokens).select("word").collect()], np.int64).view(np.uint64)


def heavy(docs: DataFrame, shards: int, tokens: int) -> dict[int, int]:
    """Exact training counts, by hash, of the words that are more than 1 / (2 * shards) of all tokens, or one in ``HOT``."""
    finest = max(2 * shards, HOT)
    wanted = set(candidates(docs, finest).tolist())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, count, total = WordIds(REMEMBERED), Counter(), Counter()
        for batch in batches:
            for text in texts(batch, "text"):
                count.update(text.lower().split())
                if len(count) > COUNTED:
                    total.update({ids[w]: c for w, c in count.items() if ids[w] in wanted})
                    count.clear()
        total.update({ids[w]: c for w, c in count.items() if ids[w] in wanted})
        ids.clear()
        count.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64), pa.int64()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows_ = docs.where("not held_out").select("text").mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word % 2**64: r.n for r in rows_ if finest * r.n > tokens}


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{spark.range(1).selectExpr('uuid()').first()[0]}"
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.count(F.lit(1)), F.sum((~F.col("held_out")).cast("long"))).first()
    tokens, n_train = (size[0] or 0) // TOKEN_BYTES + size[1], size[2] or 0
    shards = max(8, -(-tokens // SHARD_EVENTS))
    counts = heavy(docs, shards, tokens)
    # Every document has a start: it is split as any hot word.
    counts[START] = n_train
    hot = np.array(sorted(counts), np.uint64)
    hot_counts = np.array([counts[int(h)] for h in hot], np.int64)
    ways = np.maximum(-(-hot_counts * 2 * shards // max(tokens, 1)), 1).astype(np.uint64)
    events = docs.mapInArrow(pack(hot, ways, shards, order), "shard int, payload binary")
    events.groupBy("shard").applyInArrow(score_shard(hot, hot_counts, order), OUT_DDL).write.parquet(folder)
    out = spark.read.schema(OUT_DDL).parquet(folder)
    # Hot words, and the end, have their exact counts already.
    known = [(int(h) - (int(h) >> 63 << 64), int(c)) for h, c in zip(hot, hot_counts, strict=True) if int(h) != START and c]
    known += [(END - (END >> 63 << 64), n_train)] if n_train else []
    vocabulary = out.where("kind = 2").select("word", "n").unionAll(spark.createDataFrame(known, "word long, n long"))
    distinct = vocabulary.count()
    train = out.where("kind = 0 and not held_out").agg(F.sum("n")).first()[0] or 0
    norm = F.log10(F.lit(float(train + distinct + 1)))
    # Hot contexts: their back-off weights, and at order 3 their pairs, over all shards.
    hot_totals = spark.createDataFrame([(int(h) - (int(h) >> 63 << 64), int(c)) for h, c in zip(hot, hot_counts, strict=True)], "context long, total long")
    whole = out.where("kind = 4").select("context", "word", "n").groupBy("context", "word").agg(F.sum("n").alias("pair"))
    kinds = whole.groupBy("context").agg((F.sum("pair") if order == 2 else F.count(F.lit(1))).alias("kinds"))
    # At the start both words of the context of order 3 are the start: its weight is that of order 2 again.
    twice = F.when(F.col("context") == START - (START >> 63 << 64), order - 1).otherwise(1)
    weights = hot_totals.join(kinds, "context", "left").withColumn("weight", F.coalesce(twice * F.log10(DISCOUNT * F.col("kinds") / F.col("total")), F.lit(0.0)))
    back = out.where("kind = 3").select("key", "context", "word", "n").join(F.broadcast(weights), "context")
    unigrams = out.where("kind = 1").select("key", "word", "n")
    if order == 3:
        back = back.join(whole, ["context", "word"], "left")
        unigrams = unigrams.unionAll(back.where("pair is null").select("key", "word", "n"))
        back = back.withColumn("weight", F.coalesce(F.log10((F.col("pair") - DISCOUNT) / F.col("total")), "weight"))
    rest = unigrams.join(vocabulary.select("word", F.col("n").alias("c")), "word", "left")
    rest = rest.select("key", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0) - norm)).alias("score"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"))
    back = back.select("key", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("weight")).alias("score"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"))
    sums = out.where("kind = 0").select("key", "n", "known", "base", "score", "doc_id", "held_out").unionAll(rest).unionAll(back).groupBy("key").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"), F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"))
    return sums.select("doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n") * norm).alias("base_score"), "score")
