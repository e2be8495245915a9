"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary becomes a deterministic transducer over the bytes of a pre-token. Its state holds what
can still matter of the bytes read: the longest suffix that begins some token, and for every position in it the last
token of the encoding up to there and how many tokens fewer it has than the whole. A transition finds the one token
that ends at the new byte and fits its left neighbour, and is annotated with the change of the token count that it
emits. States and transitions are compiled when a text first needs them and kept, up to a bound, by each worker.

Texts are cut into chunks. Where a lone space stands between two other characters, a new pre-token begins whatever
came before: the state map of everything left of it is constant. So a chunk's map is (open head, count, open tail):
the count of all pieces between its first and last such space, and the text beside them. Maps compose associatively
and are combined by a prefix scan; pieces have equal maps wherever they occur, and are counted once and remembered.

Results per document: n_bytes, n_tokens and over_limit. Nulls and empty texts have 0 of both. Special strings in
texts are handled as the library does by default: they count as one token. Repeated rows each get their result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.session import ship

from .hashing import texts

FILE, LIMIT = "byte_bpe_50k.json", 512
#: Characters of a chunk; pieces and states that a worker remembers.
CHUNK, PIECES, STATES = 1 << 16, 1_000_000, 200_000
#: Pre-tokens of the byte-level vocabulary (fixed by its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The vocabulary file's printable symbol of each byte (fixed by its format): printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of pre-tokens; ``step`` is the transition function, filled on demand."""

    def __init__(self, vocabulary: dict):
        symbols = byte_symbols()
        read = lambda token: bytes(symbols[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in vocabulary["model"]["merges"]]
        self.rank = {(read(a), read(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {read(a) + read(b) for a, b in merges} | {bytes([b]) for b in range(256)}
        self.longest = max(map(len, tokens))
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t) + 1)}
        self.tokens = tokens
        #: How a token is made: its parts, and the rank of their merge.
        self.parts = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        self.fits = lru_cache(1 << 17)(self._fits)
        self.spine = lru_cache(1 << 16)(self._spine)
        self.reached = lru_cache(1 << 16)(lambda token: self.merge(token) == (token,))
        self.reset()

    def reset(self) -> None:
        #: Of each state: (suffix, last tokens at its positions, counts relative to the end); state 0 is the start.
        self.states = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, piece: bytes) -> tuple[bytes, ...]:
        """The encoding by the definition: merge the pair of least rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(parts)

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at the left (0) or right (1) edge of a token, each with the rank at which it goes up in the next."""
        out, until = [], len(self.rank)
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.parts[token][2], self.parts[token][side]

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Two tokens stand side by side in an encoding unless two of their edge parts merge before either has gone up.

        Of equal ranks the leftmost merge is first: within the left token before across, and across before within the right one.
        """
        for a, until_a in self.spine(left, 1):
            for b, until_b in self.spine(right, 0):
                if (rank := self.rank.get((a, b))) is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count) of a transition."""
        suffix, last, counts = self.states[state]
        text = suffix + bytes([byte])
        for at in range(len(text)):  # longest token first; exactly one fits
            token = text[at:]
            if token in self.tokens and self.reached(token) and (last[at] is None or self.fits(last[at], token)):
                break
        else:
            raise ValueError("the vocabulary doesn't cover a byte")
        change = counts[at] + 1
        keep = 0
        while text[keep:] not in self.prefixes:
            keep += 1
        new = (text[keep:], (*last[keep:], token), (*(c - change for c in counts[keep:]), 0))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = out = (self.number[new], change)
        return out

    def count(self, pretoken: bytes) -> int:
        if len(self.states) > STATES:
            self.reset()
        state, total, step = 0, 0, self.step
        for byte in pretoken:
            found = step.get(state << 8 | byte)
            state, change = found if found is not None else self.compile(state, byte)
            total += change
        return total


class Pieces(dict):
    """Token counts of pieces by their text after the space that begins them."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, text: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        self[text] = n = sum(self.counter.machine.count(t.encode()) for t in self.counter.split(" " + text))
        return n


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.machine = Transducer(vocabulary)
        self.split = regex.compile(PATTERN).findall
        special = [t["content"] for t in vocabulary.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.known = Pieces(self)

    def piece(self, text: str) -> int:
        """Tokens of a piece that begins and ends with a pre-token."""
        return self.known[text[1:]] if text[:1] == " " else sum(self.machine.count(t.encode()) for t in self.split(text))

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """The state map of a chunk: (head, count, tail), or (text, 0, None) where no space cuts it."""
        words = text.split()
        single = len(text) - sum(map(len, words)) == len(words) - 1  # no white space is doubled or at an end
        pieces = text.split(" ") if single else self.cut(text)
        if len(pieces) == 1:
            return text, 0, None
        return pieces[0], sum(map(self.known.__getitem__, pieces[1:-1])), " " + pieces[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if a[2] is None and b[2] is None:
            return self.chunk(a[0] + b[0])
        if a[2] is None:
            return self.resolve(a[0] + b[0], b)
        if b[2] is None:
            head, n, tail = self.chunk(a[2] + b[0])
            return (a[0], a[1], head) if tail is None else (a[0], a[1] + self.piece(head) + n, tail)
        head, n, tail = self.chunk(a[2] + b[0])
        return a[0], a[1] + self.piece(head) + n + (self.piece(tail) if tail is not None else 0) + b[1], b[2]

    def resolve(self, text: str, b: tuple) -> tuple:
        head, n, tail = self.chunk(text)
        return (head, b[1], b[2]) if tail is None else (head, n + self.piece(tail) + b[1], b[2])

    def scan(self, maps: list[tuple]) -> tuple:
        """The composition of all maps, by halves."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def ordinary(self, text: str) -> int:
        if not text:
            return 0
        head, n, tail = self.scan([self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return n + self.piece(head) + (self.piece(tail) if tail is not None else 0)

    def tokens(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self.ordinary, between))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One per worker and file, so that what is compiled serves all its tasks."""
    return Counter(path)


def vocabulary_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count(docs: DataFrame, name: str = FILE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(vocabulary_path(name))
        for batch in batches:
            raw = list(texts(batch, "text"))
            n = pa.array([machine.tokens(t.decode("utf-8", "replace")) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
