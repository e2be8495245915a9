"""Words and shingles as native column expressions, and a hashing tokenizer for Arrow batches.

A word is a run of characters outside space and U+0009 to U+000D. Null texts count as empty.

Word arrays are costly to make, and the optimizer pushes a filter through the projection that made its column
by making the column twice. Callers therefore explode with ``explode_outer`` (a plain explode infers a filter on
the array's size) and don't filter on what is derived from words before an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words, in Java's and in Python's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
#: A word of five or more makes a shingle, everywhere in this subpackage.
SHINGLE = 5


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """All words of a non-null text; array<string>."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def chain(left: Column, words: Column, skip: int) -> Column:
    """Hashes one word longer: ``left`` has those of ``skip``-word windows, ``words`` those of single words."""
    n = F.greatest(F.size(words) - skip, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(words, skip + 1, n), lambda a, b: F.xxhash64(a, b))
