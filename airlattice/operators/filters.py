"""Recursive filters over ordered series of any size, as scans of affine maps.

A filter of order p keeps a state of p numbers, and a stretch of samples maps the state before it to the state after it by
s -> A**n s + r, where r is what the stretch leaves when it starts from nothing. Such maps compose, so a series may be cut
anywhere: one pass over the segments yields r for the keys at their edges, the maps are composed in the order of
segments (twice as many rows as segments at most), and a second pass filters each segment from its own start. Within a
segment the same is done in numpy by blocks of ``BLOCK`` samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from math import pi, tan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .segments import segmented

BLOCK = 64


def butterworth(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth low-pass: poles on a circle, warped, mapped to the unit disc; all zeros at -1."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cutoff must lie between 0 and half the rate")
    circle = 4 * tan(pi * cutoff / rate) * np.exp(1j * pi * (2 * np.arange(order) + order + 1) / (2 * order))
    a = np.poly((4 + circle) / (4 - circle)).real
    b = np.poly(-np.ones(order))
    return b * (a.sum() / b.sum()), a  # no gain at rest


@dataclass(frozen=True)
class Filter:
    """y = C s + d x, s' = A s + B x."""

    A: np.ndarray
    B: np.ndarray
    C: np.ndarray
    d: float

    @staticmethod
    def of(b: np.ndarray, a: np.ndarray) -> Filter:
        p = len(a) - 1
        A = np.eye(p, k=1)
        A[:, 0] -= a[1:]
        return Filter(A, b[1:] - a[1:] * b[0], np.eye(p)[0], float(b[0]))

    def rest(self) -> np.ndarray:
        """The state in which a constant input of 1 stays at 1."""
        return np.linalg.solve(np.eye(len(self.B)) - self.A, self.B)

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.A, n)

    @cached_property
    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: state before it -> state after it, state before it -> its outputs, its samples -> state after it, its samples -> its outputs."""
        powers = [np.eye(len(self.B))]
        for _ in range(BLOCK):
            powers.append(self.A @ powers[-1])
        out = np.array([self.C @ P for P in powers[:BLOCK]])
        into = np.array([P @ self.B for P in powers[BLOCK - 1 :: -1]])
        echo = np.concatenate([[self.d], out[:-1] @ self.B])
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        return powers[BLOCK], out, into, np.where(lag >= 0, echo[lag], 0.0)

    def settled(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Output of many series that follow one another in ``x``, of ``n`` samples each, from rest at their first ones.

        Their blocks are filtered together; only the states go from block to block, of all series at once.
        """
        over, out, into, own = self.blocks
        m = -(-n // BLOCK)
        first, start = np.cumsum(m) - m, np.cumsum(n) - n
        at = np.arange(len(x)) + np.repeat(first * BLOCK - start, n)
        blocks = np.zeros((m.sum(), BLOCK))
        blocks.ravel()[at] = x
        left, states = blocks @ into, np.empty((len(blocks), len(self.B)))
        state, going = np.outer(x[start], self.rest()), np.arange(len(n))
        for k in range(m.max(initial=0)):
            if k:
                goes = m[going] > k
                state, going = state[goes] @ over.T + left[first[going[goes]] + k - 1], going[goes]
            states[first[going] + k] = state
        return (blocks @ own.T + states @ out.T).ravel()[at]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and the state after it; blocks by matrices, their states one after the other."""
        m, p = len(x) // BLOCK, len(self.B)
        y = np.empty(len(x))
        if m:
            over, out, into, own = self.blocks
            blocks = x[: m * BLOCK].reshape(m, BLOCK)
            left, states = blocks @ into, np.empty((m, p))
            for k in range(m):
                states[k] = state
                state = over @ state + left[k]
            y[: m * BLOCK] = (blocks @ own.T + states @ out.T).ravel()
        for k in range(m * BLOCK, len(x)):
            y[k] = self.C @ state + self.d * x[k]
            state = self.A @ state + self.B * x[k]
        return y, state


def _runs(keys: list) -> Iterator[tuple[object, slice]]:
    """Stretches of equal keys, as slices."""
    at = 0
    for key, group in groupby(keys):
        n = sum(1 for _ in group)
        yield key, slice(at, at + n)
        at += n


def _key(frame: pd.DataFrame, keys: list[str]) -> list[tuple]:
    """Rows' keys; a missing one is None."""
    return list(zip(*[frame[k].astype(object).where(frame[k].notna(), None).tolist() for k in keys], strict=True))


def _edges(f: Filter, keys: list[str], x: str, settle: bool):
    """One row for the first and one for the last key of a segment: what it leaves from nothing, or from its own start if it starts here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = key = None
        segment, n, state, head = -1, 0, None, 0.0
        for frame in frames:
            values = frame[x].to_numpy(dtype=float)
            for k, span in _runs(_key(frame, keys)):
                if k != key:
                    if key is not None and first is None:
                        first = (n, state, head)
                    key, n, head, state = k, 0, values[span.start], np.zeros(len(f.B))
                    if first is not None and settle:
                        state = f.rest() * head
                n += span.stop - span.start
                state = f.run(values[span], state)[1]
            segment = int(frame["_segment"].iloc[-1]) if len(frame) else segment
        if key is not None:
            single = first is None
            rows = [(segment, True, single, *((n, state, head) if single else first))]
            if not single:
                rows.append((segment, False, True, n, state, head))
            yield pd.DataFrame(rows, columns=["segment", "first", "last", "n", "state", "head"])

    return run


def _starts(d: DataFrame, f: Filter, keys: list[str], x: str, settle: bool) -> dict[int, list[float]]:
    """The state that a segment's first key takes over, for the segments whose first key goes on from the one before."""
    ends = d.groupBy("_segment").agg(F.min_by(F.struct(*keys), "_at").alias("a"), F.max_by(F.struct(*keys), "_at").alias("b")).orderBy("_segment").collect()  # a row a segment
    goes_on = {now["_segment"] for last, now in zip(ends, ends[1:]) if last["b"] == now["a"]}
    if not goes_on:
        return {}
    edges = d.select(*keys, x, "_segment").mapInPandas(_edges(f, keys, x, settle), "segment int, first boolean, last boolean, n long, state array<double>, head double").collect()  # two rows a segment
    start, carried = {}, np.zeros(len(f.B))
    for e in sorted(edges, key=lambda e: (e["segment"], not e["first"])):
        state = np.array(e["state"])
        if e["first"]:
            if e["segment"] in goes_on:
                start[e["segment"]] = carried.tolist()
                state = state + f.power(e["n"]) @ carried
            elif settle:
                state = state + f.power(e["n"]) @ (f.rest() * e["head"])
        if e["last"]:
            carried = state
    return start


def recursive(d: DataFrame, f: Filter, keys: list[str], x: str, name: str, settle: bool = False) -> DataFrame:
    """Adds the filtered ``x`` to what ``segments.segmented`` laid out by ``keys``.

    A series starts from nothing, or with ``settle`` from rest at its first value. ``x`` may not be null.
    """
    starts = _starts(d, f, keys, x, settle)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        opening = True
        for frame in frames:
            values = frame[x].to_numpy(dtype=float)
            out = np.empty(len(values))
            for k, span in _runs(_key(frame, keys)):
                if k != key:
                    state = f.rest() * values[span.start] if settle else np.zeros(len(f.B))
                    if opening:
                        state = np.array(starts.get(int(frame["_segment"].iloc[0]), state))
                    key, opening = k, False
                out[span], state = f.run(values[span], state)
            yield frame.assign(**{name: out})

    return d.mapInPandas(run, StructType([*[x for x in d.schema.fields if x.name != name], StructField(name, DoubleType())]))


def lowpass(df: DataFrame, keys: list[str], order: list[str], x: str, cutoff: float, rate: float, name: str, degree: int = 1, parts: int | None = None) -> DataFrame:
    """Adds the causal Butterworth low-pass of ``x``, from a zero state."""
    d = segmented(df, keys, order, parts)
    return recursive(d, Filter.of(*butterworth(degree, cutoff, rate)), keys, x, name).drop("_at", "_segment")


def both_ways(f: Filter, x: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    """``zero_phase`` of many series that follow one another in ``x``, of ``n`` samples each."""
    y, long = x.copy(), n > pad
    start, n = (np.cumsum(n) - n)[long], n[long]
    if not len(n):
        return y
    wide = n + 2 * pad
    p = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide + pad, wide)
    first, last = np.repeat(start, wide), np.repeat(n - 1, wide)
    v = x[first + np.where(p > last, 2 * last - p, np.abs(p))]
    v = np.where(p < 0, 2 * x[first] - v, np.where(p > last, 2 * x[first + last] - v, v))
    v = f.settled(f.settled(v, wide)[::-1], wide[::-1])[::-1]
    own = (p >= 0) & (p <= last)
    y[(first + p)[own]] = v[own]
    return y


def whole_series(place: str, each: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
    """For mapInPandas over series in order, that are numbered from 0 by ``place``: ``each`` gets whole series and their lengths."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the series that the last frame cut

        def done() -> Iterator[pd.DataFrame]:
            if any(map(len, held)):
                d = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                yield each(d, np.diff(np.append(np.flatnonzero(d[place].to_numpy() == 0), len(d))))

        for frame in frames:
            starts = np.flatnonzero(frame[place].to_numpy() == 0)
            if len(starts):
                held.append(frame.iloc[: starts[-1]])
                yield from done()
                held = [frame.iloc[starts[-1] :]]
            else:
                held.append(frame)
        yield from done()

    return run


def zero_phase(df: DataFrame, keys: list[str], place: str, x: str, cutoff: float, rate: float, name: str, degree: int = 4, parts: int | None = None) -> DataFrame:
    """Adds the low-pass of ``x`` run forwards and backwards, so that nothing is delayed.

    ``place`` numbers the rows of a series from 0 without gaps. Series are extended at both ends by their reflection
    about the end point over three times the filter's length, and each pass starts at rest. A series no longer than that
    extension is left as it is.
    """
    f = Filter.of(*butterworth(degree, cutoff, rate))
    pad = 3 * (degree + 1)
    names = [f"_k{j}" for j in range(len(keys))]

    def beside(other: DataFrame) -> tuple[DataFrame, list]:
        """With its keys renamed, and the condition to meet by."""
        return other.withColumnsRenamed(dict(zip(keys, names, strict=True))), [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]

    ends, same = beside(df.groupBy(*keys).agg(F.max(place).alias("_last"), F.min_by(x, place).alias("_head"), F.max_by(x, place).alias("_tail")))
    met = df.join(ends.where(F.col("_last") >= pad), same)
    at, v = F.col(place), F.col(x).cast("double")
    own = F.struct(at.cast("long").alias("p"), v.alias("v"), F.lit(True).alias("own"))
    head = F.when(at.between(1, pad), F.struct((-at).cast("long").alias("p"), (2 * F.col("_head") - v).alias("v"), F.lit(False).alias("own")))
    tail = F.when((at >= F.col("_last") - pad) & (at < F.col("_last")), F.struct((2 * F.col("_last") - at).cast("long").alias("p"), (2 * F.col("_tail") - v).alias("v"), F.lit(False).alias("own")))
    wide = met.select(*keys, F.explode(F.array_compact(F.array(own, head, tail))).alias("e")).select(*keys, "e.*")
    ahead = recursive(segmented(wide, keys, ["p"], parts), f, keys, "v", "w", settle=True).drop("_at", "_segment")
    back = recursive(segmented(ahead, keys, [F.desc("p")], parts), f, keys, "w", "y", settle=True).where("own")
    back, same = beside(back.select(*keys, F.col("p").alias("_p"), F.col("y").alias("_y")))
    met = df.join(back, [*same, F.col(place) == F.col("_p")], "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.coalesce(F.col("_y"), F.col(x).cast("double")).alias(name))
