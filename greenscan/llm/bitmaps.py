"""Parity bitmaps of sets: an exact test that rules out pairs of sets that differ too much.

A bitmap has a power of two of bits in proportion to the set's size (at least ``MIN_BITS``); bit i
tells whether an odd number of elements falls on it. Folding the larger bitmap of two onto the
smaller gives that of the smaller width, and bits that differ never outnumber elements that do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
MIN_BITS = 256


def needed(n1, n2, percent: int):
    """Smallest intersection of sets of these sizes with 100 * I >= percent * U."""
    return -(-(n1 + n2) * percent // (100 + percent))


def apart_at_most(n1, n2, percent: int):
    """Most elements in which linked sets of these sizes differ."""
    return n1 + n2 - 2 * needed(n1, n2, percent)


def parity_bits(x: np.ndarray, per_element: float = 0.5) -> np.ndarray:
    """Which of 2^k bits an odd number of the elements falls on, as 64-bit words. At least
    ``per_element`` bits for each: sets that share nothing then differ in about half of them,
    which must be more than linked sets may differ in (0.5 does for limits from 90 percent on,
    1 from 75 percent on)."""
    bits = MIN_BITS
    while bits < per_element * len(x):
        bits *= 2
    odd = np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the larger folded onto the smaller."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count((a ^ b).view(U)).sum())  # of signed words it would count absolute values


class Bitmaps:
    """The bitmaps of a block's rows, one matrix for each width, folded on demand."""

    def __init__(self, bits: list[np.ndarray]):
        widths = np.array([len(b) for b in bits])
        self.at = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.folded = {(w, w): np.stack([bits[i] for i in at]) for w, at in self.at.items()}

    def _fold(self, w: int, to: int) -> np.ndarray:
        if (w, to) not in self.folded:
            m = self._fold(w, to * 2)
            self.folded[w, to] = m[:, :to] ^ m[:, to:]
        return self.folded[w, to]

    def near(self, mine: np.ndarray, ok: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of the rows flagged in ``ok``, those at most ``most`` bits away from ``mine``."""
        found = []
        for w, at in self.at.items():
            rows = np.flatnonzero(ok[at])
            if len(rows):
                to = min(w, len(mine))
                own = np.bitwise_xor.reduce(mine.reshape(-1, to), 0)
                apart = np.bitwise_count((self._fold(w, to)[rows] ^ own).view(U)).sum(1, dtype=np.int64)
                found.append(at[rows[apart <= most[at[rows]]]])
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ``nodes`` (node, n, bits) that sizes and bitmaps cannot rule out."""
    a = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            most = apart_at_most(nu, nv, percent)
            ok = np.abs(nu - nv) <= most
            bu, bv = batch.column("bu"), batch.column("bv")
            for i in np.flatnonzero(ok):
                ok[i] = bits_apart(bu[i].values.to_numpy(), bv[i].values.to_numpy()) <= most[i]
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")
