"""Interval tables over code points and their lookup in column expressions.

A range table may overlap; the first range in table order wins. A sweep over the range ends
turns it into disjoint intervals once, when the plan is built. A lookup is then a binary
search in a literal array of interval starts: no join, no regex per category, and no range is
expanded to its code points. Alphabets are interval sets, joined and cut by the same sweep.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_CP = 0x10FFFF


def literal_array(values: Iterable, kind: str) -> Column:
    """A constant array as one string literal that the optimizer folds: plans stay small and
    no driver call is made per element. Values must hold no comma."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def probes(size: Column | int) -> Column:
    """The steps of a binary search in ``size`` sorted values: powers of two, descending. For
    a column, compute it once per row."""
    if isinstance(size, int):
        return literal_array([1 << k for k in range(max(size, 1).bit_length() - 1, -1, -1)], "int")
    top = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def rank_sorted(values: Column, x: Column, steps: Column) -> Column:
    """How many of the ascending ``values`` are <= ``x`` (0 where none is)."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(values, at + step - 1) <= x, at + step).otherwise(at))


def find_sorted(keys: Column, values: Column, x: Column, steps: Column) -> Column:
    """The value of ``x`` in a dictionary of ascending ``keys``; null where it is none of them."""
    found = F.transform(F.array(rank_sorted(keys, x, steps)), lambda r: F.when(
        F.get(keys, r - 1) == x, F.get(values, r - 1)))
    return F.get(found, F.lit(0))


DIRECT = 0x800  # code points below are looked up by place: the alphabets of Latin, Greek, Cyrillic, Hebrew, Arabic


def direct(near: Column, cp: Column, far: Column) -> Column:
    """The entry of ``cp`` in ``near``, an array over the code points below ``DIRECT``; beyond
    them ``far``."""
    return F.when(cp < DIRECT, F.get(near, cp)).otherwise(far)


def disjoint(ranges: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Ranges (lo, hi, name) in table order as sorted disjoint ones; where several hold a code
    point, the first one's name stays."""
    ranges = [(lo, hi, name) for lo, hi, name in ranges if lo <= hi]
    events = sorted({lo for lo, _, _ in ranges} | {hi + 1 for _, hi, _ in ranges})
    begin: dict[int, list[int]] = {}
    for i, (lo, _, _) in enumerate(ranges):
        begin.setdefault(lo, []).append(i)
    out: list[list] = []
    active: list[int] = []  # table positions of ranges begun, the earliest on top
    for at, after in zip(events, events[1:]):
        for i in begin.get(at, ()):
            heapq.heappush(active, i)
        while active and ranges[active[0]][1] < at:
            heapq.heappop(active)
        if active:
            name = ranges[active[0]][2]
            if out and out[-1][1] == at - 1 and out[-1][2] == name:
                out[-1][1] = after - 1
            else:
                out.append([at, after - 1, name])
    return [tuple(r) for r in out]


@dataclass(frozen=True)
class IntervalTable:
    """Disjoint named intervals; ``lookup`` gives a code point's name or null."""

    starts: tuple[int, ...]
    names: tuple[str | None, ...]   # None: a gap

    @classmethod
    def of(cls, ranges: Iterable[tuple[int, int, str]]) -> "IntervalTable":
        starts, names = [], []
        for lo, hi, name in disjoint(ranges):
            if starts and starts[-1] == lo:  # the gap before ends here
                starts.pop()
                names.pop()
            starts += [lo, hi + 1]
            names += [name, None]
        return cls(tuple(starts), tuple(names))

    def ranges(self) -> list[tuple[int, int, str]]:
        ends = [*self.starts[1:], MAX_CP + 1]
        return [(lo, hi - 1, name) for lo, hi, name in zip(self.starts, ends, self.names) if name is not None]

    def lookup(self, cp: Column) -> Column:
        if not self.starts:
            return F.lit(None).cast("string")
        kinds = sorted({n for n in self.names if n is not None})
        number = {n: i for i, n in enumerate(kinds)}
        starts = literal_array(self.starts, "int")
        which = literal_array([-1 if n is None else number[n] for n in self.names], "int")
        at = rank_sorted(starts, cp, probes(len(self.starts)))
        near = literal_array([number.get(self.find(c), -1) for c in range(DIRECT)], "int")
        return F.get(F.array(*[F.lit(k) for k in kinds]), F.nullif(direct(near, cp, F.get(which, at - 1)), F.lit(-1)))

    def find(self, cp: int) -> str | None:
        from bisect import bisect_right
        at = bisect_right(self.starts, cp) - 1
        return self.names[at] if at >= 0 else None


@lru_cache(maxsize=4)
def script_table(spark: SparkSession) -> IntervalTable:
    """Scripts of all code points by the JVM's Unicode tables: one pass over the code points in
    Spark finds where the script changes; only these places (some 1,600) come to the driver."""
    of = lambda c: F.reflect(F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), c)
    cp = F.col("id").cast("int")
    rows = spark.range(MAX_CP + 1).select(cp.alias("cp"), of(cp).alias("script"), of(F.greatest(cp - 1, F.lit(0))).alias("before")) \
        .where("cp = 0 or script <> before").select("cp", "script").collect()
    rows = sorted((r["cp"], r["script"]) for r in rows)
    ends = [cp for cp, _ in rows[1:]] + [MAX_CP + 1]
    return IntervalTable.of((lo, hi - 1, name) for (lo, name), hi in zip(rows, ends) if name != "UNKNOWN")


# ------------------------------------------------------------------ interval sets

Intervals = tuple[tuple[int, int], ...]


def normal(intervals: Iterable[tuple[int, int]]) -> Intervals:
    """Sorted, disjoint and not adjacent."""
    out: list[list[int]] = []
    for lo, hi in sorted(i for i in intervals if i[0] <= i[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((lo, hi) for lo, hi in out)


def union(*sets: Iterable[tuple[int, int]]) -> Intervals:
    return normal(i for s in sets for i in s)


def intersection(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> Intervals:
    a, b = normal(a), normal(b)
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def of_chars(chars: Iterable[str]) -> Intervals:
    return normal((ord(c), ord(c)) for c in chars)


def size(intervals: Iterable[tuple[int, int]]) -> int:
    return sum(hi - lo + 1 for lo, hi in intervals)


def regex_class(intervals: Iterable[tuple[int, int]]) -> str:
    """A Java regex class of the set, for counting over whole texts in one pass."""
    parts = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in normal(intervals))
    return f"[{parts}]" if parts else "(?!)"


def regex_runs(intervals: Iterable[tuple[int, int]]) -> str:
    """A Java pattern of runs of the set: its ASCII part is told by a bit table, and no ASCII
    character is looked up in the rest."""
    low, high = intersection(intervals, ((0, 0x7F),)), intersection(intervals, ((0x80, MAX_CP),))
    parts = [regex_class(low) + "++"] if low else []
    if high:
        parts.append(rf"[[^\x00-\x7F]&&{regex_class(high)}]+")
    return "|".join(parts) or "(?!)"


def contains(intervals: Iterable[tuple[int, int]], cp: Column) -> Column:
    """Whether a code point lies in the set."""
    table = IntervalTable.of((lo, hi, "in") for lo, hi in normal(intervals))
    return table.lookup(cp).isNotNull()


__all__ = ["IntervalTable", "contains", "disjoint", "find_sorted", "intersection", "literal_array", "normal",
           "of_chars", "probes", "rank_sorted", "regex_class", "regex_runs", "script_table", "size", "union"]
