"""Best-fit packing by length patterns fitted with non-negative least squares.

1. Every document is encoded whole, an end id is added, and only documents longer than a
   sequence are cut. The task numbers its pieces of each length as it goes.
2. The histogram of piece lengths has at most ``capacity`` rows whatever the corpus holds;
   the plan is made from it alone: patterns of one, two or three lengths that fill a
   sequence exactly are enumerated, their repeat counts are fitted to the histogram by
   non-negative least squares and rounded down to what the histogram still holds, and the
   residual lengths are packed best fit, longest first, whole patterns at a time.
3. The n-th piece of a length takes the n-th place that the plan has for this length. The
   plan is a table of runs (length, first rank, first sequence, offset), bounded by the
   number of patterns, so it travels with the tasks; the rank is the task's own number plus
   a prefix sum over tasks. No group of pieces is ever gathered.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenscan.llm.common import written
from greenscan.llm.tokenizing import encoder, no_gc

PIECES = ("doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long")


def token_pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                 cached_words: int = 400_000) -> DataFrame:
    """One row per piece: at most ``capacity`` ids of one document, in document order.

    ``task`` and ``nth`` number the pieces of equal length inside the task. A null or empty
    text is one piece holding the end id; null ids and repeated rows are pieces like any
    other; very long texts are cut, never dropped; other columns are ignored. ``cached_words``
    trades a worker's memory for time, not results."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path, cached_words)
        end = np.array([end_id], dtype=enc.dtype)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = np.concatenate([enc.ids(text), end]).astype("<u4")
                for k, start in enumerate(range(0, len(full), capacity)):
                    part = full[start:start + capacity]
                    n = len(part)
                    rows.append((doc_id, k, start, n, zlib.crc32(part.tobytes()), task, int(seen[n])))
                    seen[n] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")
            columns = zip(*rows) if rows else [[]] * len(names)
            out = {n: pa.array(list(c), k) for n, k, c in zip(names, kinds, columns)}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            yield from cut(batches)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- the plan, from the histogram

def few_document_patterns(hist: np.ndarray, capacity: int, per_length: int = 16) -> np.ndarray:
    """Patterns (a, b, c) with a >= b >= c and a + b + c = capacity, 0 for no document: all
    single lengths and pairs, and for every length triples whose second lengths are spread
    evenly over the mass of the histogram."""
    support = np.flatnonzero(hist)
    have = hist > 0
    found = [(capacity, 0, 0)] if capacity < len(hist) and hist[capacity] else []
    for a in support[support >= (capacity + 1) // 2]:
        if 0 < capacity - a and have[capacity - a]:
            found.append((int(a), int(capacity - a), 0))
    mass = np.cumsum(hist)
    for a in support[support >= (capacity + 2) // 3]:
        rest = int(capacity - a)
        low, high = (rest + 1) // 2, min(int(a), rest - 1)
        if high < low:
            continue
        below, above = mass[low - 1], mass[high]
        if above == below:
            continue
        marks = below + (np.arange(per_length) + 0.5) * (above - below) / per_length
        for b in np.unique(np.searchsorted(mass, marks, side="left")):
            b = int(min(max(b, low), high))
            c = rest - b
            if have[b] and have[c]:
                found.append((int(a), b, c))
    return np.array(sorted(set(found), reverse=True), dtype=np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, A the lengths used by each pattern.

    Non-negative least squares by the multiplicative rule x <- x * (A'h) / (A'A x), which
    keeps x non-negative and never raises the error, on the sparse pattern index alone."""
    flat, n = patterns.ravel(), len(hist)
    used = (flat > 0).astype(float)
    h = hist.astype(float)
    target = (h[flat] * used).reshape(-1, 3).sum(1)
    uses = np.bincount(flat, weights=used, minlength=n)
    share = np.where(flat > 0, h[flat] / np.maximum(uses[flat], 1), np.inf).reshape(-1, 3).min(1)
    x = np.maximum(share, 1e-9)
    for _ in range(rounds):
        made = np.bincount(flat, weights=np.repeat(x, 3) * used, minlength=n)
        x *= target / np.maximum((made[flat] * used).reshape(-1, 3).sum(1), 1e-12)
    return x


def plan_sequences(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(pattern, repeats)]: every length of the histogram is used exactly as often as it occurs."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        for v in pattern:
            left[v] -= times
        plan.append((pattern, times))

    patterns = few_document_patterns(left, capacity)
    if len(patterns):
        x = np.floor(fit_counts(patterns, left) + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            pattern = tuple(int(v) for v in patterns[i] if v)
            need = {v: pattern.count(v) for v in pattern}
            times = min(int(x[i]), *(int(left[v]) // k for v, k in need.items()))
            if times > 0:
                take(pattern, times)
    lengths = [int(v) for v in np.flatnonzero(left)]  # ascending; lengths that are left
    while lengths:
        pattern, room = [], capacity
        need: dict[int, int] = {}
        while True:  # best fit: the longest length that fits and is still there
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= need.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            v = lengths[at]
            fits = min(room // v, int(left[v]) - need.get(v, 0))
            need[v] = need.get(v, 0) + fits
            pattern += [v] * fits
            room -= v * fits
        take(tuple(pattern), min(int(left[v]) // k for v, k in need.items()))
        for v in need:
            if left[v] == 0:
                lengths.remove(v)
    return plan


def plan_runs(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as runs sorted by (length, first rank): the piece of that length and rank
    first + i goes to sequence + i * step at ``offset``."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset, k = 0, 0
        while k < len(pattern):
            rows.append((pattern[k], rank.get(pattern[k], 0), sequence, offset))
            rank[pattern[k]] = rank.get(pattern[k], 0) + times
            offset += pattern[k]
            k += 1
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of ``token_pieces`` (written first,
    so that numbers and rows belong together however often a task runs)."""
    rows = written(pieces, "pieces")
    per_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(per_task.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # <= capacity rows
        hist[r["length"]] = r["n"]
    runs = plan_runs(plan_sequences(hist, capacity))
    key = (runs["length"] << 44) | runs["first"]
    ranked = rows.join(starts.select("length", "task", "ahead"), ["length", "task"]) \
        .withColumn("rank", F.col("nth") + F.col("ahead")).drop("task", "nth", "ahead")
    at = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at.index("length")).to_numpy().astype(np.int64)
            rank = batch.column(at.index("rank")).to_numpy()
            i = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            out = {c: batch.column(k) for k, c in enumerate(at) if c != "rank"}
            out["sequence_id"] = pa.array(runs["sequence"][i] + (rank - runs["first"][i]), pa.int64())
            out["offset"] = pa.array(runs["offset"][i], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in at if c != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_words: int = 400_000) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32 (unsigned crc32 of
    the ids as little-endian uint32), sequence_id, offset, and the ids if ``with_ids``."""
    out = pack(token_pieces(docs, vocabulary_path, end_id, capacity, id_col, text_col, with_ids, cached_words), capacity)
    keep = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
            "sequence_id", "offset"]
    return out.select(*keep, *(["ids"] if with_ids else []))
