"""Near-duplicate documents by MinHash with tensored banding, links verified on full sets.

A document's set: the distinct shingles of ``words`` words of its text (A-Z lowered, words
are runs of characters other than blank and U+0009..U+000D).

1. One pass gives each document its set size, a 128-bit fingerprint of the set, two
   collections A and B of ``tables`` sub-keys (each of ``rows`` minimum hashes) and a parity
   bitmap. Documents with equal sets become one representative: the smallest id.
2. Tensoring: table (i, j) is keyed by the pair (A_i, B_j), so ``tables``^2 tables of
   2 * ``rows`` hashes each cost only 2 * ``tables`` * ``rows`` minimum hashes. Two documents
   of similarity s meet with probability (1 - (1 - s^rows)^tables)^2: at 0.75 and the
   default 2 x 12 all but 1 in 10,000 links, at 0.80 all but 1 in 100,000.
3. Neighbours in a bucket (in id order) are candidates first: as many pairs as rows, however
   large a bucket is. Verified links are contracted to components. Buckets that still hold
   several components are then compared completely, but only across components: every member
   has a home block of bounded size, and members outside the bucket's largest component (only
   they) visit every block. Pairs that the bitmaps cannot rule out leave the task, each from the
   first table in which the two meet, and are verified. So no link that meets in a table is
   lost, and no group of copies is expanded into its pairs.
4. The bitmap test is exact (:mod:`greenscan.llm.bitmaps`): a link allows sets to differ in at
   most a seventh of both sizes; bitmaps grow with the sets, so they tell long texts apart too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenscan.llm.bitmaps import Bitmaps, apart_at_most, parity_bits, plausible
from greenscan.llm.common import written
from greenscan.llm.components import components

BLOCK = 1024
U = np.uint64
WORD_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    percent: int = 75   # link: 100 * intersection >= percent * union
    rows: int = 2       # minimum hashes in a sub-key
    tables: int = 12    # sub-keys in each of the two collections
    seed: int = 20240607


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 (a bijection of 64-bit words)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes, in whole-array steps over its bytes."""

    BASE = U(0x9E3779B97F4A7C15)

    def __init__(self, words: int):
        self.words = words
        self.space = np.zeros(256, dtype=bool)
        self.space[list(WORD_SPACE)] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = np.ones(1, dtype=U)
        self.place = mix(np.arange(1, words + 2, dtype=U) * self.BASE) | U(1)

    def word_hashes(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        inside = ~self.space[data]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first) == 0:
            return np.empty(0, dtype=U)
        size = last - first
        longest = int(size.max())
        if longest > len(self.powers):
            self.powers = np.cumprod(np.concatenate(([U(1)], np.full(longest, self.BASE, dtype=U))), dtype=U)
        letters = self.lower[data[inside]].astype(U) + U(1)
        begin = np.cumsum(size) - size
        at = np.arange(len(letters)) - np.repeat(begin, size)
        return mix(np.add.reduceat(letters * self.powers[at], begin) + size.astype(U))

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.word_hashes(text or "")
        if len(h) == 0:
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, U(k), dtype=U)
        for j in range(k):
            total += h[j:j + n] * self.place[j]
        return np.unique(mix(total))


def _signature(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the set."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=U)
    for a in range(0, len(x), 4096):
        y = x[a:a + 4096, None] * factors
        y ^= y >> U(32)
        y *= U(0xD6E8FEB86659FD93)
        np.minimum(low, y.min(0), out=low)
    return low


SKETCH = "doc_id long, n long, f1 long, f2 long, a array<long>, b array<long>, bits array<long>"


def sketches(docs: DataFrame, params: NearDupParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        shingler = Shingler(params.words)
        m, r = params.tables, params.rows
        factors = mix(U(params.seed) + np.arange(1, 2 * m * r + 1, dtype=U) * Shingler.BASE) | U(1)
        join = mix(U(params.seed + 1) + np.arange(1, r + 1, dtype=U) * Shingler.BASE) | U(1)
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n", "f1", "f2", "a", "b", "bits")}
            for text in batch.column(1).to_pylist():
                x = shingler.shingles(text)
                cols["n"].append(len(x))
                # equal digests of the whole sorted set are the full comparison of equal sets
                f1, f2 = np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64)
                cols["f1"].append(f1)
                cols["f2"].append(f2)
                keys = mix((_signature(x, factors).reshape(2, m, r) * join).sum(2, dtype=U)) if len(x) else None
                cols["a"].append(keys[0].view(np.int64) if len(x) else [])
                cols["b"].append(keys[1].view(np.int64) if len(x) else [])
                cols["bits"].append(parity_bits(x, 1.0))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), **{c: pa.array(cols[c], pa.int64()) for c in ("n", "f1", "f2")},
                 **{c: pa.array(cols[c], longs) for c in ("a", "b", "bits")}})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, items) of (node, text): the full sets, as 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        shingler = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = [shingler.shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "items": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select("node", "text").mapInArrow(run, "node long, items array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs whose full sets are similar enough; only their documents are read again."""
    pairs = written(pairs.select("u", "v"), "candidates")
    need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = written(shingle_sets(docs.join(need, "node", "left_semi"), params.words), "sets")
    a = sets.select(F.col("node").alias("u"), F.col("items").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return written(pairs.join(a, "u").join(b, "v").where(
        shared * (100 + params.percent) >= (F.size("su") + F.size("sv")) * params.percent).select("u", "v"), "links")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) across components inside buckets, from (key, block, guest, main,
    comp, node, n, place, bits, a, b): each block's guests are compared with its members."""
    grouped = rows.repartition("key", "block").sortWithinPartitions("key", "block", "guest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, table, found = None, [], None, []

        def meet(comp_i, node_i, n_i, place, mine, a_i, b_i) -> None:
            main, comp, node, n, bits, a_keys, b_keys = table
            most = apart_at_most(n_i, n, percent)
            ok = (comp != comp_i) & (np.abs(n - n_i) <= most) & (main | (node > node_i))
            near = bits.near(mine, ok, most)
            if len(near):
                # of all tables in which the two meet, the first one tells
                first = (a_keys[near] == a_i).argmax(1) * b_keys.shape[1] + (b_keys[near] == b_i).argmax(1)
                v = node[near[first == place]]
                if len(v):
                    found.append(np.stack([np.minimum(v, node_i), np.maximum(v, node_i)], 1))

        for batch in batches:
            flat = [c.to_pylist() for c in batch.columns[:8]]
            lists = batch.columns[8:]
            for i, (key, block, guest, main, comp, node, n, place) in enumerate(zip(*flat)):
                if (key, block) != at:
                    at, home, table = (key, block), [], None
                mine, a_i, b_i = (np.array(c[i].values) for c in lists)
                if not guest:  # those at home stand first
                    home.append((main, comp, node, n, mine, a_i, b_i))
                elif home:
                    if table is None:
                        cols = list(zip(*home))
                        table = [*map(np.array, cols[:4]), Bitmaps(cols[4]), np.stack(cols[5]), np.stack(cols[6])]
                    meet(comp, node, n, place, mine, a_i, b_i)
            if found:
                u, v = np.unique(np.concatenate(found), axis=0).T
                found = []
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return grouped.select("key", "block", "guest", "main", "comp", "node", "n", "place", "bits", "a", "b") \
        .mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts with fewer words than a shingle are one shingle; null texts and texts without words
    have no set and no link. Ids name documents: rows that repeat an id are one document, whose
    texts are all compared. A row with a null id is linked to equal sets only; its component
    is the smallest id among these, null if there is none (then it is kept). Empty tables
    give no rows; other columns are ignored."""
    sketch = written(sketches(docs, params, id_col, text_col), "sketches")
    nodes = written(sketch.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b"),
        F.first("bits").alias("bits")), "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))

    width = params.tables
    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * width + j))))
    order = Window.partitionBy("key").orderBy("node")
    buckets = written(
        nodes.select("node", F.posexplode(keys).alias("place", "key"))
        .select("key", "place", "node", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"))
        .where("before is not null or after is not null").select("key", "place", "node", "before"), "buckets")

    chain = buckets.where("before <> node").select(F.col("before").alias("u"), F.col("node").alias("v")).distinct()
    links = _verified(plausible(chain, nodes, params.percent), texts, params)
    first = components(links)

    labelled = buckets.join(first, "node", "left") \
        .select("key", "place", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.count(F.lit(1)).alias("size")) \
        .where("lo <> hi and size > 2").select("key", "size")
    inside = labelled.join(written(mixed, "mixed"), "key")
    main = inside.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")) \
        .groupBy("key").agg(F.max(F.struct("k", "component"))["component"].alias("main"))
    placed = inside.join(main, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")) \
        .withColumn("main", F.col("component") == F.col("main"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    stands = F.array(F.struct(home.alias("block"), F.lit(False).alias("guest")))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda b: F.struct(b.alias("block"), F.lit(True).alias("guest")))
    rows = placed.withColumn("at", F.explode(F.when(F.col("main"), stands).otherwise(F.concat(stands, visits)))) \
        .select("key", "at.block", "at.guest", "main", F.col("component").alias("comp"), "node", "place") \
        .join(nodes.select("node", "n", "bits", "a", "b"), "node")
    more = _verified(_across(rows, params.percent), texts, params)
    named = more.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left") \
        .join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left") \
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    second = components(written(named, "links")).select(F.col("node").alias("component"), F.col("component").alias("top"))
    # nodes linked first, then by the comparison across components, else alone
    every = nodes.select("n", "f1", "f2", "node").join(first, "node", "left") \
        .withColumn("component", F.coalesce("component", "node")).join(second, "component", "left") \
        .select("n", "f1", "f2", F.coalesce("top", "component").alias("component"))
    return sketch.select("doc_id", "n", "f1", "f2").join(every, ["n", "f1", "f2"], "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def keep_one(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of the document that stays from each group, with the columns they came with.
    Rows without an id stay."""
    gone = near_duplicates(docs, params, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()) \
        .select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
