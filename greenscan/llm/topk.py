"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors are dealt by a hash of their ids into shards of bounded size. A task reads a shard's
vectors, builds their tree once, and then answers the queries as they stream by, in blocks of
bounded size. The nodes of a tree are bounded by q.c + |q| r (centre c, radius r); each query
visits leaves from its highest bound down and stops at the first leaf whose bound is below its
current k-th score; queries of a block that visit the same leaf share one product. Each query
first meets its own shard; the k-th score found there is shared with all other shards, where
the search starts from it.

Scores are exact: components are floored to integers first, and bounds only skip leaves.
Products are made in doubles where these are exact, in 64-bit integers where no sum can pass
them, else in integers of any size; a score beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenscan.llm.common import written

LEAF = 256
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, x as double. Rows with a null id, a
    null vector, a null or a non-finite component take no part; a component whose integer does
    not fit 64 bits raises. An empty vector is one of no dimension."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False))
    whole = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, finite)
    limit = float(2 ** 63)

    def integer(e: Column) -> Column:
        y = e * scale
        fits = (y < limit) & (y >= -limit)
        return F.when(fits, F.floor(F.when(fits, y).otherwise(0.0)).cast("bigint")) \
            .otherwise(F.raise_error(F.concat(F.lit("component beyond 64 bits: "), e.cast("string"))).cast("bigint"))

    return rows.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, integer).alias("v"))


# ---------------------------------------------------------------- one shard, in numpy

@dataclass
class BallTree:
    order: np.ndarray      # row numbers, leaf by leaf
    first: np.ndarray      # leaf -> first place in order
    last: np.ndarray
    centre: np.ndarray     # node -> centre, all nodes, parents before children
    radius: np.ndarray
    parent: np.ndarray
    leaf_node: np.ndarray  # leaf -> node
    largest: float         # component


def build_tree(x: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Split at the median along the line between two far points, down to ``leaf`` rows."""
    centre, radius, parent, leaf_node, spans, parts = [], [], [], [], [], []
    todo, placed = [(np.arange(len(x)), -1)], 0
    while todo:
        rows, up = todo.pop()
        c = x[rows].mean(0)
        d = ((x[rows] - c) ** 2).sum(1)
        node = len(centre)
        centre.append(c)
        radius.append(float(np.sqrt(d.max())))
        parent.append(up)
        if len(rows) <= leaf or d.max() == 0:  # equal vectors stay in one leaf
            leaf_node.append(node)
            spans.append((placed, placed + len(rows)))
            parts.append(rows)
            placed += len(rows)
            continue
        a = x[rows[d.argmax()]]
        b = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]]
        side = np.argsort((x[rows] - a) @ (b - a), kind="stable")
        half = len(rows) // 2
        todo += [(rows[side[half:]], node), (rows[side[:half]], node)]
    first, last = np.array(spans, dtype=np.int64).T
    return BallTree(np.concatenate(parts), first, last, np.array(centre), np.array(radius),
                    np.array(parent), np.array(leaf_node), float(np.abs(x).max(initial=0)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: float64 or int64."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) \
        * max(1, queries.shape[1])
    if most < 2 ** 53:  # every partial sum is exact
        return queries.astype(float) @ vectors.astype(float).T
    if most < 2 ** 62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    if exact.size and (exact.max() >= 2 ** 63 or exact.min() < -2 ** 63):
        raise OverflowError("an inner product beyond 64 bits")
    return exact.astype(np.int64)


def search(tree: BallTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
           k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores) of each query's k best vectors that score its floor at least,
    its own id left out. ``floors``: float, -inf for none."""
    n, leaves = len(queries), len(tree.first)
    q = queries.astype(float)
    slack = 1e-9 * (1.0 + np.abs(q).sum(1) * tree.largest)
    bound = q @ tree.centre.T + np.linalg.norm(q, axis=1)[:, None] * tree.radius + slack[:, None]
    for node in range(1, bound.shape[1]):  # a child's bound is no better than its parent's
        np.minimum(bound[:, node], bound[:, tree.parent[node]], out=bound[:, node])
    best = bound[:, tree.leaf_node]
    order = np.argsort(-best, axis=1, kind="stable")
    got: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    kth = floors.astype(float).copy()
    alive = np.arange(n)
    for step in range(leaves):
        leaf = order[alive, step]
        on = best[alive, leaf] >= kth[alive]
        alive, leaf = alive[on], leaf[on]
        if not len(alive):
            break
        for x in np.unique(leaf):
            rows = tree.order[tree.first[x]:tree.last[x]]
            asking = alive[leaf == x]
            score = products(queries[asking], vectors[rows])
            for i, s in zip(asking, score):
                keep = np.flatnonzero(s >= kth[i])
                keep = keep[ids[rows[keep]] != query_ids[i]]
                if not len(keep):
                    continue
                found_ids, found = ids[rows[keep]], s[keep].astype(np.int64)
                if got[i]:
                    found_ids, found = np.concatenate([got[i][0][0], found_ids]), np.concatenate([got[i][0][1], found])
                if len(found) > k:
                    top = np.lexsort((found_ids, -found))[:k]
                    found_ids, found = found_ids[top], found[top]
                got[i] = [(found_ids, found)]
                if len(found) == k:  # below: scores as doubles may round up, so one step down
                    kth[i] = max(kth[i], np.nextafter(float(found.min()), -np.inf) if abs(int(found.min())) >= 2 ** 53
                                 else float(found.min()))
    rows = [i for i in range(n) if got[i]]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return (np.repeat(rows, [len(got[i][0][0]) for i in rows]), np.concatenate([got[i][0][0] for i in rows]),
            np.concatenate([got[i][0][1] for i in rows]))


ROW = "dim int, shard int, copy int, asks boolean, id long, low double, v array<long>"


def _search_shards(k: int, block_rows: int):
    """mapInArrow function over (ROW), sorted so that a shard's vectors stand before the queries
    that meet it: holds one shard, its tree and one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, tree, vectors, all_ids = None, [], [], None, None, None

        def answer(q_ids: np.ndarray, lows: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(q), block_rows):
                at, found, score = search(tree, vectors, all_ids, q[a:a + block_rows], q_ids[a:a + block_rows], k,
                                          lows[a:a + block_rows])
                if len(at):
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[a:a + block_rows][at], "vec_id": found, "score": score})

        for batch in batches:
            if not batch.num_rows:
                continue
            dim, shard, copy, asks, row_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            low = batch.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(copy) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, batch.num_rows]):
                here = (int(dim[a]), int(shard[a]), int(copy[a]))
                if here != key:
                    key, ids, parts, tree = here, [], [], None
                v = batch.column(6).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, here[0])
                if not asks[a]:
                    ids.append(row_ids[a:b])
                    parts.append(np.array(v))
                    continue
                if tree is None and parts:
                    all_ids, vectors = np.concatenate(ids), np.concatenate(parts)
                    tree = build_tree(vectors.astype(float))
                if tree is not None:
                    yield from answer(row_ids[a:b], low[a:b], np.array(v))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shards: int | None = None,
          shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """The k highest-scoring vectors of every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries`` have (vec_id, v) as ``integer_vectors`` makes them; a query
    meets vectors of its own dimension, never its own id; ties go to the smaller vec_id.
    Fewer candidates than k are all returned; none give no row. Repeated query rows are
    answered once; repeated candidate rows each take a rank. ``shards`` defaults to the
    vector count over ``shard_rows``. Where there are fewer shards than task slots, each is
    copied so often that its queries are dealt over all slots. Scores beyond 64 bits raise."""
    spark = vectors.sparkSession
    held = written(vectors.select("vec_id", "v"), "vectors")
    asked = written(queries.select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    if shards is None:
        shards = max(1, -(-held.count() // shard_rows))
    copies = max(1, -(-spark.sparkContext.defaultParallelism // shards))
    # rows that share an id are dealt by their place too, so no id makes a shard of its own
    shard: Column = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    home: Column = F.pmod(F.xxhash64("query_id", "v"), F.lit(shards)).cast("int")
    copy: Column = F.pmod(F.xxhash64(F.lit("copy"), "query_id"), F.lit(copies)).cast("int")
    left = held.select(F.size("v").alias("dim"), shard.alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(False).alias("asks"),
                       F.col("vec_id").alias("id"), F.lit(None).cast("double").alias("low"), "v")
    right = asked.select(F.size("v").alias("dim"), home.alias("home"), copy.alias("copy"), "query_id", "v")

    def searched(rows: DataFrame) -> DataFrame:
        asks = rows.select("dim", "shard", "copy", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "low", "v")
        keys = ["dim", "shard", "copy"]
        return left.unionByName(asks).repartition(*keys).sortWithinPartitions(*keys, "asks") \
            .mapInArrow(_search_shards(k, block_rows), FOUND)

    def ranked(rows: DataFrame) -> DataFrame:  # at most k rows of a query come from each shard
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(searched(right.withColumn("shard", F.col("home"))
                             .withColumn("low", F.lit(None).cast("double"))), "home")
    # as a double the k-th score may be rounded up: one step down keeps the search complete
    kth = F.min("score")
    shared = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, kth.cast("double") - F.when(
        F.abs(kth) >= 2 ** 53, F.lit(4096.0)).otherwise(0.0)).alias("low"))
    others = right.join(shared, "query_id", "left") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) \
        .where(F.col("shard") != F.col("home"))
    rest = searched(others)
    return ranked(first.unionByName(rest)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def oracle(every: int, k: int = 20, scale: int = 64) -> str:
    """DuckDB SQL: all products of the query set, ranked."""
    return f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM ok WHERE vec_id % {every} = 0) q
  JOIN ok c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
