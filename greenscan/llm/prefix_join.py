"""Exact Jaccard self-join of n-gram sets by a grouped prefix join, as components.

A document's set: the distinct runs of ``words`` words of its text. Sets with
100 * intersection >= percent * union are linked. Equal sets are one node from the start.

1. Order. One pass counts shingles in a table of ``slots`` counters (fixed size); the level
   of a counter (half powers of two) and then the hash order all shingles, rare ones first.
   Any common order gives exact results; this one keeps passages that many documents share
   out of the prefixes. A link needs ceil(percent * n / 100) common elements, so two linked
   sets meet within their first n - ceil(percent * n / 100) + 1 elements.
2. Groups. Nodes with equal prefixes and sizes are one group; only groups are spread over the
   elements of their prefix, one row per element and group, whatever the number of members.
3. Group pairs. Within an element's list, groups are paired with the first one by position
   (the text that others were made from has the fewest rare elements, so it stands first) and
   with the one before them; sizes and positions filter. Lists of very frequent elements are
   cut into ``SPLITS`` parts, whose first groups are paired in the same way. Members of a group
   are paired with its first one. Pairs pass the parity bitmap, then their full sets are
   verified. That makes at most three pairs per row, however large a list or a group is.
4. Expansion. Lists that still hold several components are expanded to members and compared
   across components: every member has a home block, and members outside the list's largest
   component visit every block. Sizes, positions and bitmaps filter; what is left is verified.
   A link that no pair of step 3 showed is found here.

Bitmaps have a power of two of bits of at least half the set's size; folding the larger one
onto the smaller keeps the test exact: bits that differ never outnumber elements that do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenscan.llm.bitmaps import Bitmaps, needed, parity_bits, plausible
from greenscan.llm.common import written
from greenscan.llm.components import components
from greenscan.llm.minhash import Shingler, mix

U = np.uint64
CHUNK = 4096          # counters in one row on their way to the sum
BLOCK = 1024          # members of a list that have their home in one block
SPLITS = 64           # parts of a hot list
HOT = 1 << 16         # sets on a counter from which its elements' lists are cut, if also
HOT_SHARE = 8         # so many times the mean counter


@dataclass(frozen=True)
class JoinParams:
    words: int = 3
    percent: int = 90     # link: 100 * intersection >= percent * union
    slots: int = 1 << 20  # counters of the shingle order


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_levels(texts: DataFrame, params: JoinParams) -> tuple[np.ndarray, int]:
    """Level of every counter (twice the binary logarithm of how many sets' elements fall
    there), and the level from which elements are hot. Tasks send their counters in chunks,
    which are added up by chunk: rows and memory are bounded by ``slots``; the result has one
    byte for each counter."""
    slots, words = params.slots, params.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        shingler, held, waiting, total = Shingler(words), [], 0, np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                x = shingler.shingles(text.as_py())
                held.append((x & U(slots - 1)).astype(np.int64))
                waiting += len(x)
                if waiting > slots:
                    total += np.bincount(np.concatenate(held), minlength=slots)
                    held, waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(held), minlength=slots)
        if total.any():
            rows = total.reshape(-1, min(CHUNK, slots))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(rows)), pa.int32()),
                                              "counts": pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(c.as_py(), dtype="<u4").astype(np.int64)
                sums[k] = sums[k] + c if k in sums else c
        if sums:
            levels = [(2 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes() for c in sums.values()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "levels": levels,
                                              "total": [int(c.sum()) for c in sums.values()]})

    chunks = texts.mapInArrow(count, "chunk int, counts binary").repartition("chunk") \
        .mapInArrow(add, "chunk int, levels binary, total long").collect()
    out = np.zeros(slots, dtype=np.uint8)
    width = min(CHUNK, slots)
    for r in chunks:
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["levels"], dtype=np.uint8)
    hot = max(HOT, HOT_SHARE * sum(r["total"] for r in chunks) // slots)
    return out, int(2 * np.log2(hot))


PROFILE = "doc_id long, th long, n long, f1 long, f2 long, g1 long, g2 long, prefix array<long>, hot array<long>, bits array<long>"


def profiles(rows: DataFrame, levels: np.ndarray, hot: int, params: JoinParams) -> DataFrame:
    """Of every (doc_id, th, text): set size, fingerprint of the set (f1, f2) and of its prefix
    (g1, g2), the prefix, its hot elements (seldom any) and the parity bitmap."""
    words, percent, mask = params.words, params.percent, params.slots - 1
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(levels)  # ``slots`` bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        shingler, level = Shingler(words), shared.value
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n", "f1", "f2", "g1", "g2", "prefix", "hot", "bits")}
            for text in batch.column(2):
                x = shingler.shingles(text.as_py())
                first = often = np.empty(0, dtype=U)
                if len(x):
                    rank = level[(x & U(mask)).astype(np.int64)]
                    p = prefix_length(len(x), percent)
                    # x ascends, so a stable sort by level gives (level, hash) order
                    at = np.argsort(rank, kind="stable")[:p]
                    first, often = x[at], x[at[rank[at] >= hot]]
                cols["n"].append(len(x))
                for c, s in (("f", x), ("g", first)):
                    cols[c + "1"].append(mix(s + U(1)).sum(dtype=U).view(np.int64))
                    cols[c + "2"].append(mix(s * U(3) + U(7)).sum(dtype=U).view(np.int64))
                cols["prefix"].append(first.view(np.int64))
                cols["hot"].append(often.view(np.int64))
                cols["bits"].append(parity_bits(x))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "th": batch.column(1),
                 **{c: pa.array(cols[c], pa.int64()) for c in ("n", "f1", "f2", "g1", "g2")},
                 **{c: pa.array(cols[c], longs) for c in ("prefix", "hot", "bits")}})

    return rows.mapInArrow(run, PROFILE)


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs of nodes whose full sets are linked; only their texts are read again."""
    need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = written(nodes.select("node", "doc_id", "th").join(need, "node", "left_semi"), "needed")
    texts = rows.join(keys.withColumnRenamed("doc_id", "key"), (rows["th"] == keys["th"]) & F.col("key").eqNullSafe(rows["doc_id"])) \
        .select("node", "text")
    words = params.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        shingler = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "items": pa.array(
                    [shingler.shingles(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))})

    # rows that repeat an id and its text carry the same set
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(run, "node long, items array<long>"), "sets")
    a = sets.select(F.col("node").alias("u"), F.col("items").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("sv"))
    percent = params.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            su, sv = batch.column("su"), batch.column("sv")
            ok = []
            for i in range(batch.num_rows):
                x, y = su[i].values.to_numpy(), sv[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * (100 + percent) >= (len(x) + len(y)) * percent)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(compare, "u long, v long"), "links")


def _plausible(pairs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """Distinct pairs that pass sizes and bitmaps, written."""
    return written(plausible(pairs.distinct(), nodes, params.percent), "candidates")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share an element, from (token, block, guest,
    main, comp, node, n, pos, bits): each block's guests (members outside the list's main
    component, all of them) are compared with the members at home there."""
    grouped = rows.repartition("token", "block").sortWithinPartitions("token", "block", "guest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, table, found = None, [], None, []

        def meet(comp_i: int, node_i: int, n_i: int, pos_i: int, mine: np.ndarray) -> None:
            main, comp, node, n, pos = table[0]
            need = needed(n_i, n, percent)
            most = n_i + n - 2 * need
            # what stands before the shared element and what follows bound the intersection
            ok = (comp != comp_i) & (np.abs(n - n_i) <= most) & (main | (node > node_i)) \
                & (np.minimum(n - pos, n_i - pos_i) + np.minimum(pos, pos_i) >= need)
            v = node[table[1].near(mine, ok, most)]
            if len(v):
                found.append(np.stack([np.minimum(v, node_i), np.maximum(v, node_i)], 1))

        for batch in batches:
            flat = [c.to_pylist() for c in batch.columns[:8]]
            bits = batch.column(8)
            for i, (token, block, guest, main, comp, node, n, pos) in enumerate(zip(*flat)):
                if (token, block) != key:
                    key, home, table = (token, block), [], None
                mine = np.array(bits[i].values)
                if not guest:  # those at home stand first
                    home.append((main, comp, node, n, pos, mine))
                elif home:
                    if table is None:
                        cols = list(zip(*home))
                        table = [np.array(c) for c in cols[:5]], Bitmaps(cols[5])
                    meet(comp, node, n, pos, mine)
            if found:
                u, v = np.unique(np.concatenate(found), axis=0).T
                found = []
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return grouped.select("token", "block", "guest", "main", "comp", "node", "n", "pos", "bits") \
        .mapInArrow(run, "u long, v long")


def _pos_fits(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sets of these sizes that share the elements at these places can be linked."""
    need = F.ceil((n1 + n2) * F.lit(percent) / F.lit(100 + percent))
    return F.least(n1 - p1, n2 - p2) + F.least(p1, p2) >= need


def similar_documents(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), one row per row.

    Texts with fewer words than a shingle are one shingle; null texts and texts without words
    have no set and no link (their component is their id). Every row is a document: rows that
    repeat an id are linked by their own texts. A row with a null id joins a component like any
    other, but does not name it; the component is null if none of its rows has an id. Very long
    texts are read whole. Empty tables give no rows; other columns are ignored."""
    percent = params.percent
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text"))
    levels, hot = shingle_levels(rows.select("text"), params)
    seen = written(profiles(rows, levels, hot, params), "profiles")
    # one node per distinct set, named once when it is written; its text is found by (doc_id, th)
    nodes = written(seen.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("at"),
        *[F.first(c).alias(c) for c in ("g1", "g2", "prefix", "hot", "bits")])
        .select(F.monotonically_increasing_id().alias("node"), "at.doc_id", "at.th", "n", "f1", "f2", "g1", "g2",
                "prefix", "hot", "bits"), "nodes")
    groups = written(nodes.groupBy("n", "g1", "g2").agg(
        F.min("node").alias("gid"), F.first("prefix").alias("prefix"), F.first("hot").alias("hot")), "groups")
    members = written(nodes.select("node", "n", "g1", "g2").join(groups.select("n", "g1", "g2", "gid"), ["n", "g1", "g2"])
                      .select("gid", "node"), "members")

    spread = groups.select("gid", "n", "hot", F.posexplode("prefix").alias("pos", "token")).withColumn(
        "part", F.when(F.array_contains("hot", F.col("token")), F.pmod(F.xxhash64("gid"), F.lit(SPLITS))).cast("int")).drop("hot")
    one, whole = F.struct("pos", "n", "gid"), Window.partitionBy("token", "part")
    chain = whole.orderBy("n", "gid")
    lists = written(spread.withColumn("last", F.lag(one).over(chain)).withColumn("next", F.lead("gid").over(chain))
                    .where("last is not null or next is not null or part is not null")
                    .withColumn("top", F.min(one).over(whole)).drop("next"), "lists")
    tops = lists.where("part is not null and gid = top.gid").select(
        "token", "gid", "n", "pos", F.min(one).over(Window.partitionBy("token")).alias("o"))
    group_pairs = lists.select("token", "gid", "n", "pos", F.explode(F.array("top", "last")).alias("o")).unionByName(tops) \
        .where(F.col("o").isNotNull() & (F.col("o.gid") != F.col("gid"))) \
        .where(_pos_fits(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent)) \
        .select(F.least("gid", "o.gid").alias("u"), F.greatest("gid", "o.gid").alias("v"))
    inside = members.where("gid <> node").select(F.col("gid").alias("u"), F.col("node").alias("v"))
    links = _verified(_plausible(group_pairs.unionByName(inside), nodes, params), rows, nodes, params)
    label = components(links)

    # lists whose members lie in several components, expanded to members
    parts = members.join(label, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("comp"))
    split = parts.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = lists.select("token", "gid").unionByName(  # a group of several components meets at its own list
        groups.select(F.col("prefix")[0].alias("token"), "gid")).join(split, "gid") \
        .groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    tokens = spread.join(written(mixed, "mixed"), "token").join(parts, "gid")
    sizes = written(tokens.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")), "list-parts")
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("total")) \
        .select("token", F.col("m.comp").alias("main_comp"), F.col("m.k").alias("k"), "total")
    placed = tokens.drop("part").join(main, "token").withColumn("main", F.col("comp") == F.col("main_comp")) \
        .withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    stands = F.array(F.struct(home.alias("block"), F.lit(False).alias("guest")))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("guest")))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("main"), stands).otherwise(F.concat(stands, visits)))) \
        .select("token", "at.block", "at.guest", "main", "comp", "node", "n", "pos") \
        .join(nodes.select("node", "bits"), "node")
    more = _verified(written(_across(dealt, percent).distinct(), "candidates"), rows, nodes, params)
    named = more.join(label.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left") \
        .join(label.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left") \
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    second = components(written(named, "links")).select(F.col("node").alias("comp"), F.col("component").alias("top"))
    every = nodes.select("node", "doc_id", "n", "f1", "f2").join(label, "node", "left") \
        .withColumn("comp", F.coalesce("component", "node")).join(second, "comp", "left") \
        .withColumn("top", F.coalesce("top", "comp"))
    smallest = every.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    named_sets = every.join(smallest, "top").select("n", "f1", "f2", "component_id")
    return seen.where("n > 0").select("doc_id", "n", "f1", "f2").join(named_sets, ["n", "f1", "f2"]) \
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id") \
        .unionByName(seen.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                                F.col("doc_id").alias("component_id")))


ORACLE = """
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words} + 2),
                           lambda i: array_to_string(w[i:i + {words} - 1], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS items FROM cut),
item AS (SELECT r, len(items) AS n, unnest(items) AS f FROM sets),
link AS (SELECT a.r AS u, b.r AS v FROM item a JOIN item b ON a.f = b.f AND a.r <> b.r GROUP BY a.r, b.r
         HAVING count(*) * (100 + {percent}) >= {percent} * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT r AS u, r AS v FROM sets UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, c.component_id FROM sets s
JOIN (SELECT reach.u, min(t.doc_id) AS component_id FROM reach JOIN sets t ON t.r = reach.v GROUP BY reach.u) c ON c.u = s.r
"""


def oracle(params: JoinParams = JoinParams()) -> str:
    return ORACLE.format(words=params.words, percent=params.percent)
