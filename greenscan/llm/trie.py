"""Prefix trie of conversations, built as a burst trie over distributed containers.

A turn is a fixed-width token (16 bytes of a digest of role and text, 8 bytes of the text's
length), a conversation one binary value of ``TOKEN`` bytes per turn; byte order of these
values is token order. Equal conversations collapse to one weighted sequence first, so a group
of copies, however large, is one row from there on.

* A container holds the sequences that share a trie head (a prefix), without that prefix.
  Containers of more than ``limit`` sequences burst: every sequence gives its next turn to its
  head and moves to the container of the longer prefix. Only rows of burst containers are
  touched again.
* Containers that stay are dealt to tasks by head, sorted, and swept: neighbours share all
  nodes up to their common prefix. A container is swept in memory; it holds at most ``limit``
  distinct sequences.
* Figures of burst heads are summed from their children, the deepest round first.
* The digest of the conversations that end at a node runs over all their ids in order. Ids are
  range-sorted, so a group of copies spans many tasks: each turns its stretch into bytes, and
  only these pieces of the groups cut by a task's edge are chained, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenscan.llm.common import written

TOKEN = 24          # bytes of a turn
PIECE = 1 << 16     # bytes of id text in one row of a digest's input
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _short(data: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def turn_tokens(role: Column, text: Column) -> Column:
    """The token in hexadecimal; null role and text count as empty. The role's length stands
    in front, so different pairs never run together."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    data = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(F.substring(F.sha2(data, 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 16, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq) of (conv_id, turn, role, text): the tokens in the order of the turns,
    nulls first; equal turn numbers go by token."""
    token = F.struct("turn", turn_tokens(F.col("role"), F.col("text")).alias("token"))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")) \
        .agg(F.sort_array(F.collect_list(token)).alias("t")) \
        .select("conv_id", F.unhex(F.array_join("t.token", "")).alias("seq"))


def rebuilt(seqs: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Every sequence with its first h turns replaced by those of the first conversation of
    its group; h is the CRC-32 of the decimal id modulo ``spread``."""
    own = seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread * TOKEN).cast("int")) \
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = seqs.where(F.col("conv_id") % group == 0) \
        .select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {TOKEN * (spread - 1)})").alias("front"))
    return own.join(heads, "base", "left").select("conv_id", F.expr(
        "concat(substring(coalesce(front, X''), 1, h), substring(seq, h + 1, 2147483647))").alias("seq"))


def id_digests(rows: DataFrame) -> DataFrame:
    """(key, digest): SHA-256 in hexadecimal of the comma-joined decimal ids of each key, in
    ascending order, for (key, conv_id)."""
    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, key, held, first = -1, 0, None, [], True
        out: list[tuple] = []

        def close(edge: bool) -> None:
            nonlocal no
            ids = b",".join(held)
            if edge or no:
                out.append((key, part, no, ids, None))
            else:
                out.append((key, part, no, None, hashlib.sha256(ids).hexdigest()))

        def batch_of() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict(dict(zip(STRETCH.names, map(list, zip(*out)))), schema=STRETCH)
            out.clear()
            return b

        size = 0
        for batch in batches:
            for k, i, p in zip(*(c.to_pylist() for c in batch.columns)):
                part = p
                if k != key:
                    if key is not None:
                        close(first)
                        first = False
                    key, no, held, size = k, 0, [], 0
                elif size >= PIECE:
                    out.append((key, part, no, b",".join(held), None))
                    no, held, size = no + 1, [], 0
                held.append(b"%d" % i)
                size += len(held[-1]) + 1
            if out:
                yield batch_of()
        if key is not None:
            close(True)  # the next task may go on with this key
            yield batch_of()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            if keys:
                yield pa.RecordBatch.from_pydict({"key": keys, "digest": digests})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "digest": [sha.hexdigest()]})

    STRETCH = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("no", pa.int32()), ("ids", pa.binary()),
                         ("digest", pa.string())])
    dealt = rows.select("key", "conv_id").repartitionByRange("key", "conv_id") \
        .sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    cut = written(dealt.mapInArrow(stretch, "key binary, part int, no int, ids binary, digest string"), "id-digests")
    chained = cut.where("digest is null").repartition("key").sortWithinPartitions("key", "part", "no") \
        .select("key", "ids").mapInArrow(chain, "key binary, digest string")
    return cut.where("digest is not null").select("key", "digest").unionByName(chained)


SWEPT = pa.schema([("head", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("depth", pa.int64()),
                   ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("digest", pa.string())])
SWEPT_SQL = ("head binary, parent binary, bytes long, depth long, conv_id long, parent_conv_id long, n_convs long, "
             "n_children long, n_leaves long, saved_tokens long, digest string")


def sweep(rows: list[tuple], head: bytes, parent: bytes | None, size: int, depth: int) -> list[tuple]:
    """The nodes of one container, its head first: rows of SWEPT. ``rows``: (suffix, n, smallest
    id, digest), sorted by suffix. Only the head's row names its head."""
    up, deep, sizes, n, conv, ends = [-1], [depth], [size], [0], [None], [None]
    path, before = [0], b""
    for suffix, count, smallest, digest in rows:
        at, stop = 0, min(len(before), len(suffix))
        while at < stop and before[at:at + TOKEN] == suffix[at:at + TOKEN]:
            at += TOKEN
        del path[at // TOKEN + 1:]
        for a in range(at, len(suffix), TOKEN):
            up.append(path[-1])
            path.append(len(deep))
            deep.append(depth + a // TOKEN + 1)
            sizes.append(int.from_bytes(suffix[a + 16:a + TOKEN], "big"))
            n.append(0)
            conv.append(None)
            ends.append(None)
        end = path[-1]
        n[end], conv[end], ends[end] = count, smallest, digest
        before = suffix
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for x in range(len(n) - 1, -1, -1):  # a node stands behind its parent
        leaves[x] = leaves[x] or 1
        saved[x] += (n[x] - 1) * sizes[x]
        if x:
            u = up[x]
            n[u] += n[x]
            conv[u] = conv[x] if conv[u] is None else min(conv[u], conv[x])
            children[u] += 1
            leaves[u] += leaves[x]
            saved[u] += saved[x]
    return [(head if x == 0 else None, parent if x == 0 else None, sizes[x], deep[x], conv[x],
             conv[up[x]] if x else None, n[x], children[x], leaves[x], saved[x], ends[x]) for x in range(len(n))]


def sweep_containers(rows: DataFrame) -> DataFrame:
    """Nodes of all containers of (head, parent, bytes, depth, suffix, n, conv_id, digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        top: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, same in groupby(zip(*columns), key=lambda r: r[:4]):
                if key != top:
                    if top is not None:
                        out += sweep(held, *top)
                    top, held = key, []
                held += [r[4:] for r in same]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pydict(dict(zip(SWEPT.names, map(list, zip(*out)))), schema=SWEPT)
                out = []
        if top is not None:
            out += sweep(held, *top)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(SWEPT.names, map(list, zip(*out)))), schema=SWEPT)

    return rows.repartition("head").sortWithinPartitions("head", "suffix") \
        .select("head", "parent", "bytes", "depth", "suffix", "n", "conv_id", "digest").mapInArrow(run, SWEPT_SQL)


def prefix_trie(seqs: DataFrame, limit: int = 256) -> DataFrame:
    """The nodes of the trie over (conv_id, seq), ids distinct: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No sequences, no
    nodes."""
    spark = seqs.sparkSession
    keyed = written(seqs.select("conv_id", "seq", _short(F.col("seq")).alias("key")), "sequences")
    distinct = keyed.groupBy("key").agg(F.first("seq").alias("suffix"), F.count(F.lit(1)).alias("n"),
                                        F.min("conv_id").alias("conv_id"))
    start = distinct.join(id_digests(keyed), "key").select(
        F.lit(bytearray(ROOT)).alias("head"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("depth"), "suffix", "n", "conv_id", "digest")
    current = written(start, "containers")
    stay: list[DataFrame] = []
    burst: list[tuple[DataFrame, DataFrame]] = []  # of each round: the heads, what ends there
    while True:
        large = written(current.groupBy("head", "parent", "bytes", "depth").agg(F.count(F.lit(1)).alias("rows"))
                        .where(F.col("rows") > limit).drop("rows"), "large")
        if large.isEmpty():
            stay.append(current)
            break
        names = large.select("head")
        stay.append(current.join(names, "head", "left_anti"))
        opened = current.join(names, "head", "left_semi")
        token = F.expr(f"substring(suffix, 1, {TOKEN})")
        burst.append((large, opened.where(F.octet_length("suffix") == 0).select("head", "n", "conv_id", "digest")))
        current = written(opened.where(F.octet_length("suffix") > 0).select(
            _short(F.concat("head", token)).alias("head"), F.col("head").alias("parent"),
            F.conv(F.hex(F.expr("substring(suffix, 17, 8)")), 16, 10).cast("long").alias("bytes"),
            (F.col("depth") + 1).alias("depth"),
            F.expr(f"substring(suffix, {TOKEN + 1}, 2147483647)").alias("suffix"), "n", "conv_id", "digest"),
            "containers")
    swept = written(sweep_containers(reduce(DataFrame.unionByName, stay)), "swept")
    tops = swept.where("head is not null").drop("parent_conv_id")
    inner = swept.where("head is null")

    # burst heads from the deepest round up; each round is one aggregation over its children
    done: list[DataFrame] = []
    for depth in range(len(burst) - 1, -1, -1):
        large, ended = burst[depth]
        below = reduce(DataFrame.unionByName, [tops.where(F.col("depth") == depth + 1), *done[-1:]])
        parts = below.select(F.col("parent").alias("head"), F.col("n_convs").alias("n"), "conv_id", F.lit(1).alias("one"),
                             "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("digest")) \
            .unionByName(ended.select("head", "n", "conv_id", F.lit(0).alias("one"), F.lit(0).cast("long").alias("n_leaves"),
                                      F.lit(0).cast("long").alias("saved_tokens"), "digest"))
        sums = parts.groupBy("head").agg(
            F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("one").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.max("digest").alias("digest"))
        done.append(written(large.join(sums, "head").select(
            "head", "parent", "bytes", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), "digest"), "burst-heads"))
    heads = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], tops.schema)
    above = heads.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    all_tops = tops.unionByName(heads).join(above, "parent", "left")
    return all_tops.unionByName(inner).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, group: int = 5, spread: int = 9, limit: int = 256) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of (conv_id, turn, role, text).

    Null turns come first, equal turn numbers go by the digest of role and text, null role or
    text is empty; rows that repeat are turns of their own. Rows without a conversation id
    belong to no conversation and take no part. A rebuilt conversation may have no turns: it
    is a member of the root alone. Texts are read whole; a conversation is one value of 24 bytes
    a turn. An empty table gives no rows. Other columns are ignored."""
    return prefix_trie(rebuilt(written(sequences(turns), "conversations"), group, spread), limit)


ORACLE = """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
         lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8))) % {spread} AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), bits),
told AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
         FROM conversations WHERE conv_id IS NOT NULL),
made AS (SELECT i.c, 0 AS own, b.pos, b.role, b.text FROM ids i JOIN told b ON b.c = i.c - i.c % {group} AND b.pos <= i.h
         UNION ALL SELECT i.c, 1, o.pos, o.role, o.text FROM ids i JOIN told o ON o.c = i.c AND o.pos > i.h),
seq AS (SELECT i.c, coalesce(list(md5(strlen(role) || ':' || role || text) ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS l,
               coalesce(list(strlen(text) ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS sizes
        FROM ids i LEFT JOIN made m USING (c) GROUP BY i.c),
member AS (SELECT c, d, len(l) = d AS ends, md5(array_to_string(l[1:d], '')) || d AS k,
                  CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], '')) || (d - 1) END AS up,
                  CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
           FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM seq)),
node AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
                (count(*) - 1) * any_value(size) AS saved,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended FROM member GROUP BY k),
child AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
told_of AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c USING (k)),
under AS (SELECT m.k, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
          FROM told_of n JOIN member m ON m.c = n.conv_id AND m.d <= n.depth GROUP BY m.k)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens,
       sha256(n.ended) AS ends_sha256
FROM told_of n JOIN under u USING (k) LEFT JOIN node p ON p.k = n.up
"""


def oracle(group: int = 5, spread: int = 9) -> str:
    return ORACLE.format(group=group, spread=spread)
