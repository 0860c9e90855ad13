"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

A key walks over shard numbers: from shard ``b`` it jumps to
``floor((b + 1) * 2^31 / ((state >> 33) + 1))``, where ``state`` is a 64-bit linear
congruential generator, and rests at the last number below the shard count. No ring table is
kept, and with one more shard a key either stays or moves to the new shard.

The state starts from 64 bits of the id's MD5 and is held as two 32-bit halves, because a
BIGINT product must not overflow. Slots number the rows of a shard in id order without
gathering a shard: rows are range-partitioned by id and written, ranked inside
(partition, shard), and shifted by a prefix sum over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenscan.llm.common import written

# Fixed value: the multiplier of the published generator, as 32-bit halves and 16-bit parts.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of state * MULTIPLIER + 1 modulo 2^64; no partial product reaches 2^63."""
    upper, lower = F.shiftright(low, 16), low.bitwiseAND(0xFFFF)
    p, q = upper * F.lit(LOW), lower * F.lit(LOW)  # below 2^48
    bottom = F.shiftleft(p.bitwiseAND(0xFFFF), 16) + q.bitwiseAND(MASK) + F.lit(1)
    carry = F.shiftright(p, 16) + F.shiftright(q, 32) + F.shiftright(bottom, 32)

    def low_product(x: Column, constant: int) -> Column:  # x * constant modulo 2^32
        top = (F.shiftright(x, 16) * F.lit(constant)).bitwiseAND(0xFFFF)
        return (F.shiftleft(top, 16) + x.bitwiseAND(0xFFFF) * F.lit(constant)).bitwiseAND(MASK)

    new_high = (carry + low_product(high, LOW) + low_product(low, HIGH)).bitwiseAND(MASK)
    return new_high, bottom.bitwiseAND(MASK)


def key_halves(key: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of the first 64 bits of the key's MD5; a null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("bigint")
    return half(1), half(9)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards`` and among one more. Every jump
    goes up by one at least, so ``shards`` + 1 steps always suffice."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    high, low = key_halves(key)
    zero = F.lit(0).cast("bigint")
    start = F.struct(high.alias("high"), low.alias("low"), zero.alias("shard"), zero.alias("grown"),
                     zero.alias("next"))

    def walk(s: Column, _: Column) -> Column:
        new_high, new_low = _step(s["high"], s["low"])
        jump = F.floor((s["next"] + 1).cast("double")
                       * (F.lit(2147483648.0) / (F.shiftright(new_high, 1) + 1).cast("double")))
        moved = F.struct(new_high.alias("high"), new_low.alias("low"),
                         F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"),
                         s["next"].alias("grown"), jump.cast("bigint").alias("next"))
        return F.when(s["next"] <= shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), start, walk)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null: none, plus
    ``overhead``), text_crc32, law ('key'), shard, slot (gapless from 0 in id order, null ids
    first), grown_shard (with one more shard).

    Only the id decides, so rows with equal or null ids share a shard and take neighbouring
    slots; equal texts may part. An empty table gives no rows. Other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       (F.octet_length(text) + overhead).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    placed = slim.repartitionByRange(*order) \
        .withColumn("home", jump_shards(F.col("doc_id"), shards)) \
        .withColumn("part", F.spark_partition_id())
    rows = written(placed.select(*order, F.col("home.shard").alias("shard"),
                                 F.col("home.grown").alias("grown_shard"), "part"), "shards")
    # grouped by (part, shard): a part is a range of ids, so no window holds a whole shard
    inside = rows.withColumn("nth", F.row_number().over(
        Window.partitionBy("part", "shard").orderBy(*order)))
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return inside.join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("ahead") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet, one directory ``shard=<n>`` per shard; a shard may have many
    files, so no task holds a whole shard. A column named ``shard`` is kept as ``shard_in``."""
    if "shard" in docs.columns:
        docs = docs.withColumnRenamed("shard", "shard_in")
    docs.withColumn("shard", jump_shards(F.col(id_col).cast("bigint"), shards)["shard"]) \
        .write.partitionBy("shard").parquet(path)


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
         lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (
  SELECT doc_id, coalesce(text, '') AS body,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
base AS (
  SELECT doc_id, strlen(body) + {overhead} AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(t[((xor(c, b)) & 255) + 1], c >> 8))) AS text_crc32,
         ('0x' || substr(digest, 1, 16))::UBIGINT::HUGEINT AS state FROM src, bits),
walk AS (
  SELECT doc_id, state, 0 AS shard, 0 AS grown, 0::BIGINT AS next FROM (SELECT DISTINCT doc_id, state FROM base)
  UNION ALL
  SELECT doc_id, s, CASE WHEN next < {shards} THEN next ELSE shard END, next,
         floor((next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (((state & 4294967295) * {multiplier}::HUGEINT
                 + (((state >> 32) * {multiplier}::HUGEINT & 4294967295) << 32) + 1)
                 & 18446744073709551615::HUGEINT) AS s FROM walk WHERE next <= {shards})),
home AS (SELECT doc_id, max(shard)::INTEGER AS shard, max(grown)::INTEGER AS grown_shard FROM walk GROUP BY doc_id)
SELECT b.doc_id, b.size::BIGINT AS size, b.text_crc32::BIGINT AS text_crc32, 'key' AS law, h.shard,
       row_number() OVER (PARTITION BY h.shard ORDER BY b.doc_id NULLS FIRST, b.text_crc32, b.size) - 1 AS slot,
       h.grown_shard
FROM base b JOIN home h ON b.doc_id IS NOT DISTINCT FROM h.doc_id
"""


def oracle(shards: int, overhead: int = 16) -> str:
    return ORACLE.format(shards=shards, overhead=overhead, multiplier=MULTIPLIER)
