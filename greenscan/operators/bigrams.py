"""Bigram tables (A3, J2, W2): frequencies, green flags, explicit greenlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import greenlist as gl
from greenscan.operators.detect import bigram_codes


def bigram_rows(df: DataFrame, id_col: str, ids_col: str, vocab_size: int) -> DataFrame:
    """(id, pos, prev, tok): one row per scored position, pos from 1 (second token)."""
    v = F.lit(vocab_size).cast("bigint")
    rows = df.select(id_col, F.posexplode(bigram_codes(F.col(ids_col), vocab_size)).alias("pos", "_z"))
    return rows.select(id_col, (F.col("pos") + 1).alias("pos"),
                       F.call_function("div", F.col("_z"), v).alias("prev"), (F.col("_z") % v).alias("tok"))


def bigram_freq(df: DataFrame, id_col: str, ids_col: str, cfg: WatermarkConfig) -> DataFrame:
    """Per document Counter of bigrams (A3) with the green flag of each (J2). Every row is a
    document of its own, also when ids repeat or are null.

    A document's bigrams sit in one partition, so the partial aggregate before the
    shuffle already reduces them to distinct (document, bigram) pairs."""
    v = F.lit(cfg.vocab_size).cast("bigint")
    z = df.withColumn("_row", F.monotonically_increasing_id()).select(
        id_col, "_row", F.explode(bigram_codes(F.col(ids_col), cfg.vocab_size)).alias("_z"))
    agg = z.groupBy("_row", id_col, "_z").agg(F.count(F.lit(1)).alias("n"))
    out = agg.select(id_col, F.call_function("div", F.col("_z"), v).alias("prev"),
                     (F.col("_z") % v).alias("tok"), "n")
    return gl.with_green(out, "prev", "tok", cfg)


def table_counts(df: DataFrame, id_col: str, ids_col: str, cfg: WatermarkConfig) -> DataFrame:
    """(id, num_tokens_scored, num_green_tokens) through the materialised greenlist (W2, J2):
    one row per row, also for documents without a bigram and for repeated or null ids."""
    v = F.lit(cfg.vocab_size).cast("bigint")
    z = df.withColumn("_row", F.monotonically_increasing_id()).select(
        id_col, "_row", F.explode_outer(bigram_codes(F.col(ids_col), cfg.vocab_size)).alias("_z"))
    rows = z.select("_row", id_col, F.call_function("div", F.col("_z"), v).alias("prev"), (F.col("_z") % v).alias("tok"))
    keys = df.sparkSession.range(cfg.vocab_size).select(F.col("id").alias("prev"))  # all keys: V of them
    marked = green_by_table(rows, explicit_greenlist(keys, cfg))
    return marked.groupBy("_row", id_col).agg(
        F.count("prev").alias("num_tokens_scored"),
        F.coalesce(F.sum((F.col("is_green") & F.col("prev").isNotNull()).cast("long")), F.lit(0)).alias("num_green_tokens")) \
        .drop("_row")


def bigram_green_table(df: DataFrame, ids_col: str, cfg: WatermarkConfig) -> DataFrame:
    """Corpus-wide distinct bigrams: (prev, tok, n, is_green). The hash is computed
    once per distinct bigram after the aggregation, not per occurrence."""
    v = F.lit(cfg.vocab_size).cast("bigint")
    z = df.select(F.explode(bigram_codes(F.col(ids_col), cfg.vocab_size)).alias("_z"))
    agg = z.groupBy("_z").agg(F.count(F.lit(1)).alias("n"))
    out = agg.select(F.call_function("div", F.col("_z"), v).alias("prev"),
                     (F.col("_z") % v).alias("tok"), "n")
    return gl.with_green(out, "prev", "tok", cfg)


def explicit_greenlist(prevs: DataFrame, cfg: WatermarkConfig, prev_col: str = "prev") -> DataFrame:
    """Materialised greenlist (W2, T3): for every key p in ``prevs``, the tokens at the head
    (or the legacy tail) of the key's permutation with their ranks.

    Rank r is held by token (r - b) / a modulo V, so only the int(V * gamma) green tokens of a
    key are made, in order, and nothing is sorted or ranked. The inverse of a is a^(V - 2)
    (V is prime), by squaring, once per key."""
    V, G = cfg.vocab_size, cfg.n_green
    v = F.lit(V).cast("bigint")
    keys = prevs.select(F.col(prev_col).alias("prev")).where("prev is not null").distinct()
    k = gl.seed_key(F.col("prev"), cfg.hash_key)
    v1 = F.lit(V - 1).cast("bigint")
    keyed = keys.select("prev", (k % v1 + 1).alias("_a"), (F.call_function("div", k, v1) % v).alias("_b"))
    bits = F.array(*[F.lit(c == "1") for c in f"{V - 2:b}"])
    inverse = F.aggregate(bits, F.lit(1).cast("bigint"), lambda x, one: F.when(
        one, (x * x % v) * F.col("_a") % v).otherwise(x * x % v))
    first, last = (0, G - 1) if cfg.select_green_tokens else (V - G, V - 1)
    ranks = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")) if G else F.array().cast("array<bigint>")
    rows = keyed.select("prev", "_b", inverse.alias("_inv"), F.explode(ranks).alias("rank"))
    return rows.select("prev", F.pmod((F.col("rank") - F.col("_b") + v) * F.col("_inv"), v).alias("tok"), "rank")


def green_by_table(bigrams: DataFrame, greenlist: DataFrame) -> DataFrame:
    """J2 as a join: a bigram is green when (prev, tok) is in the greenlist table.
    The greenlist has int(V*gamma) rows per key; its size is bounded by the keys
    present times V, and adaptive execution broadcasts it when it measures small."""
    g = greenlist.select("prev", "tok", F.lit(True).alias("_in"))
    return bigrams.join(g, ["prev", "tok"], "left") \
        .withColumn("is_green", F.coalesce(F.col("_in"), F.lit(False))).drop("_in")
