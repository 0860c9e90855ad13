"""Keyed greenlist in closed form (F16, F17, F26, and W2's default form).

For a previous token p the reference seeds an RNG with ``hash_key * p``, permutes
the vocabulary and calls the first ``int(V * gamma)`` entries green. We keep the
properties, not the bits: with V prime,

    k    = first 60 bits of md5(decimal(hash_key * p))
    a    = k mod (V - 1) + 1          (1..V-1: a bijection of Z_V)
    b    = (k div (V - 1)) mod V
    rank = (a * c + b) mod V          (position of token c in p's permutation)
    green: rank <  G                  (select_green_tokens, head)
           rank >= V - G              (legacy tail)

Every key has exactly G = int(V * gamma) green tokens, computed in O(1) per bigram
inside the JVM. Products stay below V**2 < 2**62.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import codepoints as cps
from greenscan.functions.tokens import md5_60

LITERAL_V = 1 << 20  # up to this vocabulary size per-token tables are constants of the plan


def seed_key(prev: Column, hash_key: int) -> Column:
    return md5_60((F.lit(hash_key).cast("bigint") * prev).cast("string"))


def rank_from_key(k: Column, tok: Column, vocab_size: int) -> Column:
    v = F.lit(vocab_size).cast("bigint")
    v1 = F.lit(vocab_size - 1).cast("bigint")
    a = k % v1 + F.lit(1).cast("bigint")
    b = F.call_function("div", k, v1) % v  # integral division, stays BIGINT
    return (a * tok + b) % v


def green_from_rank(rank: Column, cfg: WatermarkConfig) -> Column:
    if cfg.select_green_tokens:
        return rank < F.lit(cfg.n_green)
    return rank >= F.lit(cfg.vocab_size - cfg.n_green)


def rank(prev: Column, tok: Column, cfg: WatermarkConfig) -> Column:
    return rank_from_key(seed_key(prev, cfg.hash_key), tok, cfg.vocab_size)


def is_green(prev: Column, tok: Column, cfg: WatermarkConfig) -> Column:
    return green_from_rank(rank(prev, tok, cfg), cfg)


def green_from_key(k: Column, tok: Column, cfg: WatermarkConfig) -> Column:
    return green_from_rank(rank_from_key(k, tok, cfg.vocab_size), cfg)


@lru_cache(maxsize=8)
def _keys(vocab_size: int, hash_key: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    keys = [int(hashlib.md5(str(hash_key * p).encode()).hexdigest()[:15], 16) for p in range(vocab_size)]
    return tuple(k % (vocab_size - 1) + 1 for k in keys), tuple(k // (vocab_size - 1) % vocab_size for k in keys)


def key_lists(cfg: WatermarkConfig) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(a, b) of every predecessor 0..V-1, for V up to ``LITERAL_V``."""
    return _keys(cfg.vocab_size, cfg.hash_key)


def literal_keys(cfg: WatermarkConfig) -> tuple[Column, Column]:
    """(a, b) of every predecessor 0..V-1 as two constant arrays of the plan, for V up to
    ``LITERAL_V``: the rank of token c is (a[p] * c + b[p]) mod V, without a hash per bigram."""
    mult, shift = key_lists(cfg)
    return cps.literal_array(mult, "bigint"), cps.literal_array(shift, "bigint")


def key_table(spark, cfg: WatermarkConfig):
    """(p, a, b) for every token id 0..V-1: the greenlist key of each possible
    predecessor, computed once in the JVM. V rows - a parameter bound - so it can
    be broadcast; row tables then test greenness by a hash lookup and integer
    arithmetic instead of one md5 per row."""
    v1 = F.lit(cfg.vocab_size - 1).cast("bigint")
    k = seed_key(F.col("id"), cfg.hash_key)
    return spark.range(cfg.vocab_size).select(
        F.col("id").alias("p"), (k % v1 + 1).alias("a"),
        (F.call_function("div", k, v1) % F.lit(cfg.vocab_size)).alias("b"))


def with_green(df, prev_col: str, tok_col: str, cfg: WatermarkConfig, out: str = "is_green"):
    """Add the green flag of (prev, tok) rows through the broadcast key table."""
    keys = F.broadcast(key_table(df.sparkSession, cfg).select(
        F.col("p").alias("_gp"), F.col("a").alias("_ga"), F.col("b").alias("_gb")))
    j = df.join(keys, df[prev_col] == keys["_gp"], "left")
    v = F.lit(cfg.vocab_size).cast("bigint")
    r = (F.col("_ga") * F.col(tok_col) + F.col("_gb")) % v
    return j.withColumn(out, green_from_rank(r, cfg)).drop("_gp", "_ga", "_gb")
