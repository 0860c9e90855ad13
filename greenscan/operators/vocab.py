"""Learned vocabulary: build, encode, decode.

The default id space is a hash of size V (no table needed). A learned vocabulary
numbers distinct tokens by descending frequency; its size padded to the next prime
is the V the greenlist needs (padding ids never occur, so the green share of used
ids is only approximately gamma).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenscan.config import next_prime
from greenscan.operators import lookup
from greenscan.operators.ranking import global_row_number


def vocab_build(tokens: DataFrame, token_col: str = "token", reserved: int = 0) -> DataFrame:
    """(token, n, token_id): ids 0.. by (n desc, token); ``reserved`` ids are kept
    free at the bottom for special tokens (BOS, UNK). Partial aggregation runs
    before the shuffle, so a very frequent token costs one row per partition."""
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return global_row_number(counts, [F.col("n").desc(), F.col("token")], "token_id", start=reserved)


def vocab_size_prime(vocab: DataFrame, reserved: int = 0) -> int:
    """Hash-space size for a learned vocabulary: next prime >= ids in use."""
    return next_prime(vocab.count() + reserved)


def encode(token_rows: DataFrame, vocab: DataFrame, token_col: str = "token",
           unk_id: int = -1) -> DataFrame:
    """Token -> id by an equi join (J4); unknown tokens get ``unk_id``.

    No broadcast hint: the vocabulary grows with the corpus. Adaptive execution
    turns this into a broadcast join at run time when the vocabulary side is
    measured under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    v = vocab.select(F.col("token").alias("_vt"), F.col("token_id"))
    out = token_rows.join(v, token_rows[token_col] == v["_vt"], "left").drop("_vt")
    return out.withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(unk_id).cast("bigint")))


def decode(id_rows: DataFrame, vocab: DataFrame, id_col: str = "token_id",
           special_ids=()) -> DataFrame:
    """Id -> token by join (F15); special ids are dropped as skip_special_tokens does."""
    v = vocab.select(F.col("token_id").alias("_vid"), F.col("token"))
    rows = id_rows
    if special_ids:
        rows = rows.where(~F.col(id_col).isin(list(special_ids)))
    return rows.join(v, rows[id_col] == v["_vid"], "left").drop("_vid")


def reassemble(rows: DataFrame, key: str, pos_col: str, value_col: str, out_col: str) -> DataFrame:
    """Ordered array per key from exploded rows (one document is one group, bounded
    by the document's length)."""
    agg = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos_col, value_col))).alias("_s"))
    return agg.select(key, F.transform("_s", lambda s: s[value_col]).alias(out_col))


def encode_lists(df: DataFrame | lookup.Blocks, vocab: DataFrame, tokens_col: str = "tokens", out_col: str = "ids",
                 unk_id: int = -1, reserved: int = 0, row: str | None = None, keep_list: bool = True) -> DataFrame:
    """Token arrays -> id arrays, one row out per row in (J4). Unknown tokens get ``unk_id``;
    a null array stays null, an empty one empty. Ids go by frequency, so the lowest ones are
    the head that is broadcast; the rest of the vocabulary is joined, never collected. Rows need
    no number (``row`` is accepted and not used). ``keep_list``: whether the tokens stay."""
    head = vocab.where(F.col("token_id") < reserved + lookup.HEAD)
    return lookup.replaced(df, tokens_col, out_col, vocab, "token", "token_id", head, unk_id, keep_list)


def decode_lists(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", out_col: str = "tokens",
                 special_ids=(), unk_token: str = "<unk>", reserved: int = 0, row: str | None = None,
                 keep_list: bool = True) -> DataFrame:
    """Id arrays -> token arrays, one row out per row in (F15). Special ids are dropped, as
    skip_special_tokens does; ids without a token give ``unk_token``. ``row`` and ``keep_list``
    as in :func:`encode_lists`."""
    head = vocab.where(F.col("token_id") < reserved + lookup.HEAD)
    plain = df
    if special_ids:
        plain = df.withColumn(ids_col, F.filter(ids_col, lambda x: ~F.coalesce(x.isin(list(special_ids)), F.lit(False))))
    return lookup.replaced(plain, ids_col, out_col, vocab, "token_id", "token", head, unk_token, keep_list)
