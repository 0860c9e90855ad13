"""Tokenise, hash to ids, strip BOS, truncate, count.

Token ids live in a hash space of prime size V: id(w) = first 60 bits of md5(w)
mod V. A learned vocabulary (``greenscan.operators.vocab``) can replace the hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from greenscan.config import TOKEN_PATTERN


def md5_60(s: Column) -> Column:
    """First 15 hex digits of md5 of a string, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def tokenize(text: Column, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """Word / single-symbol tokens in text order; whitespace is dropped."""
    src = F.lower(text) if lowercase else text
    return F.regexp_extract_all(src, F.lit(pattern), 0)


def token_id(word: Column, vocab_size: int) -> Column:
    return md5_60(word) % F.lit(vocab_size).cast("bigint")


def hash_ids(tokens: Column, vocab_size: int) -> Column:
    """ARRAY<STRING> -> ARRAY<BIGINT> in the hash space."""
    return F.transform(tokens, lambda w: token_id(w, vocab_size))


def text_to_ids(text: Column, vocab_size: int, pattern: str = TOKEN_PATTERN,
                lowercase: bool = True) -> Column:
    return hash_ids(tokenize(text, pattern, lowercase), vocab_size)


def strip_bos(ids: Column, bos_id: int | None) -> Column:
    """Drop a leading BOS id (P11); arrays without one (or empty) pass through."""
    if bos_id is None:
        return ids
    return F.when((F.size(ids) > 0) & (F.element_at(ids, 1) == F.lit(bos_id)),
                  F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def truncate(ids: Column, cap: int) -> Column:
    """First ``cap`` ids."""
    return F.slice(ids, 1, cap)


def truncation_flag(ids: Column, cap: int) -> Column:
    """1 when the truncated prompt length equals the cap, as the reference flags it
    (also when the prompt was exactly ``cap`` long, Q17)."""
    return (F.size(F.slice(ids, 1, cap)) == F.lit(cap)).cast("int")


def strip_prompt(out_ids: Column, n_prompt: Column) -> Column:
    """Decoder-only outputs repeat the prompt; keep the new ids only."""
    n = F.size(out_ids)
    return F.slice(out_ids, n_prompt + 1, F.greatest(n - n_prompt, F.lit(0)))


# Fixed value: the notice shown below a prompt that was cut.
TRUNC_NOTICE = "\n\n[Prompt was truncated before generation due to length...]"


def truncated_notice(redecoded: Column, flag: Column, original: Column) -> Column:
    """Prompt shown to the user with a notice when truncation happened (P10)."""
    return F.when(flag == 1, F.concat(redecoded, F.lit(TRUNC_NOTICE))).otherwise(original)
