"""Token arrays -> hash ids and green flags in Arrow batches.

The same ids as :func:`greenscan.functions.tokens.hash_ids` and the same flags as
:func:`greenscan.operators.detect.green_flags`, for whole tables: each distinct token of a block is
hashed once, and the keys of all V predecessors are a table made once. Map-only.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.config import WatermarkConfig
from greenscan.functions import greenlist as gl
from greenscan.operators import lookup

try:  # as in lookup: workers get the functions by value
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:
    pass


def token_ids(tokens: pa.Array, vocab_size: int) -> np.ndarray:
    """First 60 bits of the md5 of each token, modulo V."""
    md5 = hashlib.md5
    return np.array([(int.from_bytes(md5(t).digest()[:8], "big") >> 4) % vocab_size
                     for t in tokens.cast(pa.binary()).to_pylist()], dtype=np.int64)


def with_flags(df: DataFrame, tokens_col: str, ids_col: str, flags_col: str, cfg: WatermarkConfig) -> DataFrame:
    """``df`` with the tokens (no null among them) replaced by their ids and the green flag of
    each scored position. For V up to ``LITERAL_V``."""
    keep = [f for f in df.schema.fields if f.name != tokens_col]
    src = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(tokens_col))
    mult, shift = (np.array(x, dtype=np.int64) for x in gl.key_lists(cfg))
    v, n_green, head = cfg.vocab_size, cfg.n_green, cfg.select_green_tokens
    size, most = lookup.BLOCK, lookup.BLOCK_BYTES
    names = [f.name for f in keep] + [ids_col, flags_col]

    def run(batches):
        for rows in lookup.blocks(batches, size, most):
            *rest, lists = [lookup.plain(c) for c in rows.columns]
            coded, offsets = lists.flatten().dictionary_encode(), lookup.offsets_of(lists)
            ids = token_ids(coded.dictionary, v)[coded.indices.to_numpy()]
            scored = np.ones(len(ids), bool)  # all but each array's first
            scored[offsets[:-1][np.diff(offsets) > 0]] = False
            at = np.flatnonzero(scored)
            before = ids[at - 1]
            rank = (mult[before] * ids[at] + shift[before]) % v
            flags = pa.array(rank < n_green if head else rank >= v - n_green)
            ends = np.append(0, np.cumsum(np.maximum(np.diff(offsets) - 1, 0)))
            yield pa.RecordBatch.from_arrays([*rest, lookup.lists_of(offsets, pa.array(ids), lists),
                                              lookup.lists_of(ends, flags, lists)], names)

    return src.mapInArrow(run, T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.LongType())),
                                             T.StructField(flags_col, T.ArrayType(T.BooleanType()))]))
