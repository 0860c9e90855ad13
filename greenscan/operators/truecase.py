"""Statistical truecasing.

The reference lower-cases the text and capitalises sentence starts and words a
part-of-speech tagger calls proper nouns. No tagger is available, so the casing
knowledge is learned from the corpus instead (the idea of Lita et al., 2003): for
every lower-cased word, the form it most often takes away from sentence starts.
Building the model counts the forms of a block of tokens first, so a very frequent word
costs one row per block before the shuffle.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.operators import lookup

try:  # as in lookup: workers get the functions by value
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:
    pass

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SEGMENT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
SENTENCE_END = (".", "!", "?")


def _inner_counts(size: int, most: int):
    """Arrow function: (form, n) of the tokens that start no sentence, counted block by block."""
    def run(batches):
        for rows in lookup.blocks(batches, size, most):
            lists = lookup.plain(rows.column(0))
            flat, offsets = lists.flatten(), lookup.offsets_of(lists)
            coded = flat.dictionary_encode()
            ends = pc.is_in(coded.dictionary, pa.array(SENTENCE_END)).to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy()
            inner = np.append(True, ~ends[codes[:-1]]) if len(codes) else np.empty(0, bool)
            inner[offsets[:-1][np.diff(offsets) > 0]] = False
            n = np.bincount(codes[inner], minlength=len(coded.dictionary))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(seen)), pa.array(n[seen], pa.int64())], ["form", "n"])

    return run


def truecase_model(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, form, n_form, n_total): the most frequent casing of each word outside
    sentence starts; ties go to the larger string (lower case before capitals)."""
    toks = df.select(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), 0).alias("t"))
    # counted as they stand first: only distinct forms are then told from signs and lower-cased
    forms = toks.mapInArrow(_inner_counts(lookup.BLOCK, lookup.BLOCK_BYTES), "form string, n long") \
        .groupBy("form").agg(F.sum("n").alias("n"))
    cnt = forms.where(F.col("form").rlike(r"^\p{L}")).withColumn("key", F.lower("form"))
    return cnt.groupBy("key").agg(
        F.max_by("form", F.struct("n", "form")).alias("form"),
        F.max(F.struct("n", "form"))["n"].alias("n_form"),
        F.sum("n").alias("n_total"))


def _capitalize(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))


def truecase_rows(df: DataFrame, model: DataFrame, text_col: str, out_col: str, sentence_start: bool = True,
                  join_with_spaces: bool = False, keep_text: bool = True) -> DataFrame:
    """``df`` with ``out_col``: the text lower-cased, each word in its learned form,
    sentence-initial words capitalised (F11). ``sentence_start=False, join_with_spaces=True``
    is the tagger-only variant that joins tokens with single spaces (F12). Without ``keep_text``
    the result lacks ``text_col``, unless that is ``out_col``.

    One row out per row in, whatever the ids: the texts are written in blocks of their segments
    (:mod:`greenscan.operators.lookup`), the distinct segments of a block are looked up in the
    model, and each text is put together in its block. A null text stays null, an empty one empty."""
    pattern = TOKEN if join_with_spaces else SEGMENT
    keep = [c for c in df.columns if c != out_col and (keep_text or c != text_col)]
    store = lookup.Blocks.of(df.select(*[F.col(f"`{c}`") for c in keep],
                                       F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), 0).alias("_segs")), "_segs")
    known = store.keys().join(model.select("key", "form"), "key", "left").select("block", "pos", F.coalesce("form", "key").alias("form"))

    def told(x: Column) -> Column:
        # a form is its segment but for case, so the form tells what the segment is
        word, form = x["form"].rlike(r"^[\p{L}\p{N}]"), x["form"]
        ends = form.isin(*SENTENCE_END) if join_with_spaces else form.rlike(r"[.!?]\s*$")
        return F.struct(x["pos"].alias("pos"), form.alias("form"), word.alias("word"), ends.alias("ends"),
                        F.when(word, _capitalize(form)).otherwise(form).alias("capital"))

    kinds = {c: df.schema[c].dataType for c in df.columns if c in keep or c == out_col} | {out_col: T.StringType()}
    return store.rebuilt(known, [T.StructField(c, k) for c, k in kinds.items()],
                         _joined(out_col, sentence_start, join_with_spaces), told if sentence_start else None)


def _joined(out_col: str, sentence_start: bool, join_with_spaces: bool):
    def rebuild(offsets: np.ndarray, places: np.ndarray, known: pa.Table, coded: pa.ListArray) -> dict[str, pa.Array]:
        column = lambda c: lookup.plain(known.column(c))
        flags = lambda c: column(c).to_numpy(zero_copy_only=False).astype(bool)[places]
        forms = column("form")
        if sentence_start and len(places):
            starts = np.append(False, flags("ends")[:-1])
            first = offsets[:-1][np.diff(offsets) > 0]
            starts[first] = True
            if not join_with_spaces:  # the first word may stand behind a segment of other signs
                second = offsets[:-1][np.diff(offsets) > 1] + 1
                starts[second] |= ~flags("word")[second - 1]
            places = places + len(forms) * starts
            forms = pa.concat_arrays([forms, column("capital")])
        parts = lookup.lists_of(offsets, forms.take(pa.array(places)), coded)
        return {out_col: pc.binary_join(parts, " " if join_with_spaces else "")}

    return rebuild


def truecase_apply(df: DataFrame, model: DataFrame, id_col: str, text_col: str = "text",
                   out_col: str = "truecased", sentence_start: bool = True,
                   join_with_spaces: bool = False) -> DataFrame:
    """(id, truecased text) of every row (F11, F12); ids may repeat and be null."""
    return truecase_rows(df.select(id_col, text_col), model, text_col, out_col, sentence_start, join_with_spaces,
                         keep_text=False).select(id_col, out_col)


def truecase_normalizer(df: DataFrame, col: str, key: str | None = None,
                        model: DataFrame | None = None) -> DataFrame:
    """``truecase`` in a detection chain, with a ``model`` learned beforehand from text of
    sound casing (:func:`truecase_model`). Without one it is learned from the same table, and
    a row's result then depends on the others. Rows need no key (``key`` is accepted and not
    used)."""
    model = truecase_model(df, col) if model is None else model
    return truecase_rows(df, model, col, col)
