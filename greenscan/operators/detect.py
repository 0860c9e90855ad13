"""Watermark detection.

Row-local form (the default): each document's token ids stay in its row as an
array; bigrams, greenness and counts are higher-order array functions, so a
detection is a chain of Projects over the scan - no shuffle, no Python worker.
The exploded form (one row per token, ``lag`` over a window) gives the same
counts and is what a per-token table needs (A3, A7 as rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import greenlist as gl
from greenscan.functions.normalize import apply_chain
from greenscan.functions.stats import with_normal_sf, z_score
from greenscan.functions.tokens import strip_bos, text_to_ids, tokenize

SCORE_COLUMNS = ("num_tokens_scored", "num_green_tokens", "green_fraction", "z_score",
                 "p_value", "prediction", "confidence")


def _pairs(ids: Column):
    n = F.size(ids)
    head = F.slice(ids, 1, F.greatest(n - 1, F.lit(0)))
    tail = F.slice(ids, 2, F.greatest(n - 1, F.lit(0)))
    return head, tail


def bigram_codes(ids: Column, vocab_size: int) -> Column:
    """Bigrams in order as one BIGINT each: prev * V + cur."""
    head, tail = _pairs(ids)
    v = F.lit(vocab_size).cast("bigint")
    return F.zip_with(head, tail, lambda p, c: p * v + c)


def green_flags(ids: Column, cfg: WatermarkConfig, literal: bool = False) -> Column:
    """Per scored position, is the token green under its predecessor's key.
    One md5 per position: the keys are computed once, then zipped with the tokens. ``literal``
    takes the keys of ids in 0..V-1 from constants of the plan instead (V up to ``LITERAL_V``)."""
    head, tail = _pairs(ids)
    if literal and cfg.vocab_size <= gl.LITERAL_V:
        mult, shift = gl.literal_keys(cfg)
        v = F.lit(cfg.vocab_size).cast("bigint")

        def flag(p: Column, c: Column) -> Column:
            known = (p >= 0) & (p < v)
            at = F.when(known, p).cast("int")
            near = gl.green_from_rank((F.get(mult, at) * c + F.get(shift, at)) % v, cfg)
            return F.when(known, near).otherwise(gl.is_green(p, c, cfg))

        return F.zip_with(head, tail, flag)
    keys = F.transform(head, lambda p: gl.seed_key(p, cfg.hash_key))
    return F.zip_with(keys, tail, lambda k, c: gl.green_from_key(k, c, cfg))


def score_ids(df: DataFrame, ids_col: str, cfg: WatermarkConfig, *,
              return_mask: bool = False, threshold: Column | None = None,
              status: Column | None = None, prefix: str = "", literal: bool = False,
              flags: Column | None = None) -> DataFrame:
    """Add the score record to rows holding an ARRAY<BIGINT> of token ids.

    Output columns: ``SCORE_COLUMNS`` + ``status`` (+ ``green_token_mask``), each
    named with ``prefix``. Rows that cannot be scored (fewer than two tokens, Q3/Q4)
    get null metrics and ``status = 'too_few_tokens'`` instead of an exception;
    ``status`` passed in (e.g. the character guard) takes precedence. ``literal``: see ``green_flags``;
    ``flags``: what that gives, where it is known. Each step is its own Project so an array is built once and read by name.
    """
    if return_mask and cfg.ignore_repeated_bigrams:
        raise ValueError("a mask per position needs every bigram counted: switch off ignore_repeated_bigrams")
    P = prefix
    ids = F.col(ids_col)
    n = F.size(ids)
    st = F.when(ids.isNull(), F.lit("null_input")).when(n < 2, F.lit("too_few_tokens")) \
        .otherwise(F.lit("ok"))
    if status is not None:
        st = F.coalesce(status, st)
    cols = list(df.columns)
    tmp_arr, tmp_t, tmp_g = f"_{P}arr", f"_{P}T", f"_{P}g"
    green = green_flags(ids, cfg, literal) if flags is None else flags
    if cfg.ignore_repeated_bigrams:
        # one key per position (as in standard mode), then distinct codes overall and
        # distinct codes among the green positions: no per-bigram structs
        tmp_f = f"_{P}flags"
        step = df.select(*cols, bigram_codes(ids, cfg.vocab_size).alias(tmp_arr),
                         green.alias(tmp_f), st.alias(f"{P}status"))
        green_codes = F.filter(F.zip_with(tmp_arr, tmp_f, lambda z, f: F.when(f, z)), lambda x: x.isNotNull())
        step = step.select(*cols, f"{P}status", F.size(F.array_distinct(tmp_arr)).cast("bigint").alias(tmp_t),
                           F.size(F.array_distinct(green_codes)).cast("bigint").alias(tmp_g))
    else:
        step = df.select(*cols, green.alias(tmp_arr), st.alias(f"{P}status"))
        extra = [F.col(tmp_arr).alias(f"{P}green_token_mask")] if return_mask else []
        step = step.select(*cols, f"{P}status", *extra,
                           F.size(tmp_arr).cast("bigint").alias(tmp_t),
                           F.size(F.filter(tmp_arr, lambda x: x)).cast("bigint").alias(tmp_g))
    ok = F.col(f"{P}status") == F.lit("ok")
    T, G, Z = f"{P}num_tokens_scored", f"{P}num_green_tokens", f"{P}z_score"
    step = step.withColumn(T, F.when(ok, F.col(tmp_t))).withColumn(G, F.when(ok, F.col(tmp_g))) \
        .drop(tmp_t, tmp_g)
    step = step.withColumn(f"{P}green_fraction", F.col(G).cast("double") / F.col(T).cast("double")) \
        .withColumn(Z, z_score(F.col(G), F.col(T), cfg.gamma))
    thr = F.lit(float(cfg.z_threshold)) if threshold is None else \
        F.coalesce(threshold.cast("double"), F.lit(float(cfg.z_threshold)))
    step = with_normal_sf(step, Z, f"{P}p_value").withColumn(f"{P}prediction", F.col(Z) > thr)
    step = step.withColumn(f"{P}confidence",
                           F.when(F.col(f"{P}prediction"), F.lit(1.0) - F.col(f"{P}p_value")))
    if f"{P}green_token_mask" in step.columns:
        step = step.withColumn(f"{P}green_token_mask", F.when(ok, F.col(f"{P}green_token_mask")))
    return step


def select_fields(scores: DataFrame, keep: list[str], *, return_num_tokens_scored: bool = True,
                  return_num_green_tokens: bool = True, return_green_fraction: bool = True,
                  return_green_token_mask: bool = False, return_z_score: bool = True,
                  return_p_value: bool = True, return_scores: bool = True,
                  return_prediction: bool = True) -> DataFrame:
    """The reference's output switches (P15, P16) as a projection: unrequested
    fields are pruned and Catalyst drops the expressions behind them."""
    flags = [("num_tokens_scored", return_num_tokens_scored), ("num_green_tokens", return_num_green_tokens),
             ("green_fraction", return_green_fraction), ("green_token_mask", return_green_token_mask),
             ("z_score", return_z_score), ("p_value", return_p_value)]
    # a verdict is never shown without its p-value, whatever the other switches say
    cols = [c for c, on in flags if (on and return_scores or c == "p_value" and return_prediction)
            and c in scores.columns]
    if return_prediction:
        cols += ["prediction", "confidence"]
    return scores.select(*keep, *cols, "status")


def text_guard(text: Column) -> Column:
    """Character guard of the reference's detect helper (P8): at least 3 characters."""
    return F.when(text.isNull(), F.lit("null_input")) \
        .when(F.char_length(text) - 1 <= 1, F.lit("too_short"))


def detect_text(df: DataFrame, cfg: WatermarkConfig, text_col: str = "text", *,
                keep: list[str] | None = None, return_mask: bool = False,
                threshold: Column | None = None, normalized_col: str | None = None,
                tokenizer=None, key: str | None = None, models: dict | None = None,
                in_batches: bool = False) -> DataFrame:
    """Detection over a text column: guard -> normalisers -> tokens -> ids -> score.

    ``keep`` lists pass-through columns (default: all but the text). The text column
    itself is dropped unless ``normalized_col`` names a column for the normalised text.
    ``in_batches``: ids and green flags of the default tokenizer are made in Arrow batches, where
    each distinct token is hashed once (:mod:`greenscan.operators.hashed`); the result is the same.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    base = df.select(*keep, F.col(text_col).alias("_text"), text_guard(F.col(text_col)).alias("_guard"))
    if cfg.normalizers:
        base = apply_chain(base, "_text", cfg.normalizers, key=key if key in keep else None, models=models)
    extra = [F.col("_text").alias(normalized_col)] if normalized_col else []
    flags = None
    if in_batches and tokenizer is None and cfg.bos_id is None and cfg.vocab_size <= gl.LITERAL_V:
        from greenscan.operators.hashed import with_flags
        words = tokenize(F.col("_text"), cfg.token_pattern, cfg.lowercase)
        base = with_flags(base.select(*keep, *extra, "_guard", words.alias("_words")), "_words", "_ids", "_green", cfg)
        flags = F.col("_green")
    else:
        # A user tokenizer is any Column -> ARRAY<BIGINT> function (for example a
        # pandas_udf around a subword tokenizer); the default is the regex + hash path
        raw = tokenizer(F.col("_text")) if tokenizer is not None else \
            text_to_ids(F.col("_text"), cfg.vocab_size, cfg.token_pattern, cfg.lowercase)
        base = base.select(*keep, *extra, "_guard", strip_bos(raw, cfg.bos_id).alias("_ids"))
    out = score_ids(base, "_ids", cfg, return_mask=return_mask, threshold=threshold,
                    status=F.col("_guard"), flags=flags)
    return out.drop("_ids", "_green", "_guard")


def detect_ids(df: DataFrame, cfg: WatermarkConfig, ids_col: str = "ids", **kw) -> DataFrame:
    """Detection over pre-tokenised ids (the reference's tokenized_text path);
    a leading BOS id is dropped when ``cfg.bos_id`` is set. Ids that are null or outside
    0..V-1 would alias other bigrams; such rows get the status ``bad_token_id``."""
    keep = [c for c in df.columns if c != ids_col]
    base = df.select(*keep, strip_bos(F.col(ids_col), cfg.bos_id).alias("_ids"))
    bad = F.exists("_ids", lambda x: F.coalesce((x < 0) | (x >= cfg.vocab_size), F.lit(True)))
    kw.setdefault("status", F.when(bad, F.lit("bad_token_id")))
    return score_ids(base, "_ids", cfg, **kw).drop("_ids")


def detect(df: DataFrame, cfg: WatermarkConfig, *, text_col: str | None = None,
           ids_col: str | None = None, **kw) -> DataFrame:
    """Exactly one of text / ids input (P18), checked when the plan is built."""
    if (text_col is None) == (ids_col is None):
        raise ValueError("name the text column or the ids column, and only one of them")
    if text_col is not None:
        return detect_text(df, cfg, text_col, **kw)
    return detect_ids(df, cfg, ids_col, **kw)


# ---------------------------------------------------------------- exploded form

def token_rows(df: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    """(id, pos, prev, tok) for every scored position; ``prev`` via lag."""
    rows = df.select(id_col, F.posexplode(ids_col).alias("pos", "tok"))
    w = Window.partitionBy(id_col).orderBy("pos")
    return rows.withColumn("prev", F.lag("tok").over(w)).where(F.col("prev").isNotNull())


def detect_exploded(df: DataFrame, id_col: str, ids_col: str, cfg: WatermarkConfig) -> DataFrame:
    """Same counts as the row-local form via one row per bigram (A1-A5)."""
    rows = token_rows(df, id_col, ids_col).withColumn("green", gl.is_green(F.col("prev"), F.col("tok"), cfg))
    if cfg.ignore_repeated_bigrams:
        rows = rows.select(id_col, "prev", "tok", "green").distinct()
    agg = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("num_tokens_scored"),
                                   F.sum(F.col("green").cast("long")).alias("num_green_tokens"))
    agg = agg.withColumn("z_score", z_score(F.col("num_green_tokens"), F.col("num_tokens_scored"), cfg.gamma))
    return with_normal_sf(agg, "z_score", "p_value") \
        .withColumn("prediction", F.col("z_score") > F.lit(float(cfg.z_threshold)))
