"""Watermarked generation on the data side.

No language model ships with the library. The stand-in model is a corpus bigram
transition table built by Spark (R2); a real model plugs in through the same
``next_scores`` shape. Bias, greedy and sampled choices are DataFrame operators on
a candidate table ``(key..., prev, tok, score)``; whole-sequence generation runs in
``mapInPandas``, vectorised over the rows of each Arrow batch, with the transition
table broadcast (its size is bounded by the model vocabulary or by V x top_k, checked
before anything is collected).
"""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.config import WatermarkConfig
from greenscan.functions import greenlist as gl
from greenscan.functions.tokens import md5_60

# The sampling closure runs in Python workers. Pickle this module's functions by
# value so workers need numpy and pandas only, not an installed greenscan.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older cloudpickle: the package must then be installed on workers
    pass

MAX_BROADCAST_ENTRIES = 50_000_000  # transition entries kept in executor memory
MAX_MODEL_TOKENS = 5_000  # a restricted model vocabulary is a parameter-sized list


# ------------------------------------------------------------ model tables (R2)

def transition_counts(df: DataFrame, ids_col: str, vocab_size: int,
                      model_tokens: DataFrame | None = None) -> DataFrame:
    """(prev, tok, n) over all bigrams; partial aggregation before the shuffle.
    ``model_tokens`` (a small id table, broadcast) filters bigrams before counting."""
    v = F.lit(vocab_size).cast("bigint")
    # places are exploded next to the ids, so that codes are made in generated code
    ids, i = F.col(ids_col), F.col("_i")
    places = F.when(F.size(ids) > 1, F.sequence(F.lit(1), F.size(ids) - 1))
    z = df.select(ids_col, F.explode(places).alias("_i")).select((F.get(ids, i - 1) * v + F.get(ids, i)).alias("_z"))
    if model_tokens is None:
        agg = z.groupBy("_z").agg(F.count(F.lit(1)).alias("n"))
        return agg.select(F.call_function("div", F.col("_z"), v).alias("prev"), (F.col("_z") % v).alias("tok"), "n")
    top = F.broadcast(model_tokens.select("tok"))
    pairs = z.select(F.call_function("div", F.col("_z"), v).alias("prev"), (F.col("_z") % v).alias("tok"))
    pairs = pairs.join(top.withColumnRenamed("tok", "prev"), "prev", "left_semi").join(top, "tok", "left_semi")
    return pairs.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, ids_col: str, n: int) -> DataFrame:
    """The n most frequent token ids (tok); a per-partition top-n, then a merge."""
    cnt = df.select(F.explode(ids_col).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return cnt.orderBy(F.col("n").desc(), F.col("tok")).limit(n).select("tok")


def top_word_ids(docs: DataFrame, text_col: str, n: int, vocab_size: int) -> DataFrame:
    """Ids of the n most frequent alphabetic words of a text table: a model
    vocabulary without punctuation and junk runs (tok)."""
    from greenscan.functions.tokens import token_id, tokenize
    words = docs.select(F.explode(tokenize(F.col(text_col))).alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))
    cnt = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = cnt.orderBy(F.col("n").desc(), F.col("w")).limit(n)
    return top.select(token_id(F.col("w"), vocab_size).alias("tok")).distinct()


def transition_table(df: DataFrame, ids_col: str, vocab_size: int, top_k: int | None = 20,
                     model_tokens: DataFrame | None = None) -> DataFrame:
    """(prev, tok, n, total, rank, logit): successors of each token with
    log-probabilities, ranked by (n desc, tok); ``top_k`` keeps the best k (None keeps
    all). One window per prev holds at most V rows (its distinct successors),
    whatever the corpus size. ``model_tokens`` (a small id table, broadcast) keeps
    only bigrams between those tokens."""
    cnt = transition_counts(df, ids_col, vocab_size, model_tokens)
    w = Window.partitionBy("prev").orderBy(F.col("n").desc(), F.col("tok"))
    ranked = cnt.withColumn("rank", F.row_number().over(w)) \
        .withColumn("total", F.sum("n").over(Window.partitionBy("prev")))
    out = ranked if top_k is None else ranked.where(F.col("rank") <= top_k)
    return out.select("prev", "tok", "n", "total", F.col("rank").cast("bigint").alias("rank"),
                      F.log(F.col("n").cast("double") / F.col("total").cast("double")).alias("logit"))


def unigram_table(df: DataFrame, ids_col: str, top_k: int | None = 20,
                  model_tokens: DataFrame | None = None) -> DataFrame:
    """Back-off successors: (tok, n, logit, rank) over the model tokens (all of
    them) or the top_k tokens overall. Either way the result has a parameter bound
    (the model vocabulary, or k), which the numbering window relies on."""
    if top_k is None and model_tokens is None:
        raise ValueError("unigram back-off needs model_tokens or top_k")
    toks = df.select(F.explode(ids_col).alias("tok"))
    if model_tokens is not None:
        toks = toks.join(F.broadcast(model_tokens.select("tok")), "tok", "left_semi")
    cnt = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    total = cnt.select(F.sum("n").cast("double")).scalar()  # scalar subquery, one value
    top = cnt if top_k is None else cnt.orderBy(F.col("n").desc(), F.col("tok")).limit(top_k)
    w = Window.orderBy(F.col("n").desc(), F.col("tok"))
    return top.select("tok", "n", F.log(F.col("n").cast("double") / total).alias("logit"),
                      F.row_number().over(w).cast("bigint").alias("rank"))


# --------------------------------------------------------- bias and choice

def bias_scores(cands: DataFrame, cfg: WatermarkConfig, score_col: str = "score",
                prev_col: str = "prev", tok_col: str = "tok") -> DataFrame:
    """Greenlist mask (G1) and ``score + delta`` on green candidates (G2), for all
    rows at once (G3); keys come from the broadcast key table."""
    out = gl.with_green(cands, prev_col, tok_col, cfg)
    return out.withColumn("biased_score", F.col(score_col) + F.when(F.col("is_green"), F.lit(float(cfg.delta)))
                          .otherwise(F.lit(0.0)))


def greedy_next(cands: DataFrame, keys: list[str], score_col: str, tok_col: str = "tok") -> DataFrame:
    """Argmax per key (T4); ties go to the smaller token id. max_by aggregates
    partially, so one key with many candidates is combined before the shuffle."""
    best = F.max_by(F.col(tok_col), F.struct(F.col(score_col), (-F.col(tok_col)).alias("_neg")))
    return cands.groupBy(*keys).agg(best.alias("next_tok"), F.max(score_col).alias("next_score"))


def greedy_next_many(cands: DataFrame, keys: list[str], scores: dict, tok_col: str = "tok") -> DataFrame:
    """Several argmax choices per key in one aggregation: ``scores`` maps an output
    suffix to a score column, giving ``next_tok_<suffix>`` and ``score_<suffix>``."""
    aggs = []
    for suffix, col in scores.items():
        aggs.append(F.max_by(F.col(tok_col), F.struct(F.col(col), (-F.col(tok_col)).alias("_neg")))
                    .alias(f"next_tok_{suffix}"))
        aggs.append(F.max(col).alias(f"score_{suffix}"))
    return cands.groupBy(*keys).agg(*aggs)


def gumbel(seed: int, parts: list[Column]) -> Column:
    """Standard Gumbel noise from a keyed hash: the same draw on every run and on
    any executor (u in (0, 1) from 60 bits of md5)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    u = (md5_60(key).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 60))
    return -F.log(-F.log(u))


def sampled_next(cands: DataFrame, keys: list[str], score_col: str, seed: int, temperature: float,
                 tok_col: str = "tok") -> DataFrame:
    """Temperature sampling without a top-k cut (G4) by the Gumbel-max trick:
    argmax(score / T + Gumbel) is a draw from softmax(score / T)."""
    noisy = cands.withColumn("_s", F.col(score_col) / F.lit(float(temperature))
                             + gumbel(seed, [F.col(k) for k in keys] + [F.col(tok_col)]))
    return greedy_next(noisy, keys, "_s", tok_col).withColumnRenamed("next_score", "sample_score")


def beam_top(cands: DataFrame, keys: list[str], score_col: str, n_beams: int,
             tok_col: str = "tok") -> DataFrame:
    """The n_beams best candidates per key (T5, one beam step)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score_col).desc(), F.col(tok_col))
    return cands.withColumn("beam", F.row_number().over(w)).where(F.col("beam") <= n_beams)


BEAM_ROWS = 4_000_000  # candidate rows up to which they are broadcast; V * n_beams bounds them


def beam_step(beams: DataFrame, cands: DataFrame, n_beams: int, vocab_size: int, score_col: str = "score") -> DataFrame:
    """One step of beam search for every row at once (T5): ``beams`` (row, beam, tok, score) ->
    (row, beam, tok, back, score), the ``n_beams`` best continuations of each row over all its
    beams, ``back`` naming the beam they continue. Equal scores go to the smaller beam, then to
    the better candidate, then to the smaller token. Beams without a successor end.

    Only the ``n_beams`` best candidates of a token can get into any row's best, so the
    candidate table is cut to V * n_beams rows first: a row's window then holds at most
    n_beams^2, however common a token is."""
    w = Window.partitionBy("prev").orderBy(F.col(score_col).desc(), F.col("tok"))
    top = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_beams) \
        .select(F.col("prev").alias("_prev"), F.col("tok").alias("_tok"), F.col(score_col).alias("_s"))
    if vocab_size * n_beams <= BEAM_ROWS:
        top = F.broadcast(top)
    grown = beams.join(top, F.col("tok") == F.col("_prev")) \
        .select("row", F.col("beam").alias("back"), F.col("_tok").alias("tok"), (F.col("score") + F.col("_s")).alias("score"), "_s")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "back", F.col("_s").desc(), "tok")
    return grown.withColumn("beam", F.row_number().over(best)).where(F.col("beam") <= n_beams) \
        .select("row", "beam", "tok", "back", "score")


def beam_search(starts: DataFrame, cands: DataFrame, n_beams: int, steps: int, vocab_size: int,
                score_col: str = "score") -> DataFrame:
    """(row, step, beam, tok, back, score) of ``steps`` beam steps from (row, tok); the back
    pointers give every beam's path. Each step is written before the next one reads it."""
    from functools import reduce

    from greenscan.session import kept
    zero = F.lit(0).cast(dict(cands.dtypes)[score_col])
    beams = starts.where(F.col("tok").isNotNull()).select("row", F.lit(1).alias("beam"), "tok", zero.alias("score"))
    told = []
    for k in range(1, steps + 1):
        beams = kept(beam_step(beams, cands, n_beams, vocab_size, score_col), "beams")
        told.append(beams.withColumn("step", F.lit(k)))
    return reduce(DataFrame.unionByName, told)


# ------------------------------------------------------- paired generation

def key_table(spark, cfg: WatermarkConfig) -> DataFrame:
    """(p, a, b) for every token id (see greenscan.functions.greenlist.key_table)."""
    return gl.key_table(spark, cfg)


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hash(s: str) -> int:
    return int.from_bytes(hashlib.md5(s.encode("utf-8")).digest()[:8], "little")


GEN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("n_prompt", T.LongType()),
    T.StructField("WO_ids", T.ArrayType(T.LongType())),
    T.StructField("W_ids", T.ArrayType(T.LongType())),
    T.StructField("WO_num_output_token", T.LongType()),
    T.StructField("W_num_output_token", T.LongType()),
])


def _seg_cumulative(seg_id: np.ndarray, score: np.ndarray, n_seg: int) -> np.ndarray:
    """Per-segment softmax CDF placed on a global increasing scale: entries of
    segment k lie in (k, k + 1], the last one at k + 1 exactly."""
    mx = np.full(n_seg, -np.inf)
    np.maximum.at(mx, seg_id, score)
    w = np.exp(score - mx[seg_id])
    tot = np.zeros(n_seg)
    np.add.at(tot, seg_id, w)
    cum = np.cumsum(w)
    seg_start_cum = np.zeros(n_seg)
    first = np.r_[0, np.flatnonzero(np.diff(seg_id)) + 1] if len(seg_id) else np.array([], dtype=np.int64)
    seg_start_cum[seg_id[first]] = cum[first] - w[first]
    within = (cum - seg_start_cum[seg_id]) / tot[seg_id]
    last = np.r_[first[1:] - 1, len(seg_id) - 1] if len(seg_id) else first
    within[last] = 1.0
    return seg_id + within


def _generator(tbl, cfg: WatermarkConfig, max_new: int, width: int, model=None, hooks=()):
    """Build the per-partition function; ``tbl`` is a broadcast dict of arrays.

    Table path: green depends only on (previous, candidate), so each previous
    token's next-token distribution is fixed per arm; its CDF is built once per
    task and every step draws by binary search on one keyed uniform number (exact
    sampling, O(log k) per row). Rows whose token has no successors back off to
    unigrams, scored per step because their greenness depends on that token.
    ``model(cur) -> (cand, score)`` (E4) replaces the table: ``cur`` holds the last
    token of each row (-1 for none), the result two (rows, k) arrays; each hook
    ``(cur, cand, score) -> score`` (E2) runs before the watermark bias, like a
    logits processor list. That path samples by the Gumbel-max trick."""
    # executors get plain values only: no greenscan class travels with the closure
    cfg = types.SimpleNamespace(
        vocab_size=cfg.vocab_size, n_green=cfg.n_green, select_green_tokens=cfg.select_green_tokens,
        generation_seed=cfg.generation_seed, sampling_temp=cfg.sampling_temp,
        use_sampling=cfg.use_sampling, n_beams=cfg.n_beams, delta=cfg.delta,
        seed_separately=cfg.seed_separately)
    V, G = cfg.vocab_size, cfg.n_green
    head = cfg.select_green_tokens
    seed = np.uint64(cfg.generation_seed)
    temp = cfg.sampling_temp if cfg.use_sampling else 1.0
    np.seterr(over="ignore")

    def green_of(prev, cand, a_key, b_key):
        rank = (a_key[prev][:, None] * cand + b_key[prev][:, None]) % V if cand.ndim == 2 else \
            (a_key[prev] * cand + b_key[prev]) % V
        return (rank < G) if head else (rank >= V - G)

    def uniform(rowkey, salt, step, extra=None):
        x = np.uint64(salt) * np.uint64(1000003) + np.uint64(step) + seed
        if extra is not None:
            x = x + (extra.astype(np.uint64) << np.uint64(20))
            h = _splitmix(rowkey[:, None] ^ _splitmix(x))
        else:
            h = _splitmix(rowkey ^ _splitmix(np.full_like(rowkey, x)))
        return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)

    def choose_dense(cand, score, rowkey, salt, step):
        if cfg.use_sampling:
            score = score / temp - np.log(-np.log(uniform(rowkey, salt, step, cand)))
        best = np.max(score, axis=1)
        tie = np.where(score == best[:, None], cand, np.iinfo(np.int64).max)
        return tie.min(axis=1)

    prepared = {}
    beams = (not cfg.use_sampling) and cfg.n_beams > 1 and model is None

    def prepare(delta):
        """Per-arm CDF (sampling) or argmax (greedy) for every table segment."""
        if delta in prepared:
            return prepared[delta]
        t = tbl.value
        offs, toks, logit = t["offs"], t["toks"], t["logit"]
        n_seg = V + 1  # previous tokens 0..V-1; V is the back-off segment
        seg = np.repeat(np.arange(n_seg + 1)[:-1], np.diff(offs)[:n_seg]) if len(toks) > 1 else np.zeros(0, int)
        score = logit[: len(seg)].copy()
        real = seg < V
        if delta != 0.0 and real.any():
            score[real] = score[real] + delta * green_of(seg[real], toks[: len(seg)][real], t["a"], t["b"])
        if cfg.use_sampling:
            out = ("cdf", _seg_cumulative(seg, score / temp, n_seg))
        else:
            best = np.full(n_seg, -1, dtype=np.int64)
            order = np.lexsort((toks[: len(seg)], -score, seg))  # per segment: best score, smallest id
            firsts = order[np.r_[True, np.diff(seg[order]) != 0]]
            best[seg[firsts]] = toks[firsts]
            out = ("argmax", best)
        prepared[delta] = out
        return out

    def arm(last, rowkey, delta, salt):
        t = tbl.value
        offs, toks, logit = t["offs"], t["toks"], t["logit"]
        a_key, b_key = t["a"], t["b"]
        n = len(last)
        out = np.empty((n, max_new), dtype=np.int64)
        cur = last.copy()
        kind, prep = prepare(delta) if model is None else (None, None)
        b_start, b_end = offs[V], offs[V + 1]
        b_toks, b_logit = toks[b_start:b_end], logit[b_start:b_end]
        for step in range(max_new):
            if model is not None:
                cand, score = model(cur)
                cand = np.asarray(cand, dtype=np.int64)
                score = np.asarray(score, dtype=np.float64)
                for hook in hooks:
                    score = hook(cur, cand, score)
                if delta != 0.0:
                    prev = np.where(cur >= 0, cur, 0)
                    score = score + delta * (green_of(prev, cand, a_key, b_key) & (cur >= 0)[:, None])
                cur = choose_dense(cand, score, rowkey, salt, step)
                out[:, step] = cur
                continue
            idx = np.where(cur >= 0, cur, V)
            has = (offs[idx + 1] > offs[idx]) & (idx < V)
            nxt = np.empty(n, dtype=np.int64)
            if has.any():
                rows = np.flatnonzero(has)
                seg = idx[rows]
                if kind == "cdf":
                    u = uniform(rowkey[rows], salt, step)
                    pos = np.searchsorted(prep, seg + u, side="left")
                    pos = np.minimum(np.maximum(pos, offs[seg]), offs[seg + 1] - 1)
                    nxt[rows] = toks[pos]
                else:
                    nxt[rows] = prep[seg]
            if (~has).any():
                rows = np.flatnonzero(~has)
                cand = np.broadcast_to(b_toks, (len(rows), len(b_toks)))
                score = np.broadcast_to(b_logit, cand.shape).copy()
                if delta != 0.0:
                    valid = cur[rows] >= 0
                    prev = np.where(valid, cur[rows], 0)
                    score = score + delta * (green_of(prev, cand, a_key, b_key) & valid[:, None])
                nxt[rows] = choose_dense(cand, score, rowkey[rows], salt, step)
            cur = nxt
            out[:, step] = cur
        return out

    def dense_candidates(cur, t):
        """(rows, width) candidates and log-probabilities from the table; rows whose
        token has no successors use the back-off segment. Padding scores -inf."""
        offs, toks, logit = t["offs"], t["toks"], t["logit"]
        idx = np.where(cur >= 0, cur, V)
        empty = (offs[idx + 1] == offs[idx]) | (idx >= V)
        start = np.where(empty, offs[V], offs[idx])
        end = np.where(empty, offs[V + 1], offs[idx + 1])
        w = int(max(1, (end - start).max()))
        pos = start[:, None] + np.arange(w)[None, :]
        valid = pos < end[:, None]
        pos = np.where(valid, pos, start[:, None])
        return toks[pos], np.where(valid, logit[pos], -np.inf)

    def beam_arm(last, delta):
        """Beam search with ``cfg.n_beams`` beams (no sampling): the bias is added to
        each candidate's log-probability, beam scores accumulate, the best final beam
        is returned. Ties resolve by beam, then table order (deterministic)."""
        t = tbl.value
        a_key, b_key = t["a"], t["b"]
        n, B = len(last), cfg.n_beams
        rows = np.arange(n)[:, None]
        seqs = np.zeros((n, B, max_new), dtype=np.int64)
        beam_score = np.full((n, B), -np.inf)
        beam_score[:, 0] = 0.0
        cur = np.repeat(last[:, None], B, axis=1)
        for step in range(max_new):
            flat = cur.reshape(-1)
            cand, score = dense_candidates(flat, t)
            if delta != 0.0:
                valid = flat >= 0
                prev = np.where(valid, flat, 0)
                score = score + delta * (green_of(prev, cand, a_key, b_key) & valid[:, None])
            W = cand.shape[1]
            total = (beam_score.reshape(-1)[:, None] + score).reshape(n, B * W)
            top = np.argsort(-total, axis=1, kind="stable")[:, :B]
            src_beam, src_cand = top // W, top % W
            tok = cand.reshape(n, B, W)[rows, src_beam, src_cand]
            beam_score = total[rows, top]
            seqs = seqs[rows, src_beam]
            seqs[:, :, step] = tok
            cur = tok
        best = np.argmax(beam_score, axis=1)
        return seqs[np.arange(n), best]

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            n_prompt = pdf["n_prompt"].fillna(0).to_numpy(dtype=np.int64)
            last = pdf["last"].fillna(-1).to_numpy(dtype=np.int64)
            rowkey = np.array([_row_hash(str(i)) for i in pdf["id"]], dtype=np.uint64)
            if beams:
                wo, w = beam_arm(last, 0.0), beam_arm(last, float(cfg.delta))
            else:
                wo = arm(last, rowkey, 0.0, 0)
                # same seed for both arms, or a continued stream (a different salt)
                w = arm(last, rowkey, float(cfg.delta), 0 if cfg.seed_separately else 1)
            total = n_prompt + max_new
            yield pd.DataFrame({
                "id": pdf["id"].astype(str), "n_prompt": n_prompt,
                "WO_ids": list(wo), "W_ids": list(w),
                "WO_num_output_token": total, "W_num_output_token": total})
    return run


def generate_paired(prompts: DataFrame, corpus_ids: DataFrame, cfg: WatermarkConfig,
                    id_col: str = "id", ids_col: str = "ids", top_k: int | None = None,
                    max_new_tokens: int | None = None, model_tokens: DataFrame | None = None,
                    model=None, hooks=()) -> DataFrame:
    """Both arms for every prompt: WO (no bias) and W (delta on green successors),
    ``max_new_tokens`` each (G6, G7). Sampling uses the model's whole conditional
    distribution (no top-k cut, as configured in the reference) unless ``top_k`` asks
    for one. Prompts are id arrays; only their last token conditions the bigram
    model; ``model_tokens`` restricts the model to a token set such as
    :func:`top_word_ids` (others back off to unigrams). Output: ``GEN_SCHEMA``
    (generated ids exclude the prompt; the token counts include it, as a
    decoder-only model reports them).
    """
    spark = prompts.sparkSession
    max_new = cfg.max_new_tokens if max_new_tokens is None else max_new_tokens
    keys = key_table(spark, cfg).orderBy("p").toPandas()  # V rows
    tbl = {"a": keys["a"].to_numpy(dtype=np.int64), "b": keys["b"].to_numpy(dtype=np.int64),
           "offs": np.zeros(cfg.vocab_size + 2, dtype=np.int64), "toks": np.zeros(1, dtype=np.int64),
           "logit": np.zeros(1, dtype=np.float64)}
    width = 1
    if model is None:
        # size bound of the broadcast model, known before the table is built
        if model_tokens is not None:
            # a parameter-sized table (e.g. the top 500 words): fetch it once, checked,
            # so the semi-joins below do not recompute it
            toks = [int(r[0]) for r in model_tokens.select("tok").limit(MAX_MODEL_TOKENS + 1).collect()]
            if len(toks) > MAX_MODEL_TOKENS:
                raise ValueError(f"model_tokens holds more than {MAX_MODEL_TOKENS} tokens")
            model_tokens = spark.createDataFrame([(t,) for t in toks], "tok bigint")
            n_model = len(toks)
            bound = n_model * (n_model + 1) if top_k is None else (n_model + 1) * top_k
        elif top_k is not None:
            bound = (cfg.vocab_size + 1) * top_k
        else:
            raise ValueError("sampling without a cut needs model_tokens to bound the model")
        if bound > MAX_BROADCAST_ENTRIES:
            raise ValueError("transition table would exceed the broadcast bound; restrict the model")
        trans = transition_table(corpus_ids, ids_col, cfg.vocab_size, top_k, model_tokens)
        if top_k is None:
            # the whole model is collected anyway (bounded as checked above); its
            # successor marginals are the back-off unigram distribution
            tpdf = trans.select("prev", "tok", "n", "rank", "logit").orderBy("prev", "rank").toPandas()
            uni = tpdf.groupby("tok", as_index=False)["n"].sum()
            uni = uni.sort_values(["n", "tok"], ascending=[False, True]).reset_index(drop=True)
            uni["logit"] = np.log(uni["n"].to_numpy(dtype=np.float64) / float(uni["n"].sum()))
            uni["rank"] = np.arange(1, len(uni) + 1)
            uni["prev"] = cfg.vocab_size
            pdf = pd.concat([tpdf[["prev", "tok", "rank", "logit"]], uni[["prev", "tok", "rank", "logit"]]],
                            ignore_index=True)
        else:
            back = unigram_table(corpus_ids, ids_col, top_k, model_tokens) \
                .withColumn("prev", F.lit(cfg.vocab_size).cast("bigint"))
            rows = trans.select("prev", "tok", "rank", "logit").unionByName(
                back.select("prev", "tok", "rank", "logit"))
            pdf = rows.orderBy("prev", "rank").toPandas()  # bounded as checked above
        counts = np.bincount(pdf["prev"].to_numpy(dtype=np.int64), minlength=cfg.vocab_size + 1)
        width = int(max(1, counts.max()))
        offs = np.zeros(cfg.vocab_size + 2, dtype=np.int64)
        offs[1:] = np.cumsum(counts[:cfg.vocab_size + 1])
        tbl.update({"offs": offs, "toks": pdf["tok"].to_numpy(dtype=np.int64),
                    "logit": pdf["logit"].to_numpy(dtype=np.float64)})
    tbl = spark.sparkContext.broadcast(tbl)
    # the bigram model conditions on the prompt's last token; only that and the
    # prompt length cross into Python, not the prompt arrays
    n = F.size(F.col(ids_col))
    src = prompts.select(F.col(id_col).cast("string").alias("id"),
                         F.when(F.col(ids_col).isNull(), F.lit(0)).otherwise(n).cast("bigint").alias("n_prompt"),
                         F.when(n > 0, F.element_at(F.col(ids_col), -1)).cast("bigint").alias("last"))
    return src.mapInPandas(_generator(tbl, cfg, max_new, width, model, tuple(hooks)), GEN_SCHEMA)


def green_py(prev: int, toks: np.ndarray, cfg: WatermarkConfig) -> np.ndarray:
    """Reference implementation of the closed form in Python (tests)."""
    k = int(hashlib.md5(str(cfg.hash_key * prev).encode()).hexdigest()[:15], 16)
    a = k % (cfg.vocab_size - 1) + 1
    b = (k // (cfg.vocab_size - 1)) % cfg.vocab_size
    rank = (a * np.asarray(toks, dtype=np.int64) + b) % cfg.vocab_size
    if cfg.select_green_tokens:
        return rank < cfg.n_green
    return rank >= cfg.vocab_size - cfg.n_green


__all__ = ["transition_counts", "transition_table", "top_tokens", "top_word_ids", "unigram_table",
           "bias_scores", "greedy_next", "greedy_next_many", "sampled_next", "beam_top", "generate_paired",
           "gumbel", "key_table", "green_py"]
