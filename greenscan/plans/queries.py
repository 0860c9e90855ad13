"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import codepoints as cps
from greenscan.functions import scripts as sc
from greenscan.functions.codepoints import script_table
from greenscan.functions.normalize import unicode_sanitize
from greenscan.functions.stats import with_normal_sf
from greenscan.functions.stats import z_score as z_col
from greenscan.functions.tokens import text_to_ids, truncated_notice, truncation_flag
from greenscan.functions.tokens import tokenize as tokenize_col
from greenscan.operators import batches as bt
from greenscan.operators import bigrams as bg
from greenscan.operators import evaluate as ev
from greenscan.operators import generate as gen
from greenscan.operators import homoglyph as hg
from greenscan.operators import report as rp
from greenscan.operators import spellings as sp
from greenscan.operators import truecase as tc
from greenscan.operators import vocab as vb
from greenscan.operators.detect import detect_ids, detect_text
from greenscan.operators.lookup import Blocks
from greenscan.plans.common import CFG, CFG_DISTINCT, LIMIT_ROWS, documents
from greenscan.session import kept, scratch_path
from greenscan.sources.tables import limit_ordered as limit_rows
from greenscan.sources.tables import prepare_dataset, read_table, spread
from greenscan.streaming import stream as st

DETECT_COLS = ["doc_id", "num_tokens_scored", "num_green_tokens", "green_fraction",
               "z_score", "p_value", "prediction", "confidence", "status"]


def detect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: which documents carry the mark? Distinct-bigram test (A2, A5)."""
    return detect_text(documents(spark, sf_dir), CFG_DISTINCT, "text").select(*DETECT_COLS)


def detect_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference defaults: every bigram counted (A1, A4)."""
    return detect_text(documents(spark, sf_dir), CFG, "text").select(*DETECT_COLS)


def detect_legacy_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greenlist taken from the tail of the permutation (select_green_tokens=False)."""
    cfg = CFG_DISTINCT.replace(select_green_tokens=False)
    return detect_text(documents(spark, sf_dir), cfg, "text").select(*DETECT_COLS)


QUERIES = {
    "detect_distinct": detect_distinct,
    "detect_standard": detect_standard,
    "detect_legacy_tail": detect_legacy_tail,
}


# ------------------------------------------------------------ tokens and bigrams

CFG_SMALL_V = WatermarkConfig(vocab_size=101, gamma=0.25)
BOS_ID = 1
PROMPT_CAP = 2048 - CFG.max_new_tokens  # the reference's effective cap (Q16)


def doc_ids(spark, sf_dir, cfg=CFG):
    d = documents(spark, sf_dir)
    return d.select("doc_id", text_to_ids(F.col("text"), cfg.vocab_size).alias("ids"))


def doc_token_rows(spark, sf_dir):
    """(doc_id, pos, token) for every token, pos from 1."""
    d = documents(spark, sf_dir)
    rows = d.select("doc_id", F.posexplode(tokenize_col(F.col("text"))).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos") + 1)


def green_mask(spark, sf_dir):
    """Per-token green mask in order (A7), standard mode, as a '1'/'0' string."""
    d = detect_text(documents(spark, sf_dir), CFG, "text", return_mask=True)
    bits = F.array_join(F.transform("green_token_mask", lambda x: F.when(x, "1").otherwise("0")), "")
    return d.select("doc_id", "num_tokens_scored", "num_green_tokens", bits.alias("mask_bits"), "status")


def bigram_freq(spark, sf_dir):
    return bg.bigram_freq(doc_ids(spark, sf_dir), "doc_id", "ids", CFG)


def bigram_green_table(spark, sf_dir):
    return bg.bigram_green_table(doc_ids(spark, sf_dir), "ids", CFG)


def greenlist_explicit(spark, sf_dir):
    """Green counts through a materialised greenlist (W2) and a join (J2), V = 101."""
    return bg.table_counts(doc_ids(spark, sf_dir, CFG_SMALL_V), "doc_id", "ids", CFG_SMALL_V)


def tokenize(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tokenize_col(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens_joined"))


def vocab_build(spark, sf_dir):
    return vb.vocab_build(doc_token_rows(spark, sf_dir))


SPECIAL_IDS = 2  # ids kept free below the vocabulary: unknown (0), begin of text (1)


def encoded_docs(spark, sf_dir):
    """(doc_id, ids) and the vocabulary. Tokens are written once, in blocks: the vocabulary and
    the encoding read them from there."""
    d = Blocks.of(documents(spark, sf_dir).select("doc_id", tokenize_col(F.col("text")).alias("tokens")), "tokens")
    vocab = kept(vb.vocab_build(d.rows().select(F.explode("tokens").alias("token")), reserved=SPECIAL_IDS), "vocabulary")
    return vb.encode_lists(d, vocab, "tokens", "ids", unk_id=0, reserved=SPECIAL_IDS, keep_list=False), vocab


def vocab_encode(spark, sf_dir):
    """Every document as ids of the learned vocabulary (J4), one row per row."""
    ids, _ = encoded_docs(spark, sf_dir)
    shown = F.transform("ids", lambda x: (x - SPECIAL_IDS).cast("string"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join(shown, " ").alias("ids_joined"))


def ids_to_text(spark, sf_dir):
    """Ids with a begin-of-text id in front back to text, special ids skipped."""
    ids, vocab = encoded_docs(spark, sf_dir)
    begun = ids.select("doc_id", F.concat(F.array(F.lit(BOS_ID).cast("bigint")), "ids").alias("ids"))
    back = vb.decode_lists(begun.withColumn("n_ids", F.size("ids").cast("bigint")), vocab, "ids", "tokens",
                           special_ids=range(SPECIAL_IDS), reserved=SPECIAL_IDS, keep_list=False)
    return back.select("doc_id", "n_ids", F.array_join("tokens", " ").alias("text"))


def bos_strip(spark, sf_dir):
    """Ids arrive with a BOS id in front (as a tokenizer adds it); detection drops it."""
    cfg = CFG.replace(bos_id=BOS_ID)
    d = doc_ids(spark, sf_dir).select(
        "doc_id", F.concat(F.array(F.lit(BOS_ID).cast("bigint")), F.col("ids")).alias("ids"))
    out = detect_ids(d, cfg, "ids")
    return out.select("doc_id", "num_tokens_scored", "num_green_tokens", "z_score", "status")


def prompt_truncate(spark, sf_dir):
    """Prompt cut to the cap, flag, and the shown prompt with a notice."""
    d = documents(spark, sf_dir).select("doc_id", "text", tokenize_col(F.col("text")).alias("t"))
    cut = F.slice("t", 1, PROMPT_CAP)
    flag = truncation_flag(F.col("t"), PROMPT_CAP)
    shown = truncated_notice(F.array_join(cut, " "), flag, F.col("text"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(cut).cast("bigint").alias("n_prompt"), flag.alias("truncation_warning"),
                    shown.alias("prompt_text"))


QUERIES.update({
    "green_mask": green_mask,
    "bigram_freq": bigram_freq,
    "bigram_green_table": bigram_green_table,
    "greenlist_explicit": greenlist_explicit,
    "tokenize": tokenize,
    "vocab_build": vocab_build,
    "vocab_encode": vocab_encode,
    "ids_to_text": ids_to_text,
    "bos_strip": bos_strip,
    "prompt_truncate": prompt_truncate,
})


# ------------------------------------------------------------------ normalisers

# Natural data has no invisible characters, no decomposed accents and no foreign
# look-alikes, so these queries first inject them into every document (the attack
# a normaliser must undo), the same way in Spark and in the oracle.
INJECT_WS = ". ​ "
INJECT_COMMA = ", ‍ "
ATTACK_FROM, ATTACK_TO = "aeo", "аео"  # Latin a e o -> Cyrillic look-alikes


def inject_unicode(text):
    t = F.replace(text, F.lit(". "), F.lit(INJECT_WS))
    t = F.replace(t, F.lit(", "), F.lit(INJECT_COMMA))
    t = F.replace(t, F.lit("é"), F.lit("é"))
    return F.concat(F.lit("﻿"), t, F.lit("\t　end"))


def _unicode_query(ruleset):
    def q(spark, sf_dir):
        d = documents(spark, sf_dir).select("doc_id", inject_unicode(F.col("text")).alias("t"))
        out = d.select("doc_id", unicode_sanitize(F.col("t"), ruleset).alias("text_norm"))
        return out.select("doc_id", "text_norm", F.char_length("text_norm").cast("bigint").alias("n_chars"))
    q.__name__ = f"unicode_{ruleset}"
    return q


def attacked_docs(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", "text", F.translate("text", ATTACK_FROM, ATTACK_TO).alias("attacked"))


# One short sample per script, put behind every document (by its id), so that lookups meet
# scripts that the corpus lacks. Published letters, not taken from our tables.
SCRIPT_SAMPLES = ("Ж я", "Ω λ", "Ա բ", "א ב", "ع ب", "漢字", "ひら", "カタ", "한글", "ไท", "अआ", "অআ", "ਅਆ", "અઆ", "அஆ",
                  "అఆ", "ಅಆ", "അആ", "ქა", "አለ", "Ꭰ Ꭱ", "កខ", "ກຂ", "ཀཁ", "ကခ", "ᚠᚢ", "ᠠᠡ", "ⴰⴱ", "ꀀꀁ", "𐌰𐌱", "😀", "é́")


def sampled_docs(spark, sf_dir):
    pick = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(SCRIPT_SAMPLES))).cast("int")
    sample = F.get(F.array(*[F.lit(x) for x in SCRIPT_SAMPLES]), pick)
    return documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), sample).alias("text"))


def category_lookup(spark, sf_dir):
    """Script of every character of every document by interval search."""
    return hg.category_counts(sampled_docs(spark, sf_dir), "text", script_table(spark))


def text_scripts(spark, sf_dir):
    """The scripts that occur in each document, in name order."""
    names = sorted(sc.all_scripts() + sc.NEUTRAL_SCRIPTS)
    d = sampled_docs(spark, sf_dir).select("doc_id", sc.scripts_present(F.col("text"), names).alias("s"))
    return d.select("doc_id", F.array_join("s", ",").alias("scripts"), F.size("s").cast("bigint").alias("n_scripts"))


def script_vote(spark, sf_dir):
    d = attacked_docs(spark, sf_dir)
    return d.select("doc_id",
                    sc.fast_count(F.col("attacked"), "LATIN").alias("n_latin"),
                    sc.fast_count(F.col("attacked"), "CYRILLIC").alias("n_cyrillic"),
                    sc.fast_count(F.col("attacked"), "GREEK").alias("n_greek"),
                    sc.fast_count(F.col("attacked"), "COMMON").alias("n_common"),
                    sc.vote(F.col("attacked")).alias("target"))


def homoglyph_canon(spark, sf_dir):
    d = attacked_docs(spark, sf_dir)
    d = d.select("doc_id", "text", "attacked", sc.vote(F.col("attacked")).alias("target"))
    c = d.select("doc_id", "target", hg.canonicalize(F.col("attacked"), spark, F.col("target")).alias("canon"),
                 "text")
    return c.select("doc_id", "target", "canon", (F.col("canon") == F.col("text")).alias("restored"),
                    F.char_length("canon").cast("bigint").alias("n_chars"))


def homoglyph_variants(spark, sf_dir):
    words = doc_token_rows(spark, sf_dir).select(F.col("token").alias("word")).distinct()
    return hg.word_variants(words, "word", spark)


SPELLING_SCRIPTS = ("LATIN", "COMMON", "CYRILLIC")


def attacked_words(spark, sf_dir):
    """Distinct tokens of the attacked documents."""
    d = attacked_docs(spark, sf_dir).select(F.explode(tokenize_col(F.col("attacked"))).alias("word"))
    return d.distinct()


def variant_spellings(spark, sf_dir):
    """Every ASCII reading of every distinct word of the attacked documents, one row each, by
    its number (F19, F22); a word with a character that has no ASCII look-alike has none."""
    table = sp.variants(spark, hg.alphabet_intervals(spark, SPELLING_SCRIPTS))
    words = attacked_words(spark, sf_dir).select("word", table.ascii_lattice(F.col("word")).alias("lists"))
    return sp.spelling_rows(words, "lists", ["word"])


def variant_strategies(spark, sf_dir):
    """Characters of each distinct word that IGNORE, REMOVE and LOAD keep with the alphabet
    LATIN + COMMON (F20, F21), and the readings when characters without one are left out."""
    base = kept(sampled_docs(spark, sf_dir).select(F.explode(tokenize_col(F.col("text"))).alias("word")).distinct(), "words")
    table = sp.variants(spark, hg.alphabet_intervals(spark))
    n = lambda strategy: F.size(table.lattice(F.col("word"), strategy)).cast("bigint")
    readable = F.size(table.ascii_lattice(F.col("word"), ascii_strategy=hg.STRATEGY_REMOVE)).cast("bigint")
    # LOAD keeps one row a word, so the other counts are taken in its row
    loaded = hg.word_variants(base, "word", spark, strategy=hg.STRATEGY_LOAD)
    return loaded.select(
        "word", n(hg.STRATEGY_IGNORE).alias("n_ignore"), n(hg.STRATEGY_REMOVE).alias("n_remove"), readable.alias("n_ascii"),
        F.when(F.col("lattice") == "", F.lit(0)).otherwise(F.size(F.split("lattice", " "))).cast("bigint").alias("n_load"))


def alphabet_sets(spark, sf_dir):
    """Characters of each document inside the union of its language's alphabet with COMMON,
    outside it, and inside the alphabet that all four languages share (A16, A16b, U2, S10)."""
    spoken = {lang: hg.alphabet_intervals(spark, languages=[lang]) for lang in sorted(hg.language_letters())}
    common = hg.alphabet_intervals(spark, ["COMMON"])
    shared = reduce(cps.intersection, spoken.values())
    count = lambda s: sc.class_count(F.col("text"), cps.regex_runs(s))
    inside = F.when(F.col("text").isNull(), F.lit(None))
    for lang, letters in spoken.items():
        inside = inside.when(F.col("lang") == lang, count(cps.union(letters, common)))
    d = documents(spark, sf_dir, ("doc_id", "text", "lang")).withColumn("n_inside", inside.otherwise(count(common)))
    return d.select("doc_id", "lang", "n_inside", (F.char_length("text") - F.col("n_inside")).alias("n_outside"),
                    count(shared).alias("n_shared"))


def text_languages(spark, sf_dir):
    """Languages whose alphabet holds every letter of a document, and some of them."""
    every, some = hg.text_languages(F.col("text"))
    return sampled_docs(spark, sf_dir).select("doc_id", F.array_join(every, ",").alias("languages_all"),
                                              F.array_join(some, ",").alias("languages_any"))


def truecase_model(spark, sf_dir):
    return tc.truecase_model(documents(spark, sf_dir), "text")


def truecase_apply(spark, sf_dir):
    """Case-scrambled documents (vowels upper-cased) restored with the corpus model."""
    d = documents(spark, sf_dir)
    model = kept(tc.truecase_model(d, "text"), "truecase-model")
    scrambled = d.select("doc_id", F.translate(F.lower("text"), "aeiou", "AEIOU").alias("text"))
    return tc.truecase_apply(scrambled, model, "doc_id", "text")


CFG_CLEAN = CFG.replace(normalizers="unicode,homoglyphs,truecase", lowercase=False)
ATTACK_ONE = ("o", "о")  # the attack that detect_normalized undoes: one Latin letter by a Cyrillic one


def detect_normalized(spark, sf_dir):
    """Detection after the whole chain of normalisers (F1, the reference's default): documents
    with invisible characters, look-alikes and scrambled case are cleaned, their casing comes
    from a model learned on the documents as written."""
    model = kept(tc.truecase_model(documents(spark, sf_dir), "text"), "truecase-model")
    d = documents(spark, sf_dir).select("doc_id", F.translate(F.lower(inject_unicode(F.col("text"))), "aeiu" + ATTACK_ONE[0],
                                                              "AEIU" + ATTACK_ONE[1]).alias("text"))
    return detect_text(d, CFG_CLEAN, "text", models={"truecase": model}, in_batches=True).select(*DETECT_COLS)


QUERIES.update({
    "detect_normalized": detect_normalized,
    "unicode_whitespaces": _unicode_query("whitespaces"),
    "unicode_ascii": _unicode_query("ascii"),
    "unicode_idn": _unicode_query("idn"),
    "category_lookup": category_lookup,
    "text_scripts": text_scripts,
    "script_vote": script_vote,
    "homoglyph_canon": homoglyph_canon,
    "homoglyph_variants": homoglyph_variants,
    "variant_spellings": variant_spellings,
    "variant_strategies": variant_strategies,
    "alphabet_sets": alphabet_sets,
    "text_languages": text_languages,
    "truecase_model": truecase_model,
    "truecase_apply": truecase_apply,
})


# ------------------------------------------------------- generation and evaluation

GEN_MAX_NEW = 200
MODEL_WORDS = 500
SAMPLE_SEED = CFG.generation_seed
ANALYSIS_METRICS = ("num_tokens_scored", "num_green_tokens", "green_fraction", "z_score", "p_value",
                    "num_output_token")


def scored_candidates(spark, sf_dir, ids=None):
    """Candidate table: every observed successor of every token, scored by log count."""
    ids = doc_ids(spark, sf_dir) if ids is None else ids
    cnt = gen.transition_counts(ids, "ids", CFG.vocab_size)
    return cnt.withColumn("score", F.log(F.col("n").cast("double")))


def bias_scores(spark, sf_dir):
    return gen.bias_scores(scored_candidates(spark, sf_dir), CFG)


def greedy_next(spark, sf_dir):
    """Greedy next token after every observed token, with (w) and without (wo) the
    watermark bias - both choices in one aggregation."""
    c = gen.bias_scores(scored_candidates(spark, sf_dir), CFG)
    return gen.greedy_next_many(c, ["prev"], {"w": "biased_score", "wo": "score"})


def sampled_next(spark, sf_dir):
    c = gen.bias_scores(scored_candidates(spark, sf_dir), CFG)
    return gen.sampled_next(c, ["prev"], "biased_score", SAMPLE_SEED, CFG.sampling_temp)


def transition_table(spark, sf_dir):
    return gen.transition_table(doc_ids(spark, sf_dir), "ids", CFG.vocab_size, None)


def paired_results(spark, sf_dir):
    """15-column result rows: WO = the document as written, W = the same document
    rewritten by biased greedy decoding under teacher forcing (see evaluate). Both arms are
    counted in one pass over the ids, which are written once."""
    d = kept(doc_ids(spark, sf_dir), "ids")  # read twice: by the candidates and by the arms
    c = gen.bias_scores(scored_candidates(spark, sf_dir, d), CFG)
    greedy = gen.greedy_next(c, ["prev"], "biased_score")
    pair = ev.rewrite_counts(d.withColumn("n", F.size("ids").cast("bigint")), "ids", greedy, CFG)
    ok = F.col("n") > 1
    for arm, green in (("WO", "g0"), ("W", "g")):
        pair = pair.withColumn(f"{arm}_num_tokens_scored", F.when(ok, F.col("T"))) \
            .withColumn(f"{arm}_num_green_tokens", F.when(ok, F.col(green))) \
            .withColumn(f"{arm}_num_output_token", F.col("n"))
        t, g = F.col(f"{arm}_num_tokens_scored"), F.col(f"{arm}_num_green_tokens")
        pair = pair.withColumn(f"{arm}_green_fraction", g.cast("double") / t.cast("double")) \
            .withColumn(f"{arm}_z_score", z_col(g, t, CFG.gamma))
        pair = with_normal_sf(pair, f"{arm}_z_score", f"{arm}_p_value") \
            .withColumn(f"{arm}_prediction", F.col(f"{arm}_z_score") > F.lit(float(CFG.z_threshold)))
    pair = pair.withColumn("id", F.col("doc_id").cast("string"))
    return pair.select(*ev.RESULT_COLUMNS)


_RESULTS: dict[tuple, str] = {}


def written_results(spark, sf_dir):
    """The paired rows as a result file. Analysis reads it, as the reference's analysis does;
    it is written once per session and state of the table (files, sizes and times), so the
    analyses recompute nothing."""
    files = read_table(spark, sf_dir, "documents").select(
        "_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("long").alias("at"))
    state = tuple(sorted(tuple(r) for r in files.distinct().collect()))
    key = (spark.sparkContext.applicationId, state)
    if key not in _RESULTS:
        path = scratch_path(spark, "paired-results")
        paired_results(spark, sf_dir).write.parquet(path)
        _RESULTS[key] = path
    return ev.read_results(spark, _RESULTS[key])


def arms_long(spark, sf_dir):
    return ev.unpivot_arms(written_results(spark, sf_dir))


def threshold_rates(spark, sf_dir):
    return ev.threshold_rates(arms_long(spark, sf_dir))


def arm_summary(spark, sf_dir):
    return ev.arm_summary(arms_long(spark, sf_dir))


def histograms(spark, sf_dir):
    return rp.histograms(rp.drop_incomplete(arms_long(spark, sf_dir)), "arm", ANALYSIS_METRICS)


def pair_corr(spark, sf_dir):
    return rp.pair_corr(rp.drop_incomplete(arms_long(spark, sf_dir)), "arm", ANALYSIS_METRICS)


def pair_bins(spark, sf_dir):
    return rp.pair_bins(rp.drop_incomplete(arms_long(spark, sf_dir)), "arm", ANALYSIS_METRICS)


BEAMS, BEAM_STEPS = 3, 2


def beam_step(spark, sf_dir):
    """Two steps of beam search behind the last token of every document, with back pointers
    (T5). Scores are whole millionths of the log probability, so ties are exact."""
    ids = kept(doc_ids(spark, sf_dir).withColumn("row", F.monotonically_increasing_id()), "prompts")
    counts = gen.transition_counts(ids, "ids", CFG.vocab_size)
    total = counts.groupBy(F.col("prev").alias("_p")).agg(F.sum("n").alias("total"))
    cands = kept(counts.join(total, F.col("prev") == F.col("_p")).select(
        "prev", "tok", F.round(F.log(F.col("n").cast("double") / F.col("total")) * 1e6).cast("bigint").alias("score")), "candidates")
    starts = ids.select("row", F.try_element_at("ids", F.lit(-1)).alias("tok"))
    found = gen.beam_search(starts, cands, BEAMS, BEAM_STEPS, CFG.vocab_size)
    return found.join(ids.select("row", "doc_id"), "row").select("doc_id", "step", "beam", "tok", "back", "score")


def sweep_grid(spark, sf_dir):
    out = ev.sweep_gamma(doc_ids(spark, sf_dir), "ids", CFG, keep=("doc_id",))
    return out.select("doc_id", "gamma", "num_tokens_scored", "num_green_tokens", "z_score", "prediction")


def sweep_surface(spark, sf_dir):
    """Detections over gamma, threshold, repeats and head/tail from one pass."""
    return ev.sweep_surface(kept(doc_ids(spark, sf_dir).select("ids"), "ids"), "ids", CFG)


RESULT_BATCHES = 8


def batched_results(spark, sf_dir):
    """Detection written batch by batch with a manifest (S5, Q21): the run is cut off after
    three batches, started again, and ends with the rows of a single run."""
    class Stopped(Exception):
        pass

    def stop(k):
        if k == 2:
            raise Stopped

    folder = scratch_path(spark, "batched-results")
    work = lambda rows: detect_text(rows, CFG, "text").select(*DETECT_COLS)
    run = lambda **kw: bt.run_batches(documents(spark, sf_dir), folder, "doc_id", work, RESULT_BATCHES, "detect_standard", **kw)
    try:
        run(after=stop)
    except Stopped:
        pass
    return run()


def resume_anti_join(spark, sf_dir):
    """Score only documents not already done (the labelled ids stand for them)."""
    done = read_table(spark, sf_dir, "labels").select("doc_id")
    todo = ev.skip_done(documents(spark, sf_dir), done, "doc_id", "doc_id")
    return detect_text(todo, CFG, "text").select(*DETECT_COLS)


def limit_ordered(spark, sf_dir):
    """The first limit_dataset documents by id, scored."""
    d = limit_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LIMIT_ROWS, "doc_id")
    return detect_text(d, CFG, "text").select(*DETECT_COLS)


def display_table(spark, sf_dir):
    d = detect_text(documents(spark, sf_dir), CFG, "text")
    return rp.display_rows(d, "doc_id", CFG.z_threshold)


def category_codes(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return rp.category_codes(d, ["lang", "source"], ["doc_id"])


def generate_paired(spark, sf_dir):
    """Sampled generation of both arms from every document prompt (cut to the
    prompt cap) with a bigram model over the most frequent words, then detection of
    both arms and the paired result rows."""
    docs = documents(spark, sf_dir)
    d = kept(doc_ids(spark, sf_dir), "ids")  # read twice: by the model and by the prompts
    words = gen.top_word_ids(docs, "text", MODEL_WORDS, CFG.vocab_size)
    prompts = d.select(F.col("doc_id").cast("string").alias("id"), F.slice("ids", 1, PROMPT_CAP).alias("ids"))
    g = gen.generate_paired(prompts, d, CFG, "id", "ids", None, GEN_MAX_NEW, model_tokens=words)
    return ev.paired_from_columns(g, CFG)


QUERIES.update({
    "bias_scores": bias_scores,
    "greedy_next": greedy_next,
    "sampled_next": sampled_next,
    "transition_table": transition_table,
    "paired_results": paired_results,
    "threshold_rates": threshold_rates,
    "arm_summary": arm_summary,
    "histograms": histograms,
    "pair_corr": pair_corr,
    "pair_bins": pair_bins,
    "beam_step": beam_step,
    "sweep_grid": sweep_grid,
    "sweep_surface": sweep_surface,
    "batched_results": batched_results,
    "resume_anti_join": resume_anti_join,
    "limit_ordered": limit_ordered,
    "display_table": display_table,
    "category_codes": category_codes,
    "generate_paired": generate_paired,
})


# -------------------------------------------------------------------- streaming


def stream_detect(spark, sf_dir):
    """Documents arrive as a file stream; ids delivered again are known from keyed state,
    labelled ids count as scored before; results are appended idempotently, then read back."""
    src = st.skip_seen(st.read_stream(spark, sf_dir, "documents.parq[u]et"), "doc_id").select("doc_id", "text")
    done = read_table(spark, sf_dir, "labels").select("doc_id")
    todo = st.skip_done_stream(src, done, "doc_id")
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    st.run_to_completion(todo, out, ckpt, sink=st.scoring_sink(CFG, "doc_id", "text", out, DETECT_COLS))
    return st.results(spark, out)


QUERIES["stream_detect"] = stream_detect


# ------------------------------------------------------ second text table


def detect_conversations(spark, sf_dir):
    """Every conversation turn through the dataset profile (id = conv_id:turn,
    text renamed to document), scored with distinct bigrams."""
    d = spread(prepare_dataset(spark, sf_dir, "conversations"))
    out = detect_text(d, CFG_DISTINCT, "document", keep=["id"])
    return out.select("id", *DETECT_COLS[1:])


QUERIES["detect_conversations"] = detect_conversations
