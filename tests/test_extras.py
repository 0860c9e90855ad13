import numpy as np
import pytest
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions.normalize import register_normalizer, str2bool_col
from greenscan.functions.scripts import scripts_present
from greenscan.functions.tokens import TRUNC_NOTICE, text_to_ids, truncated_notice, truncation_flag
from greenscan.operators import homoglyph as hg
from greenscan.operators.detect import detect_text, select_fields
from greenscan.sources.tables import prepare_dataset

from conftest import SF001

CFG = WatermarkConfig()


def test_script_ranges_and_range_lookup(spark):
    ranges = hg.script_ranges(spark)
    latin = {r.ch for r in hg.range_alphabet(ranges, ["LATIN"]).collect()}
    assert {"a", "Z", "é"} <= latin and "а" not in latin
    chars = spark.createDataFrame([("a",), ("а",), ("1",), ("α",)], "ch string")
    got = {r.ch: r.category for r in hg.categorize_chars(chars, ranges).collect()}
    assert got == {"a": "LATIN", "а": "CYRILLIC", "1": "COMMON", "α": "GREEK"}
    with pytest.raises(ValueError):
        hg.range_alphabet(ranges, ["NOPE"])
    names = {r.category for r in hg.all_categories(spark).collect()}
    assert {"LATIN", "CYRILLIC", "GREEK", "COMMON"} <= names
    assert [r.lang for r in hg.all_languages(spark).collect()] == ["de", "en", "es", "fr"]


def test_ascii_readings(spark):
    lat = spark.createDataFrame([("w", [["a", "b"], ["c"]]), ("x", [["a"], []])],
                                "k string, l array<array<string>>")
    got = {r.k: r.readings for r in hg.ascii_readings(lat, "k", "l").collect()}
    assert got == {"w": ["ac", "bc"]}


def test_scripts_present(spark):
    df = spark.createDataFrame([("aа1",)], "t string")
    assert df.select(scripts_present(F.col("t")).alias("s")).first().s == ["LATIN", "CYRILLIC", "COMMON"]


def test_select_fields(spark):
    df = spark.createDataFrame([("x", "a b c d")], "id string, text string")
    out = select_fields(detect_text(df, CFG, "text"), ["id"], return_p_value=False, return_prediction=False)
    assert out.columns == ["id", "num_tokens_scored", "num_green_tokens", "green_fraction", "z_score", "status"]


def test_str2bool_col(spark):
    df = spark.createDataFrame([("Yes",), ("0",)], "v string")
    assert [r.b for r in df.select(str2bool_col(F.col("v")).alias("b")).collect()] == [True, False]
    with pytest.raises(Exception):
        spark.createDataFrame([("maybe",)], "v string").select(str2bool_col(F.col("v"))).collect()


def test_custom_normalizer_and_tokenizer(spark):
    register_normalizer("strip_digits", lambda c: F.regexp_replace(c, "[0-9]", ""))
    cfg = WatermarkConfig(normalizers="strip_digits")
    df = spark.createDataFrame([("x", "a 1 b 2 c")], "id string, text string")
    assert detect_text(df, cfg, "text").first().num_tokens_scored == 2
    tok = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w).cast("bigint"))
    assert detect_text(df, CFG, "text", tokenizer=tok).first().num_tokens_scored == 4


def test_prompt_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2],)], "ids array<bigint>")
    flags = [r.f for r in df.select(truncation_flag(F.col("ids"), 3).alias("f")).collect()]
    assert flags == [1, 0]
    d2 = spark.createDataFrame([("cut", 1, "orig")], "r string, f int, o string")
    assert d2.select(truncated_notice(F.col("r"), F.col("f"), F.col("o")).alias("s")).first().s == "cut" + TRUNC_NOTICE


def test_prepare_dataset_profiles(spark):
    conv = prepare_dataset(spark, SF001, "conversations", limit=5)
    rows = conv.collect()
    assert conv.columns == ["id", "document", "split"] and len(rows) == 5
    assert all(":" in r.id for r in rows)
    with pytest.raises(ValueError):
        prepare_dataset(spark, SF001, "nope")


def test_model_hook(spark):
    from greenscan.operators import generate as gen
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    corpus = docs.select("doc_id", text_to_ids(F.col("text"), CFG.vocab_size).alias("ids"))
    prompts = corpus.limit(3).select(F.col("doc_id").cast("string").alias("id"), "ids")

    def model(cur):  # always offers tokens 5 and 6, 6 preferred
        n = len(cur)
        return np.tile([5, 6], (n, 1)), np.tile([0.0, 10.0], (n, 1))
    out = gen.generate_paired(prompts, corpus, CFG.replace(use_sampling=False, delta=0.0), "id", "ids",
                              max_new_tokens=4, model=model).collect()
    assert all(list(r.WO_ids) == [6, 6, 6, 6] for r in out)


def test_language_and_restricted_tables(spark):
    chars = spark.createDataFrame([("é",), ("ß",), ("a",)], "ch string")
    langs = {r.ch: r.languages for r in hg.languages_of_chars(chars, spark).collect()}
    assert langs["é"] == ["es", "fr"] and langs["ß"] == ["de"] and len(langs["a"]) == 4
    src = spark.createDataFrame([("а",)], "ch string")           # Cyrillic a
    tgt = hg.alphabet(spark)                                      # LATIN + COMMON
    alts = {r.alt for r in hg.restricted_table(spark, src, tgt).collect()}
    assert "a" in alts and not any(0x400 <= ord(a) <= 0x4FF for a in alts)  # no Cyrillic targets


def test_small_helpers(spark):
    from greenscan.functions.tokens import strip_prompt
    from greenscan.operators import report as rp
    from greenscan.operators import vocab as vb
    df = spark.createDataFrame([("aβc", [1, 2, 3, 4, 5], 2, "num_green_tokens / num_tokens_scored")],
                               "s string, ids array<bigint>, n int, k string")
    r = df.select(hg.max_code_point(F.col("s")).alias("m"), strip_prompt(F.col("ids"), F.col("n")).alias("p"),
                  rp.format_names(F.col("k")).alias("f")).first()
    assert r.m == ord("β") and r.p == [3, 4, 5] and r.f == "# Tokens in Greenlist / Tokens Counted (T)"
    res = spark.createDataFrame([("1", 5, 2)], "id string, W_num_tokens_scored long, W_num_green_tokens long")
    assert rp.arm_columns(res, "W", ["num_tokens_scored", "num_green_tokens"]).first() == (5.0, 2.0)
    toks = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b")], "doc long, pos long, token string")
    vocab = vb.vocab_build(toks)
    assert {r.token: r.token_id for r in vocab.collect()} == {"b": 0, "a": 1}
    assert vb.vocab_size_prime(vocab, reserved=1) == 3
    back = vb.decode(vb.encode(toks, vocab), vocab, "token_id", special_ids=[1])
    assert sorted(r.token for r in back.collect()) == ["b", "b"]
