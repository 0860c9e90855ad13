import pytest
from pyspark.sql import functions as F

from greenscan.functions.normalize import apply_chain, lookup, unicode_sanitize
from greenscan.functions.scripts import vote
from greenscan.operators import homoglyph as hg
from greenscan.operators import truecase as tc

# FIXTURES.md section 3, unicode normaliser with the whitespaces ruleset
UNICODE_CASES = [
    ("a b", "a b"),
    ("a​​b", "a b"),
    ("x\ny", "xy"),
    ("x \n y", "x  y"),
    ("é", "é"),
    ("﻿hi‍", " hi "),
    ("tab\there", "tabhere"),
    ("", ""),
]


def test_unicode_whitespaces(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(UNICODE_CASES)], "i int, t string")
    got = {r.i: r.o for r in df.select("i", unicode_sanitize(F.col("t")).alias("o")).collect()}
    for i, (_, exp) in enumerate(UNICODE_CASES):
        assert got[i] == exp, (UNICODE_CASES[i], got[i])


def test_unicode_rulesets(spark):
    df = spark.createDataFrame([("café naïve ☃☃ x",)], "t string")
    r = df.select(unicode_sanitize(F.col("t"), "ascii").alias("a"),
                  unicode_sanitize(F.col("t"), "idn").alias("i")).first()
    assert r.a == "caf na ve x"
    assert r.i == "café naïve ☃☃ x"


def test_unicode_idempotent_on_clean_text(spark):
    df = spark.createDataFrame([("Plain text, twice. And more",)], "t string")
    once = df.select(unicode_sanitize(F.col("t")).alias("t"))
    twice = once.select(unicode_sanitize(F.col("t")).alias("t"))
    assert once.first().t == twice.first().t == "Plain text, twice. And more"


def test_unknown_normalizer_fails_early():
    with pytest.raises(ValueError):
        lookup("nope")


CYR_A, CYR_P, CYR_E = "а", "р", "е"


def test_script_vote(spark):
    cases = [
        (CYR_A + CYR_P + CYR_P + "le", "CYRILLIC"),   # 3 : 2
        (CYR_A + CYR_P + "ypal", "LATIN"),            # 2 : 4
        ("apple", "LATIN"),
        (CYR_A + CYR_P + "le", "CYRILLIC"),           # 2 : 2, first seen wins
        ("1 2 3 a", "LATIN"),                         # COMMON does not win (Q14)
        ("1 2 3", "COMMON"),
        ("", "COMMON"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", vote(F.col("t")).alias("v")).collect()}
    for i, (_, exp) in enumerate(cases):
        assert got[i] == exp, cases[i]


def test_homoglyph_canon_restores_latin(spark):
    text = "The quick brown fox jumps over the lazy dog again and again"
    attacked = text.replace("a", CYR_A).replace("e", CYR_E).replace("o", "о")
    df = spark.createDataFrame([(1, attacked), (2, text)], "id int, t string")
    out = {r.id: r.c for r in df.select("id", hg.canonicalize(F.col("t"), spark).alias("c")).collect()}
    assert out[1] == text and out[2] == text
    via_chain = apply_chain(df, "t", ["homoglyphs"]).orderBy("id").collect()
    assert [r.t for r in via_chain] == [text, text]


def test_uniq_and_sort(spark):
    df = spark.createDataFrame([(["b", "aa", "a", "b"],)], "v array<string>")
    assert df.select(hg.uniq_and_sort(F.col("v")).alias("s")).first().s == ["aa", "a", "b"]


def test_variants_and_expansion(spark):
    words = spark.createDataFrame([("ab",)], "word string")
    v = hg.word_variants(words, "word", spark).first()
    # product of per-character choices, mathematical letters included; one of each is ASCII
    a, b = v.lattice.split(" ")
    assert {"a", "ɑ", "\U0001d41a"} <= set(a) and {"b", "Ƅ", "\U0001d41b"} <= set(b)
    assert v.n_variants == float(len(a) * len(b)) and v.n_ascii == 1.0
    lat = spark.createDataFrame([("k", [["a", "b"], ["c", "d", "e"]])], "k string, l array<array<string>>")
    got = sorted(r.variant for r in hg.expand_variants(lat, "k", "l").collect())
    assert got == ["ac", "ad", "ae", "bc", "bd", "be"]


def test_alphabet_errors(spark):
    with pytest.raises(ValueError):
        hg.alphabet(spark, categories=["KLINGON"])
    with pytest.raises(ValueError):
        hg.language_alphabet(spark, ["xx"])
    with pytest.raises(ValueError):
        hg.variant_table(spark, strategy=9)


def test_truecase_fixture(spark):
    df = spark.createDataFrame([(1, "wRIte TeXt lIkE tHis")], "id int, text string")
    model = spark.createDataFrame([("paris", "Paris", 3, 3)], "key string, form string, n_form long, n_total long")
    assert tc.truecase_apply(df, model, "id", "text").first().truecased == "Write text like this"
    r = tc.truecase_apply(df, model, "id", "text", sentence_start=False, join_with_spaces=True).first()
    assert r.truecased == "write text like this"
    df2 = spark.createDataFrame([(2, "we went to PARIS. then home")], "id int, text string")
    assert tc.truecase_apply(df2, model, "id", "text").first().truecased == "We went to Paris. Then home"


def test_truecase_model_learns_proper_nouns(spark):
    df = spark.createDataFrame([(1, "We saw Paris. Then Paris again and paris once."),
                                (2, "In Paris we met. the end")], "id int, text string")
    m = {r.key: r.form for r in tc.truecase_model(df, "text").collect()}
    assert m["paris"] == "Paris" and m["we"] == "we" and "in" not in m


def test_variants_load_strategy(spark):
    words = spark.createDataFrame([("аb",)], "word string")  # Cyrillic a, Latin b
    ign = hg.word_variants(words, "word", spark, strategy=hg.STRATEGY_IGNORE).first()
    load = hg.word_variants(words, "word", spark, strategy=hg.STRATEGY_LOAD).first()
    rem = hg.word_variants(words, "word", spark, strategy=hg.STRATEGY_REMOVE).first()
    assert ign.lattice.split(" ")[0] == "а"        # outside LATIN+COMMON: kept alone
    assert len(load.lattice.split(" ")[0]) > 1     # CYRILLIC loaded: look-alikes found
    assert rem.lattice.startswith("bƄ") and rem.n_variants == len(rem.lattice)  # removed: the spellings skip it


def test_letters_without_look_alikes_stay_when_removing(spark):
    abc = spark.createDataFrame([(c,) for c in "gamesq"], "ch string")
    words = spark.createDataFrame([("game",), ("gaжme",)], "word string")
    rem = {r.word: r.lattice for r in hg.word_variants(words, "word", spark, abc, hg.STRATEGY_REMOVE).collect()}
    assert rem == {"game": "g a m e", "gaжme": "g a m e"}


def test_loading_prefers_languages_and_leaves_known_letters_alone(spark):
    abc = spark.createDataFrame([("o",), ("0",)], "ch string")
    words = spark.createDataFrame([("o",), ("é",)], "word string")
    own = hg.language_table(spark, {"xx": "éo"})
    got = {r.word: r.lattice for r in hg.word_variants(
        spark.createDataFrame([("o",)], "word string"), "word", spark, abc, hg.STRATEGY_LOAD).collect()}
    assert got == {"o": "o"}
    got = {r.word: r.lattice for r in hg.word_variants(words, "word", spark, abc, hg.STRATEGY_LOAD, own).collect()}
    assert set(got["é"]) >= {"é"} and "o" in got["o"]


def test_votes_and_rewrites_any_script(spark):
    rows = [(1, "ภาษาไทย abc"), (2, "հայերեն o"), (3, "m𝐚th ӕ text"), (4, "שלום"), (5, "1 2 3"), (6, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: (r.v, r.c) for r in df.select("id", vote(F.col("t")).alias("v"),
                                               hg.canonicalize(F.col("t"), spark).alias("c")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["THAI", "ARMENIAN", "LATIN", "HEBREW", "COMMON", None]
    assert got[3][1] == "m𝐚th æ text" and got[5][1] == "1 2 3" and got[6][1] is None

def test_controls_as_space_option(spark):
    df = spark.createDataFrame([("x\ny",)], "t string")
    r = df.select(unicode_sanitize(F.col("t")).alias("a"), unicode_sanitize(F.col("t"), cc_as_space=True).alias("b")).first()
    assert r.a == "xy" and r.b == "x y"


def test_truecase_in_detection_chain(spark):
    from greenscan.config import WatermarkConfig
    from greenscan.operators.detect import detect_text
    cfg = WatermarkConfig(lowercase=False)
    text = "We saw Paris today. Then we left Paris again and went home."
    scrambled = "wE SaW pARIS tOdAy. tHeN wE LeFt PaRiS aGaIn AnD wEnT hOmE."
    df = spark.createDataFrame([(1, text), (2, scrambled)], "id int, text string")
    out = {r.id: (r.num_green_tokens, r.num_tokens_scored)
           for r in detect_text(df, cfg.replace(normalizers="truecase"), "text").collect()}
    assert out[1] == out[2]  # the scrambled copy scores like the original once truecased
    keyed = {r.id: (r.num_green_tokens, r.num_tokens_scored)
             for r in detect_text(df, cfg.replace(normalizers="truecase"), "text", key="id").collect()}
    assert keyed == out
    plain = {r.id: r.num_green_tokens for r in detect_text(df, cfg, "text").collect()}
    assert set(plain) == {1, 2}


def test_vote_takes_no_array_of_all_foreign_characters(spark):
    """Counts and votes by taking runs out, against a plain count of every character's script."""
    from greenscan.functions import scripts as sc
    from greenscan.functions.codepoints import script_table
    texts = ["", None, "abc", "12 !", "аbв", "bаab", "аb", "bа", "ωаω b", "аω漢漢", "́́a", "͸a", "͸ж", "͸", "a漢字б漢", "é٣ж"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = script_table(spark)
    names = ("LATIN", "CYRILLIC", "GREEK", "COMMON")
    out = df.select("i", sc.vote(F.col("t")).alias("v"), *[sc.fast_count(F.col("t"), s).alias(s) for s in names])
    for r in out.collect():
        t = texts[r.i]
        if t is None:
            assert list(r[1:]) == [None] * 5
            continue
        found = [table.find(ord(c)) for c in t]
        assert [r[s] for s in names] == [found.count(s) for s in names]
        real = [s for s in found if s not in (None, "COMMON", "INHERITED")]
        assert r.v == (max(real, key=lambda s: (real.count(s), -real.index(s))) if real else "COMMON"), t
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
