"""Spellings by number, alphabets as interval sets, languages by bitmap, lookups by content."""
import itertools

import pytest
from pyspark.sql import functions as F

from greenscan.functions import codepoints as cps
from greenscan.operators import generate as gen
from greenscan.operators import homoglyph as hg
from greenscan.operators import lookup
from greenscan.operators import report as rp
from greenscan.operators import spellings as sp
from greenscan.operators import vocab as vb


def test_every_number_is_the_products_spelling(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 4)  # several levels of blocks for small words
    rows = [("w", ["ab", "c", "def", "gh"]), ("one", ["x"]), ("none", []), ("many", ["ab"] * 9), ("é😀", ["éè", "😀😁z"])]
    df = spark.createDataFrame(rows, "word string, lists array<string>")
    got = {}
    for r in sp.spelling_rows(df, "lists", ["word"]).collect():
        got.setdefault(r.word, {})[r.n] = r.spelling
    for word, lists in rows:
        want = ["".join(x) for x in itertools.product(*lists)] if lists else []
        assert [got.get(word, {}).get(n) for n in range(len(want))] == want and len(got.get(word, {})) == len(want)


def test_one_spelling_of_a_huge_word(spark):
    df = spark.createDataFrame([(["abcd"] * 31, 4 ** 31 - 2)], "l array<string>, n long")
    r = df.select(sp.n_spellings(F.col("l")).alias("n"), sp.nth_spelling(F.col("l"), F.col("n")).alias("s")).first()
    assert r.n == 4 ** 31 and r.s == "d" * 30 + "c"
    over = spark.createDataFrame([("w", ["abcd"] * 40)], "word string, l array<string>")
    assert over.select(sp.n_spellings(F.col("l")).alias("n")).first().n is None
    with pytest.raises(Exception, match="2\\^63"):
        sp.spelling_rows(over, "l", ["word"]).count()


def test_ascii_strategies(spark):
    table = sp.variants(spark, hg.alphabet_intervals(spark, ["LATIN", "COMMON", "CYRILLIC"]))
    df = spark.createDataFrame([("ао1",), ("хé",), ("",), (None,), ("漢a",)], "w string")
    got = {r.w: (r.i, r.r, r.x) for r in df.select(
        "w", table.ascii_lattice(F.col("w")).alias("i"),
        table.ascii_lattice(F.col("w"), ascii_strategy=hg.STRATEGY_REMOVE).alias("r"),
        table.ascii_lattice(F.col("w"), hg.STRATEGY_REMOVE).alias("x")).collect()}
    assert got["ао1"] == (["a", "o", "1Il|"],) * 3
    assert got["хé"] == ([], ["x"], [])            # é has no ASCII look-alike
    assert got["漢a"] == ([], ["a"], ["a"])        # outside the alphabet: REMOVE leaves no gap
    assert got[""] == ([], [], []) and got[None] == (None, None, None)


def test_words_that_strategies_remove_keep_their_row(spark):
    words = spark.createDataFrame([("漢字",), ("a漢",), ("",)], "word string")
    got = {r.word: r for r in hg.word_variants(words, "word", spark, strategy=hg.STRATEGY_REMOVE).collect()}
    assert set(got) == {"漢字", "a漢", ""} and got["漢字"].n_variants == 0 and got["漢字"].lattice == ""
    assert got["a漢"].n_ascii == 1
    load = {r.word: r for r in hg.word_variants(words, "word", spark, strategy=hg.STRATEGY_LOAD).collect()}
    assert load["漢字"].n_variants >= 1 and load["漢字"].n_ascii == 0
    with pytest.raises(ValueError):
        hg.word_variants(words, "word", spark, strategy=7)


def test_alphabets_with_a_users_table(spark):
    own = {"xx": "ñж"}
    got = hg.alphabet_intervals(spark, languages=["xx"], table=own)
    assert got == cps.of_chars("ñÑжЖ")
    assert hg.alphabet_intervals(spark, languages=["en"], table=own) == cps.of_chars("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    frame = spark.createDataFrame([("yy", "q"), ("yy", "r")], "lang string, ch string")
    assert hg.alphabet_intervals(spark, languages=["yy"], chars="z", table=frame) == cps.of_chars("qrz")
    assert [r.lang for r in hg.all_languages(spark, own).collect()] == ["de", "en", "es", "fr", "xx"]
    assert sorted(r.ch for r in hg.alphabet(spark, languages=["yy"], table=frame).collect()) == ["q", "r"]
    for bad in (dict(languages=["zz"]), dict(languages=["en"], table=frame), dict(categories=["NOPE"])):
        with pytest.raises(ValueError):
            hg.alphabet_intervals(spark, **bad)
    with pytest.raises(ValueError):
        hg.language_alphabet(spark, ["en"], frame)
    assert hg.alphabet_intervals(spark) == cps.union(hg.alphabet_intervals(spark, ["LATIN"]), hg.alphabet_intervals(spark, ["COMMON"]))


def test_languages_of_texts(spark):
    rows = ["abc", "ß a", "ñ ö", "12 .", "Ж", None, "", "É x"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    every, some = hg.text_languages(F.col("t"))
    got = [(r.e, r.s) for r in df.select(every.alias("e"), some.alias("s")).collect()]
    all4 = ["de", "en", "es", "fr"]
    assert got == [(all4, all4), (["de"], all4), ([], ["de", "es"]), (all4, []), ([], []), (None, None), (all4, []),
                   (["es", "fr"], all4)]
    own = {"xx": "Ж"}
    every, _ = hg.text_languages(F.col("t"), own)
    assert df.where("t = 'Ж'").select(every.alias("e")).first().e == ["xx"]


def test_lookups_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAD", 2)  # most tokens go through the join
    lists = [["a", "b", "a", "c"], ["a", "b", "a", "c"], [], None, ["zz", "a"], ["c"] * 50, ["d", "e", "f", "a"]]
    df = spark.createDataFrame([(None if i % 2 else 1, x) for i, x in enumerate(lists)], "id long, tokens array<string>").repartition(3)
    vocab = vb.vocab_build(df.select(F.explode("tokens").alias("token")).where("token <> 'zz'"), reserved=2)
    ids = {r.token: r.token_id for r in vocab.collect()}
    enc = vb.encode_lists(df, vocab, unk_id=0, reserved=2)
    key = lambda x: str(x)
    assert sorted(((r.tokens, r.ids) for r in enc.collect()), key=key) == sorted(
        ((x, None if x is None else [ids.get(t, 0) for t in x]) for x in lists), key=key)
    back = vb.decode_lists(enc.withColumn("ids", F.concat(F.array(F.lit(1).cast("long")), "ids")).withColumnRenamed("tokens", "was"),
                           vocab, special_ids=[1], reserved=2)
    assert sorted(((r.was, r.tokens) for r in back.collect()), key=key) == sorted(
        ((x, None if x is None else [t if t in ids else "<unk>" for t in x]) for x in lists), key=key)


def test_beam_search_matches_enumeration(spark):
    import random
    rng = random.Random(4)
    table = {(p, t): -rng.randrange(1, 6) for p in range(8) for t in range(8) if rng.random() < .7 and p != 7}
    cands = spark.createDataFrame([(p, t, s) for (p, t), s in table.items()], "prev long, tok long, score long")
    starts = spark.createDataFrame([(i, i % 9 if i % 9 < 8 else None) for i in range(40)], "row long, tok long")
    got = {}
    for r in gen.beam_search(starts, cands, 3, 3, 8).collect():
        got.setdefault((r.row, r.step), []).append((r.beam, r.tok, r.back, r.score))
    for i in range(40):
        beams = [(1, i % 9, 0)] if i % 9 < 8 else []
        for step in (1, 2, 3):
            grown = sorted((-(s + table[p, t]), b, -table[p, t], t) for b, p, s in beams for (q, t) in table if q == p)[:3]
            want = [(k + 1, t, b, -s) for k, (s, b, _, t) in enumerate(grown)]
            assert sorted(got.get((i, step), [])) == want
            beams = [(k, t, s) for k, t, _, s in want]


def test_pair_bins_sum_to_the_pairs(spark):
    rows = [("W", 1.0, 2.0, 5), ("W", 2.0, None, 5), ("W", 3.0, 4.0, 5), ("WO", float("nan"), 1.0, 7), ("WO", 0.0, 3.0, 8), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "arm string, x double, y double, z int")
    got = {(r.arm, r.x_col, r.y_col, r.x_bin, r.y_bin): r.n for r in rp.pair_bins(df, "arm", ["x", "y", "z"], 4).collect()}
    assert got[("W", "x", "y", 0, 0)] == 1 and got[("W", "x", "y", 3, 3)] == 1
    assert got[("W", "x", "z", 2, 0)] == 1 and sum(n for k, n in got.items() if k[0] == "W" and k[1:3] == ("x", "z")) == 3
    assert sum(n for k, n in got.items() if k[0] == "WO" and k[1:3] == ("x", "y")) == 1 and got[(None, "x", "y", 0, 0)] == 1


def test_languages_take_few_characters_apart(spark):
    """Letters of every alphabet are told by one scan; the same languages, also without any
    shared letter, and with letters in no alphabet."""
    own = {"xx": "ab", "yy": "bc", "zz": "b"}
    df = spark.createDataFrame([("b",), ("ab",), ("cb 1",), ("ж",), ("12",), ("",), (None,)], "t string")
    for table in (None, own):
        every, some = hg.text_languages(F.col("t"), table)
        letters = hg.language_letters(table)
        for r in df.select("t", every.alias("e"), some.alias("s")).collect():
            if r.t is None:
                assert r.e is None and r.s is None
                continue
            known = [c for c in r.t if c.isalpha()]
            assert r.e == sorted(k for k, v in letters.items() if all(c in v for c in known))
            assert r.s == sorted(k for k, v in letters.items() if any(c in v for c in known))
    plan = df.select(hg.text_languages(F.col("t"))[0])._jdf.queryExecution().executedPlan().toString()
    assert "split(regexp_replace(" in plan


def test_lists_named_by_row_numbers(spark):
    """Row numbers give the rows that digests give, without a digest of every list."""
    vocab = spark.createDataFrame([("a", 3, 2), ("b", 2, 3)], "token string, n long, token_id long")
    df = spark.createDataFrame([(0, ["a", "b", "x"]), (1, ["a", "b", "x"]), (2, []), (3, None)], "r long, tokens array<string>")
    by_content = vb.encode_lists(df, vocab, unk_id=0, reserved=2)
    by_row = vb.encode_lists(df, vocab, unk_id=0, reserved=2, row="r")
    rows = lambda d: sorted((r.r, r.ids) for r in d.collect())
    assert rows(by_row) == rows(by_content) == [(0, [2, 3, 0]), (1, [2, 3, 0]), (2, []), (3, None)]
    assert "md5" not in by_row._jdf.queryExecution().executedPlan().toString()
    back = vb.decode_lists(by_row.select("r", "ids"), vocab, out_col="back", reserved=2, row="r")
    assert {r.r: r.back for r in back.collect()}[0] == ["a", "b", "<unk>"]


def test_segments_hold_the_products_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(sp, "SEGMENT", 4)
    rows = [["ab", "c", "de", "f", "ghijk", "l", "mn"], ["x", "y"], ["é😀", "z"], ["abcde"], ["ab"] * 7]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, l array<string>")
    parts = {r.i: r.p for r in df.select("i", sp.segments(F.col("l")).alias("p")).collect()}
    for i, lists in enumerate(rows):
        assert ["".join(x) for x in itertools.product(*parts[i])] == ["".join(x) for x in itertools.product(*lists)]
        assert all(len(p) <= 4 or len(p) == 5 for p in parts[i])
    assert parts[1] == [["xy"]] and len(parts[4]) == 4  # two characters a segment: fewer steps a spelling
    got = {}
    for r in sp.spelling_rows(df, "l", ["i"]).collect():
        got.setdefault(r.i, {})[r.n] = r.spelling
    for i, lists in enumerate(rows):
        assert [got[i][n] for n in range(len(got[i]))] == ["".join(x) for x in itertools.product(*lists)]


def test_near_code_points_are_looked_up_by_place(spark):
    table = cps.script_table(spark)
    points = [0, 1, 9, 0x20, 0x41, 0xE9, 0x378, 0x430, cps.DIRECT - 1, cps.DIRECT, cps.DIRECT + 1, 0x4E00, 0x1F600, cps.MAX_CP]
    df = spark.createDataFrame([(p,) for p in points], "cp int")
    assert {r.cp: r.s for r in df.select("cp", table.lookup(F.col("cp")).alias("s")).collect()} == {p: table.find(p) for p in points}
    assert df.select(table.lookup(F.lit(None).cast("int")).alias("s")).first().s is None
    shown = sp.variants(spark, hg.alphabet_intervals(spark))
    words = spark.createDataFrame([(c,) for c in ("\x01", "a", "1", "а", "ω", "漢", "é", "ｌ")], "w string")
    alone = lambda w, strategy: w if strategy == hg.STRATEGY_IGNORE or table.find(ord(w)) in ("LATIN", "COMMON") else ""
    for strategy in (hg.STRATEGY_IGNORE, hg.STRATEGY_REMOVE):
        want = {w: dict(zip(shown.keys, shown.values)).get(ord(w), alone(w, strategy)) for (w,) in words.collect()}
        assert {r.w: "".join(r.l) for r in words.select("w", shown.lattice(F.col("w"), strategy).alias("l")).collect()} == want


def test_strategies_read_the_written_words(spark):
    from greenscan.plans.queries import QUERIES
    plan = QUERIES["variant_strategies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan and "Aggregate" not in plan
