"""Interval tables, binary search in columns, interval sets: against plain Python."""
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from greenscan.functions import codepoints as cps
from greenscan.functions.scripts import scripts_present, vote
from greenscan.operators import homoglyph as hg

RANGES = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.sampled_from("ABC")), max_size=12)


def first_hit(ranges, cp):
    return next((name for lo, hi, name in ranges if lo <= cp <= hi), None)


@given(RANGES)
@settings(max_examples=200, deadline=None)
def test_disjoint_keeps_the_first_hit(ranges):
    table = cps.IntervalTable.of(ranges)
    assert [table.find(cp) for cp in range(62)] == [first_hit(ranges, cp) for cp in range(62)]
    parts = table.ranges()
    assert all(a[1] < b[0] for a, b in zip(parts, parts[1:])) and list(table.starts) == sorted(set(table.starts))


@given(RANGES, RANGES)
@settings(max_examples=200, deadline=None)
def test_interval_sets(a, b):
    a, b = [r[:2] for r in a], [r[:2] for r in b]
    members = lambda s: {x for lo, hi in s for x in range(lo, hi + 1)}
    for got, want in ((cps.union(a, b), members(a) | members(b)), (cps.intersection(a, b), members(a) & members(b))):
        assert members(got) == want and cps.size(got) == len(want)
        assert all(x[1] + 1 < y[0] for x, y in zip(got, got[1:]))


def test_lookup_in_columns_with_overlaps_and_gaps(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 40):
        ranges = [(lo := rng.randrange(1, 500), lo + rng.randrange(0, 90), f"n{i % 5}") for i in range(n)]
        df = spark.range(0, 620).select(F.col("id").cast("int").alias("cp"))
        got = df.select("cp", cps.IntervalTable.of(ranges).lookup(F.col("cp")).alias("c")).collect()
        assert {r.cp: r.c for r in got} == {cp: first_hit(ranges, cp) for cp in range(620)}


def test_table_order_decides(spark):
    ranges = spark.createDataFrame([(2, 65, 90, "UPPER"), (1, 65, 70, "EARLY"), (3, 48, 122, "WIDE")],
                                   "ord int, lo int, hi int, category string")
    chars = spark.createDataFrame([("A",), ("Z",), ("a",), ("é",), (None,), ("",)], "ch string")
    got = {r.ch: r.category for r in hg.categorize_chars(chars, ranges).collect()}
    assert got == {"A": "EARLY", "Z": "UPPER", "a": "WIDE", "é": None, None: None, "": None}
    counted = hg.category_counts(spark.createDataFrame([("AA é",), (None,), ("",)], "t string"), "t", hg.interval_table(ranges))
    assert {(r.ch, r.code_point, r.category, r.n) for r in counted.collect()} == {
        ("A", 65, "EARLY", 2), (" ", 32, None, 1), ("é", 233, None, 1)}


def test_find_sorted_is_a_dictionary(spark):
    keys = sorted(f"w{i * i}" for i in range(37))
    df = spark.createDataFrame([(keys, list(range(37)), [*keys, "", "zz", "w5"]), ([], [], ["a"]), (["a"], [7], ["a", "b"])],
                               "k array<string>, v array<int>, x array<string>")
    out = df.withColumn("p", cps.probes(F.size("k"))).select("k", "v", "x", F.transform(
        "x", lambda x: cps.find_sorted(F.col("k"), F.col("v"), x, F.col("p"))).alias("got")).collect()
    for r in out:
        assert r.got == [dict(zip(r.k, r.v)).get(x) for x in r.x]


def test_script_table_agrees_with_character_names(spark):
    table = cps.script_table(spark)
    for cp in [*range(0x41, 0x5B), *range(0x400, 0x460), *range(0x5D0, 0x5EB), *range(0x4E00, 0x4E40), *range(0x10A0, 0x10C0)]:
        name = unicodedata.name(chr(cp), "").split(" ")[0]
        if name:
            assert table.find(cp) == {"CJK": "HAN"}.get(name, name)
    assert table.find(0x20) == "COMMON" and table.find(0x301) == "INHERITED" and table.find(0x0378) is None


def test_vote_and_scripts_of_odd_texts(spark):
    rows = [None, "", "12 !", "abc", "аб ab", "ab аб", "漢字かなa", "͸", "עע אא aa b", "한글 mixed Ελλ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: (r.v, r.s) for r in df.select("i", vote(F.col("t")).alias("v"), scripts_present(F.col("t")).alias("s")).collect()}
    assert [got[i][0] for i in range(10)] == [None, "COMMON", "COMMON", "LATIN", "CYRILLIC", "LATIN", "HAN", "COMMON", "HEBREW", "LATIN"]
    assert got[0][1] is None and got[1][1] == [] and got[4][1] == ["LATIN", "CYRILLIC", "COMMON"] and got[7][1] == []


def test_a_range_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(hg, "MAX_RANGES", 2)
    with pytest.raises(ValueError):
        hg.interval_table(spark.createDataFrame([(1, 2, "A")] * 3, "lo int, hi int, category string"))


def test_runs_count_like_single_characters(spark):
    from greenscan.functions.scripts import class_count
    sets = [((0x41, 0x5A), (0x61, 0x7A), (0xE0, 0xFF), (0x1F600, 0x1F64F)), ((0x80, 0x10FFFF),), ((0x20, 0x2F),), ()]
    texts = ["", None, "aé😀 b-]^\\[&&", "ÿÀ\n\t ж", "!!", "漢字a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for s in sets:
        for r in df.select("t", class_count(F.col("t"), cps.regex_runs(s)).alias("n")).collect():
            want = None if r.t is None else sum(any(lo <= ord(c) <= hi for lo, hi in s) for c in r.t)
            assert r.n == want, (r.t, s)
