"""op3: components against brute force; the exactness of the bitmap test; nulls and hot groups."""
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from greenscan.llm import minhash
from greenscan.llm.bitmaps import apart_at_most, bits_apart, parity_bits
from greenscan.llm.components import components

from llm_texts import prose


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    ids = [i for i, _ in rows]
    s = dict(rows and [(i, sets(t)) for i, t in rows])
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                n = len(s[a] & s[b])
                if 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


def test_components_match_brute_force_with_hot_groups(spark):
    rng = random.Random(3)
    base = prose(11, 150).split()
    rows = [(i, edited(rng, base, rng.choice([0, .005, .01, .02, .04]))) for i in range(160)]
    rows += [(1000 + i, prose(500 + i, 40)) for i in range(60)]
    rows += [(2000 + i, prose(500 + i, 40) + (" tail words" if i % 2 else "")) for i in range(60)]
    rows += [(3000 + i, "  ".join(base)) for i in range(50)] + [(4000, ""), (4001, "a b"), (4002, "A  b"), (4003, "b a")]
    want = brute(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    base = prose(12, 120).split()
    rows = [(i, edited(rng, base, rng.choice([.01, .02, .03, .05]))) for i in range(120)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[i][0]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert all(by[i][0]["component_id"] == i for i in (0, 1, 2, 3, 9, 11, 12))
    assert by[4][0]["component_id"] == 3 and not by[4][0]["kept"]
    assert all(by[i][0]["component_id"] == 5 for i in (5, 6, 7, 8)) and by[15][0]["component_id"] == 14
    assert len(by[13]) == 2 and all(r["kept"] for r in by[13])  # rows of one document
    assert sorted((r["component_id"] is None, r["kept"]) for r in by[None]) == [(False, False), (True, True), (True, True)]
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {4, 6, 7, 8, 15} & set(ids) and ids.count(13) == 2 and ids.count(None) == 3
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_one_outsider_in_a_large_bucket_visits_and_the_rest_stays(spark):
    """A bucket of 3,000 linked sets and one outsider: only the outsider is copied to blocks."""
    rng = np.random.default_rng(1)
    bits = [[int(x) for x in rng.integers(-2 ** 62, 2 ** 62, 4)] for _ in range(3001)]
    keys = [list(range(12))] * 2
    rows = [(7, i % 3, guest, i > 0, 0 if i else 1, i, 200, 0, bits[i], *keys) for i in range(3001)
            for guest in ([False] if i else [False, True])]
    rows += [(7, b, True, False, 1, 0, 200, 0, bits[0], *keys) for b in (1, 2)]
    df = spark.createDataFrame(rows, "key long, block int, guest boolean, main boolean, comp long, node long, n long, "
                                     "place int, bits array<long>, a array<long>, b array<long>")
    assert minhash._across(df, 75).collect() == []  # random bitmaps lie far apart
    near = df.withColumn("bits", F.array(*[F.lit(0)] * 4).cast("array<long>"))
    got = {(r.u, r.v) for r in minhash._across(near, 75).collect()}
    assert got == {(0, i) for i in range(1, 3001)}


def test_links_of_long_texts_in_one_bucket(spark):
    """Sets of 5,000 shingles that share half are told apart by their bitmaps."""
    base = prose(41, 2600)
    rows = [(i, base + " " + prose(50 + i, 2600)) for i in range(12)]
    rows += [(100, rows[0][1] + " more words at the end"), (101, rows[5][1].replace("the", "a", 3))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    x = [minhash.Shingler(5).shingles(t) for _, t in rows[:12]]
    assert all(bits_apart(parity_bits(x[0], 1.0), parity_bits(y, 1.0)) > apart_at_most(len(x[0]), len(y), 75) for y in x[1:])


@pytest.mark.parametrize("n", [60, 200, 300, 500, 900, 3000, 20_000])
def test_bitmaps_exclude_sets_that_share_little(n):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 2 ** 63, k).astype(np.uint64)
    for share in (0, .3, .5):
        common = draw(int(n * share))
        a, b = (np.unique(np.concatenate([common, draw(n - len(common))])) for _ in "ab")
        assert bits_apart(parity_bits(a, 1.0), parity_bits(b, 1.0)) > apart_at_most(len(a), len(b), 75)


def test_recall_near_the_limit(spark):
    """Pairs of similarity 0.75 to 0.80, each alone: found and missed links counted."""
    rng = random.Random(77)
    rows, linked = [], 0
    for k in range(400):
        words = prose(1000 + k, 160).split()
        other = list(words)
        for i in rng.sample(range(160), 4):
            other[i] += "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = brute_pairs(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[b] == a for a, b in want)
    assert len(want) > 100 and found >= 0.995 * len(want)
    assert all(got[b] == b for a, b in zip(range(0, 800, 2), range(1, 800, 2)) if (a, b) not in want)


def brute_pairs(rows):
    s = {i: sets(t) for i, t in rows}
    return {(a, a + 1) for a in range(0, len(rows), 2)
            if 100 * (n := len(s[a] & s[a + 1])) >= 75 * (len(s[a]) + len(s[a + 1]) - n)}


def test_shingler_matches_plain_sets():
    np.seterr(over="ignore")
    s = minhash.Shingler(5)
    for t in ["", None, "a", "A b C d e f", "x y z a b c d", "é É\x0bq\x0cr\x1cs t u v", prose(3, 500)]:
        assert len(s.shingles(t)) == len(sets(t))
    assert (s.shingles("The Cat sat on a mat") == s.shingles("the cat SAT  on\na mat")).all()
    assert len(s.shingles("a b c d e")) == 1 and s.shingles("a b c")[0] != s.shingles("ab c")[0]


@pytest.mark.parametrize("links,want", [([], {}), ([(5, 5)], {5: 5}),
                                        ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
                                        ([(9, 3), (3, 7), (8, 2), (2, 8)], {9: 3, 3: 3, 7: 3, 8: 2, 2: 2})])
def test_connected_components(spark, links, want):
    df = spark.createDataFrame(links, "u long, v long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == want


def test_components_are_written_once(spark, monkeypatch):
    from greenscan.llm import components as module
    names, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    links = write(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), "given")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {i: 0 for i in range(41)}
    # the hooks, their ends after 3, 9, 27 and 81 steps, and the links that are left (none); not the links given
    assert names == ["hooks"] * 5 + ["links"]


def test_near_duplicates_write_no_table_twice(spark, monkeypatch):
    names, write = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: names.append(name) or write(df, name))
    base = prose(21, 80)
    rows = [(i, base + " end" * (i % 3)) for i in range(9)] + [(20, prose(22, 80))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 for i in range(9)} | {20: 20}
    assert "components" not in names and names.count("sketches") == 1
