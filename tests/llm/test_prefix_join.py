"""op11: components against brute force; groups, hot lists, blocks, odd rows, bitmaps."""
import random

import numpy as np
import pytest

from greenscan.llm import prefix_join as P
from greenscan.llm.bitmaps import bits_apart

from llm_texts import prose


def shingles(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, percent=90):
    """Of each row (id, text): (id, set size, smallest id reachable), by all pairs of sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    up = list(range(len(distinct)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if abs(len(a) - len(b)) * 5 <= len(a):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    up[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(distinct)}
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[at[s]] = min(i, least.get(at[s], i))
    return sorted([(i, len(s), least.get(at[s]) if s else i) for (i, _), s in zip(rows, sets)], key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def edited(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


def near_copies(seed):
    rng = random.Random(seed)
    base = prose(11, 150).split()
    rows = [(i, edited(rng, base, rng.choice([0, .003, .01, .02, .04]))) for i in range(160)]
    rows += [(1000 + i, prose(500 + i, 40)) for i in range(60)]
    rows += [(2000 + i, prose(500 + i, 40) + (" tail words" if i % 2 else "")) for i in range(60)]
    rows += [(3000 + i, "  ".join(base).upper()) for i in range(50)]
    # a passage that many share, before a few words of their own
    rows += [(5000 + i, " ".join(base[:60]) + " " + prose(900 + i, rng.randint(3, 30))) for i in range(80)]
    # links at the very limit: sets of 100 shingles, one side longer by k
    for k in range(8, 14):
        line = [f"t{k}w{i}" for i in range(102)]
        rows += [(6000 + k, " ".join(line)), (6100 + k, " ".join(line + [f"t{k}z{i}" for i in range(k)]))]
    return rows


@pytest.mark.parametrize("block,hot", [(1024, 1 << 16), (16, 20)])
def test_components_match_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "SPLITS", 5)
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # few counters: noise in the order must not change the result
    assert got(P.similar_documents(df, P.JoinParams(slots=1 << (20 if hot > 20 else 12)))) == brute(rows)


def test_a_list_of_near_copies_that_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 32)
    rng = random.Random(5)
    base = prose(12, 200).split()
    rows = [(i, edited(rng, base, .03)) for i in range(150)]
    # a chain: each differs from the next in one word, far ends do not link
    chain = prose(13, 120).split()
    for i in range(30):
        chain = [*chain[:i * 4], f"new{i}", *chain[i * 4 + 1:]]
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(P.similar_documents(df)) == brute(rows)


def test_other_limits(spark):
    rows = near_copies(8)[:230]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(P.similar_documents(df, P.JoinParams(percent=80))) == brute(rows, 80)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = [r[:2] for r in odd_rows]
    assert got(P.similar_documents(odd_docs)) == brute(rows)
    assert got(P.similar_documents(no_docs)) == []
    # ids that repeat with other texts, a null id between two others, no id at all
    base = prose(21, 100)
    more = [(7, base), (7, prose(22, 50)), (9, base + " a"), (None, base + " b"), (3, base + " b c"), (None, prose(23, 30)),
            (None, prose(23, 30)), (8, prose(22, 50)), *[(4, "the same row") for _ in range(30)]]
    assert got(P.similar_documents(spark.createDataFrame(more, "doc_id long, text string"))) == brute(more)


def test_long_texts_that_share_half(spark):
    a, b = prose(31, 6000), prose(32, 6000)
    rows = [(1, a + " " + b), (2, a + " " + prose(33, 6000)), (3, a + " " + b + " end"), (4, prose(34, 6000) + " " + b)]
    assert got(P.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, d, e = int(rng.integers(1, 6000)), int(rng.integers(0, 60)), int(rng.integers(0, 600))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[d:], rng.integers(0, 2 ** 63, e).astype(np.uint64)]))
        if not len(b):
            continue
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        x, y = P.parity_bits(a), P.parity_bits(b)
        assert len(x) * 64 >= max(256, len(a) / 2) and bits_apart(x, y) <= apart
        maps = P.Bitmaps([y, x])
        assert list(maps.near(x, np.array([True, False]), np.array([bits_apart(x, y), -1]))) == [0]
        assert bits_apart(x, y) == 0 or not len(maps.near(x, np.array([True, False]), np.array([bits_apart(x, y) - 1, -1])))


def test_prefixes_of_linked_sets_meet():
    for n1 in range(1, 60):
        for n2 in range(n1, 60):
            for percent in (75, 90, 100):
                need = P.needed(n1, n2, percent)
                if need <= n1:
                    assert need * (100 + percent) >= percent * (n1 + n2) > (need - 1) * (100 + percent)
                    # without a common prefix element, what is left of one set is too small
                    assert min(n1 - P.prefix_length(n1, percent), n2 - P.prefix_length(n2, percent)) < need
