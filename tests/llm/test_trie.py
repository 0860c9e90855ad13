"""op13: nodes of the burst trie against a plain prefix table, with small containers."""
import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from greenscan.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """``rows``: (conv_id, turn, role, text), no equal turn numbers with different content."""
    told = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            told[c].append((t is not None, t or 0, r or "", x or ""))
    told = {c: [v[2:] for v in sorted(vs)] for c, vs in told.items()}
    member, ends = defaultdict(list), defaultdict(list)
    for c, own in told.items():
        h = crc32(str(c).encode()) % 9
        seq = tuple(told.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            member[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for k in member:
        if k:
            children[k[:-1]].append(k)
    total = {}
    for k in sorted(member, key=len, reverse=True):
        own = (len(member[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        total[k] = (sum(total[c][0] for c in children[k]) or 1, own + sum(total[c][1] for c in children[k]))
    return sorted([(min(m), len(k), min(member[k[:-1]]) if k else None, len(m), len(children[k]), *total[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in member.items()], key=str)


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == cols
    return sorted([tuple(r) for r in df.collect()], key=str)


def talk(seed, n, words=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"é{rng.randrange(words)}" * rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 2048])
def test_nodes_match_a_prefix_table(spark, limit):
    rows = talk(1, 150) + [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(5)] \
        + [(c, t, "user", "same" if t < 6 else str(c)) for c in range(3000, 3040) for t in range(8)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    assert got(trie.conversation_trie(df, limit=limit)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, "user", "first"), (5, 1, None, "a"), (5, 2, "user", None), (6, 0, "", "first"), (7, 3, "user", ""),
            (None, 0, "user", "lost"), (None, None, None, None), (11, 0, "user", "no base"), (23, 0, "system", "x" * 300_000),
            (-7, 0, "user", "below"), (-5, 0, "user", "zero"), (20, 1, "user", "twice"), (20, 1, "user", "twice")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", seq string, head int")
    assert got(trie.conversation_trie(df, limit=2)) == brute(rows)
    assert trie.conversation_trie(df.limit(0)).count() == 0
    assert trie.conversation_trie(df.where("conv_id is null")).count() == 0


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 500) if c % 5 and crc32(str(c).encode()) % 9 >= 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    out = got(trie.conversation_trie(spark.createDataFrame(rows, TURNS)))
    assert out == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "", "abc")]
    assert len(got(trie.conversation_trie(spark.createDataFrame(rows, TURNS)))) == 4


def test_digests_of_groups_cut_by_tasks(spark, monkeypatch):
    keys = [bytes([k]) * 16 for k in range(5)]
    rows = [(bytearray(keys[min(4, i % 9)]), i) for i in range(5000)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    monkeypatch.setattr(trie, "PIECE", 512)
    try:
        out = trie.id_digests(spark.createDataFrame(rows, "key binary, conv_id long").repartition(4))
        have = {bytes(r["key"]): r["digest"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {k: hashlib.sha256(",".join(str(i) for i in range(5000) if min(4, i % 9) == j).encode()).hexdigest()
            for j, k in enumerate(keys)}
    assert have == want
