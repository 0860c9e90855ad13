"""op12: counts, gains, scores and ranks against a plain reading of the definition."""
import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from greenscan.llm import resample as R

from llm_texts import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    runs = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [crc32(r.encode("utf-8", "surrogatepass")) % 10000 for r in runs]


def brute(rows, target):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    ss, tt = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * float(ss)) / (float(s[b] + 1) * float(tt)))) for b in range(10000)]
    out = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * 5 // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
                  + [(*r, None) for r in out if r[1] < 20], key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=str)


def test_matches_the_definition(spark):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(300)] + [(1000 + i, prose(7, 50)) for i in range(40)]
    target = [prose(i, 60) for i in range(900, 910)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    assert got(R.resample(docs, goal)) == brute(rows, target)
    drawn = R.drawn_documents(docs, goal)
    want = {r[0] for r in brute(rows, target) if r[5]}
    assert {r["doc_id"] for r in drawn.collect()} == want and drawn.columns == ["doc_id", "text"]


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    goal = spark.createDataFrame([(prose(4, 40),), (None,), ("",)], "text string")
    assert got(R.resample(odd_docs, goal)) == brute([r[:2] for r in odd_rows], [prose(4, 40), None, ""])
    assert R.resample(no_docs, goal).count() == 0 and R.drawn_documents(no_docs, goal).count() == 0
    assert got(R.resample(odd_docs, goal.limit(0))) == brute([r[:2] for r in odd_rows], [])


def test_ties_go_to_the_smaller_id(spark):
    rows = [(5, "alpha beta " * 15)] * 60 + [(3, "alpha beta " * 15)] * 60
    out = R.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("alpha",)], "text string"))
    assert got(out) == brute(rows, ["alpha"])


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_steps_do_not_change_the_runs(monkeypatch, step):
    words = [w.encode() for w in prose(3, 50).split()]
    whole = sorted(c for part in R.run_crcs(words, 3) for c in part)
    monkeypatch.setattr(R, "STEP", step)
    assert sorted(c for part in R.run_crcs(words, 3) for c in part) == whole
    assert whole == sorted(crc32(b" ".join(words[i:i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert list(R.run_crcs([], 3)) == []


def test_table_is_the_pattern():
    for b in range(128):
        c = chr(b + 32) if 65 <= b <= 90 else chr(b)
        assert (R.TABLE[b] == 32) == (WORD.fullmatch(c) is None)
    assert R.TABLE[128:] == bytes(range(128, 256))
