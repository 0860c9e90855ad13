"""op7, op8, op9, op10: native plans, brute force, held-out accuracy, odd rows."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenscan.llm import quality, sharding, topk, toxicity
from greenscan.llm.queries import ORACLE, QUERIES

from llm_texts import prose

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    wins = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(odd_docs, odd_rows, no_docs):
    got = quality.quality_report(odd_docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                   for r in got), key=key) == sorted(((i, *counts(t)) for i, t, *_ in odd_rows), key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert not next(r for r in got if r["doc_id"] == 17)["kept"]
    good = quality.keep_good(odd_docs)
    assert good.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in good.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.quality_report(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_quality_keeps_labelled_good_documents(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(label[r["doc_id"]], r["kept"]) for r in quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
           if r["doc_id"] in label and not r["base_failed"]]
    assert np.mean([k for q, k in got if q == 1]) > 0.99 and np.mean([k for q, k in got if q == 0]) < 0.1


def test_native_plans_hold_no_python(spark):
    for name in ("op7_distribution_divergence", "op9_jump_sharding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    ids = spark.range(-200, 3000).withColumn("s", sharding.jump_shards(F.col("id"), 40)).collect()
    for r in ids:
        key = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:16], 16)
        assert (r["s"]["shard"], r["s"]["grown"]) == (jump(key, 40), jump(key, 41))
        assert r["s"]["grown"] in (r["s"]["shard"], 40)
    moved = sum(r["s"]["grown"] == 40 for r in ids)
    assert 40 < moved < 130  # a forty-first of 3,200


@pytest.mark.parametrize("n", [1, 2, 7])
def test_shards_and_slots(odd_docs, odd_rows, no_docs, n):
    got = sharding.assign_shards(odd_docs, n).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < n and r["law"] == "key"
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(no_docs, n).count() == 0


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, 3, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd_docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def brute_topk(vectors, k):
    out = {}
    for i, v in vectors.items():
        if i % 20 == 0:
            s = sorted(((-int(np.dot(v, w)), j) for j, w in vectors.items() if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -x) for x, j in s]
    return {i: s for i, s in out.items() if s}


@pytest.mark.parametrize("shards,rows", [(1, 4), (5, 3), (3, 1000)])
def test_topk_matches_brute_force(spark, shards, rows):
    rng = np.random.default_rng(shards)
    data = [(i, [float(x) for x in rng.normal(0, .3, 8).round(1)]) for i in range(300)]  # many ties
    data += [(300 + i, data[0][1]) for i in range(60)]
    data += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, []), (481, []),
             (None, data[1][1]), (500, [2.0 ** 20] * 8), (501, [-2.0 ** 20] * 8), (520, [0.5, 0.5]), (540, [3.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got, want = answers(topk.integer_vectors(df), shards, rows), brute_topk(integers(data), 20)
    assert got == want  # all ranks of all queries


def integers(data):
    return {i: np.floor(64 * np.array(x)).astype(np.int64) for i, x in data if i is not None and x is not None
            and all(e is not None and np.isfinite(e) for e in x)}


def answers(v, shards=None, rows=256):
    got = collections.defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 20, shards, block_rows=rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(got)


@pytest.mark.parametrize("size", [2.0 ** 18, 2.0 ** 23, 2.0 ** 24])
def test_topk_of_large_components_is_exact(spark, size):
    """Products beyond 2^53, and sums that only integers of any size can bound."""
    rng = np.random.default_rng(int(np.log2(size)))
    data = [(i, [float(x) for x in rng.uniform(-1, 1, 2) * size]) for i in range(120)]
    whole = {i: [int(np.floor(64 * e)) for e in x] for i, x in data}
    want = {}
    for q in range(0, 120, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:20]
        want[q] = [(i, -x) for x, i in scored]
    assert answers(topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), 3) == want


def test_topk_beyond_64_bits_raises(spark):
    rows = [(0, [2.0 ** 27] * 4), (1, [2.0 ** 27] * 4)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(v, v).collect()
    huge = spark.createDataFrame([(0, [1e18] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.integer_vectors(huge).collect()


def test_topk_empty(spark):
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_tree_bounds_and_search():
    rng = np.random.default_rng(9)
    x = rng.integers(-30, 30, (2000, 12))
    tree = topk.build_tree(x.astype(float))
    assert sorted(tree.order.tolist()) == list(range(2000))
    q = rng.integers(-30, 30, 12)
    for leaf, node in enumerate(tree.leaf_node):
        rows = tree.order[tree.first[leaf]:tree.last[leaf]]
        assert (x[rows] @ q).max() <= tree.centre[node] @ q + tree.radius[node] * np.linalg.norm(q) + 1e-6
    _, ids, score = topk.search(tree, x, np.arange(2000), q[None, :], np.array([5]), 20, np.array([-np.inf]))
    want = sorted((-s, i) for i, s in enumerate((x @ q).tolist()) if i != 5)[:20]
    assert sorted(zip((-score).tolist(), ids.tolist())) == want


INSULTS = ["zorkwit", "blemmard", "gruntface", "snivelton"]


def insulted(seed, n):
    words = prose(seed, n).split(" ")
    for k in range(4):
        words.insert(7 * k + 3, INSULTS[(seed + k) % 4])
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, insulted(i, 80) if i % 4 == 0 else prose(i, 80), int(i % 4 == 0)) for i in range(600)]
    return (spark.createDataFrame([(i, t, "x", .5) for i, t, _ in rows], "doc_id long, text string, k string, score double"),
            spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int"),
            {i: y for i, _, y in rows})


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= .5)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_toxicity_odd_rows(spark, labelled, odd_docs, odd_rows, no_docs):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    scored = toxicity.score(odd_docs, model)
    assert sorted(scored.columns) == sorted(odd_docs.columns) and scored.count() == len(odd_rows)
    kept = toxicity.keep_civil(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)  # none is toxic
    assert toxicity.keep_civil(docs, model).where("doc_id % 4 = 0").count() <= 3
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert none.toxic == b"" and toxicity.score(docs, none).where("score <> 0").count() == 0
    only = toxicity.train(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs, only).where("score <> 1").count() == 0
    hidden = insulted(1, 20_000).replace("\n", " ")
    long = spark.createDataFrame([(1, "y" * 100_000), (2, hidden), (3, "")], "doc_id long, text string")
    assert toxicity.score(long, model).count() == 3


def test_toxicity_learns_a_wide_vocabulary():
    """300 toxic words, each in about 1.3% of the toxic texts (under ``min_share``)."""
    rng = np.random.default_rng(7)
    insults = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(300)]

    def text(i):
        words = prose(i, 60).split(" ")
        return " ".join(words[:30] + [insults[k] for k in rng.integers(0, 300, 4)] + words[30:]) if i % 3 == 0 else " ".join(words)

    texts = [text(i) for i in range(3000)]
    labels = [int(i % 3 == 0) for i in range(3000)]
    model = toxicity.fit(texts[:2400], labels[:2400], 1 / 3, toxicity.ToxicityParams())
    found = sum(w.encode() in model.toxic for w in insults)
    x = toxicity._features(toxicity.Gaps(model).counts(texts[2400:]))
    right = np.mean((x @ model.weights >= 0) == (np.array(labels[2400:]) == 1))
    assert found >= 295 and right > 0.97


def test_toxicity_without_a_contrast_scores_the_share():
    with pytest.warns(UserWarning, match="0.3"):
        model = toxicity.fit([prose(1, 80)] * 200, [0, 1] * 100, .3, toxicity.ToxicityParams())
    assert model.toxic == b"" and model.prior == .3


def test_ordinary_dictionary_reads_whole_texts():
    """What ordinary texts hold only behind their first 2,000 bytes is in their dictionary."""
    late = "quixotrope zanziflor murkelwand"
    texts = [prose(i, 400) + (" " + " ".join([late] * 20) if i % 2 else " vilegrub") for i in range(300)]
    model = toxicity.fit(texts, [1 - i % 2 for i in range(300)], .5, toxicity.ToxicityParams())
    assert all(len(t) > 2000 for t in texts) and late.split()[0].encode() in model.ordinary


def test_labels_of_held_out_rows_are_not_read(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.toxic == b.toxic and (a.weights == b.weights).all()


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
