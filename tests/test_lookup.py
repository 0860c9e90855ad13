"""Arrays through a table, block by block."""
import re

import pytest
from pyspark.sql import functions as F

from greenscan.operators import lookup
from greenscan.operators import truecase as tc
from greenscan.operators import vocab as vb

LISTS = [["a", "b", "a", "c"], None, [], ["zz", None, "a"], ["c"] * 50, ["é😀", ""], ["d", "e", "f", "a"], [None], []]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(df):
    """The inputs of all exchanges of the plan, as it is before it runs."""
    qe = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", qe.explainString(mode))


def test_arrays_are_not_shuffled_as_they_stand(spark, no_broadcast):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LISTS)], "id long, tokens array<string>")
    vocab = vb.vocab_build(df.select(F.explode("tokens").alias("token")).where("token <> 'zz'"), reserved=2)
    enc = vb.encode_lists(df, vocab, unk_id=0, reserved=2, row="id")
    assert shuffled(enc) and not [x for x in shuffled(enc) if "tokens#" in x]
    back = vb.decode_lists(enc.select("id", "ids"), vocab, out_col="back", reserved=2, row="id")
    assert shuffled(back) and not [x for x in shuffled(back) if "ids#" in x]
    want = {i: None if x is None else [t if t not in ("zz", None) else "<unk>" for t in x] for i, x in enumerate(LISTS)}
    assert {r.id: r.back for r in back.collect()} == want


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_blocks_hold_every_row_and_each_element_once(spark, monkeypatch, size):
    monkeypatch.setattr(lookup, "BLOCK", size)
    df = spark.createDataFrame([(None if i % 2 else i, x, "more") for i, x in enumerate(LISTS * 3)],
                               "id long, l array<string>, x string").coalesce(1)
    store = lookup.Blocks.of(df, "l")
    assert store.rows().dtypes == df.dtypes
    key = lambda x: str(x)
    assert sorted(map(tuple, store.rows().collect()), key=key) == sorted(map(tuple, df.collect()), key=key)
    keys = [(r.block, r.key) for r in store.keys().collect()]
    assert len(keys) == len(set(keys)) and all(k is not None for _, k in keys)
    n_blocks = store.pack.count()
    assert n_blocks == 1 if size == 1 << 20 else n_blocks > 5
    assert len(keys) <= 9 * n_blocks


def test_numbers_of_many_elements_take_more_bytes(spark, monkeypatch):
    n = 70_000
    df = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: x.cast("long") * (F.col("id") + 1)).alias("l"))
    table = spark.range(0, 3 * n + 1, 2).select("id", F.concat(F.lit("v"), "id").alias("v"))
    out = lookup.replaced(df.coalesce(1), "l", "o", table, "id", "v", default="none")
    for r in out.collect():
        assert r.l == [x * (r.id + 1) for x in range(n + 1)]
        assert r.o == [f"v{x}" if x % 2 == 0 else "none" for x in r.l]


def test_written_tables_let_shuffle_files_go(spark):
    from greenscan.session import kept
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans)
    before = collected()
    assert kept(spark.range(10).groupBy("id").count(), "counts").count() == 10
    assert collected() > before


TEXTS = ["One cat sat. THE dog! saw", None, "", " \n", "?a b", "... x. y", "a", ".", "İstanbul ist. ΣΑΣ straße", "one.two\n three.  \nfour", "  lead and. Follow"]


def plain_truecase(text, forms):
    """Word by word, as the rule reads."""
    if text is None:
        return None
    segs = re.findall(r"[^\W_]+|(?:[\W_])+", text.lower())
    out = []
    for i, s in enumerate(segs):
        word = s[0].isalnum()
        start = i == 0 or i == 1 and not segs[0][0].isalnum() or re.search(r"[.!?]\s*$", segs[i - 1])
        s = forms.get(s, s) if word else s
        out.append(s[:1].upper() + s[1:] if word and start else s)
    return "".join(out)


@pytest.mark.parametrize("size", [2, 5, 1 << 21])
def test_truecasing_by_blocks(spark, monkeypatch, no_broadcast, size):
    monkeypatch.setattr(lookup, "BLOCK", size)
    texts = [t for t in TEXTS if t is None or "İ" not in t]
    df = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    model = spark.createDataFrame([("cat", "Cat", 1, 1), ("y", "Y", 1, 1), ("two", "tWo", 1, 1)], "key string, form string, n_form long, n_total long")
    out = tc.truecase_apply(df, model, "id", "text")
    assert shuffled(out) and not [x for x in shuffled(out) if re.search("text#|_segs#", x)]
    forms = {"cat": "Cat", "y": "Y", "two": "tWo"}
    assert sorted(map(str, [tuple(r) for r in out.collect()])) == sorted(
        str((i % 3 or None, plain_truecase(t, forms))) for i, t in enumerate(texts))


@pytest.mark.parametrize("size", [1, 4, 1 << 21])
def test_casing_is_counted_away_from_sentence_starts(spark, monkeypatch, size):
    monkeypatch.setattr(lookup, "BLOCK", size)
    df = spark.createDataFrame([(t,) for t in ["A cat. A Cat! The cat and a Cat, a CAT", "cat", None, "", "x Cat 1a é", ". b"]], "text string")
    got = {r.key: (r.form, r.n_form, r.n_total) for r in tc.truecase_model(df.coalesce(2), "text").collect()}
    assert got == {"cat": ("Cat", 3, 6), "and": ("and", 1, 1), "a": ("a", 2, 2), "é": ("é", 1, 1)}
