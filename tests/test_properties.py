"""Golden corpus totals (FIXTURES) and property tests."""
import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import greenlist as gl
from greenscan.functions.stats import erfc_sql
from greenscan.operators.detect import detect_text
from greenscan.sources.tables import read_table

from conftest import SF01


def test_corpus_totals_sf001(spark):
    """FIXTURES section 3: sf0.01 all bigrams T=496,333 g=129,286; distinct T=417,291,
    g=103,669 (head) and 103,638 (tail)."""
    docs = read_table(spark, SF01, "documents").select("doc_id", "text")
    cases = [(WorkCfg(False, True), 496333, 129286), (WorkCfg(True, True), 417291, 103669),
             (WorkCfg(True, False), 417291, 103638)]
    for cfg, t, g in cases:
        r = detect_text(docs, cfg, "text").agg(F.sum("num_tokens_scored").alias("t"),
                                                F.sum("num_green_tokens").alias("g")).first()
        assert (r.t, r.g) == (t, g)


def WorkCfg(distinct, head):
    return WatermarkConfig(ignore_repeated_bigrams=distinct, select_green_tokens=head)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-8.0, max_value=30.0, allow_nan=False), min_size=1, max_size=20))
def test_erfc_property(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", F.expr(erfc_sql("x")).alias("e")).collect():
        exp = math.erfc(r.x)
        assert r.e == exp or abs(r.e - exp) <= 1e-12 * abs(exp) + 1e-300


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=100), st.sampled_from([0.1, 0.25, 0.5, 0.9]), st.booleans())
def test_greenlist_size_property(spark, p, gamma, head):
    cfg = WatermarkConfig(vocab_size=101, gamma=gamma, select_green_tokens=head)
    r = spark.range(101).select(gl.is_green(F.lit(p).cast("bigint"), F.col("id"), cfg).cast("int").alias("g")) \
        .agg(F.sum("g")).first()[0]
    assert r == int(101 * gamma)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "the", "x"]), min_size=0, max_size=30))
def test_detection_counts_property(spark, words):
    text = " ".join(words)
    df = spark.createDataFrame([("x", text)], "id string, text string")
    std = detect_text(df, WatermarkConfig(), "text").first()
    dis = detect_text(df, WatermarkConfig(ignore_repeated_bigrams=True), "text").first()
    n = len(words)
    if len(text) < 3:
        assert std.status == "too_short"
    elif n < 2:
        assert std.status == "too_few_tokens"
    else:
        assert std.num_tokens_scored == n - 1
        assert dis.num_tokens_scored == len(set(zip(words, words[1:])))
        assert 0 <= dis.num_green_tokens <= dis.num_tokens_scored
