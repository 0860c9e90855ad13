from pyspark.sql import functions as F

from greenscan.operators import report as rp

from conftest import SF001


def test_display_golden(spark):
    df = spark.createDataFrame([("a", 200, 90, 0.45, 6.531972647421808, 3.245450607900594e-11, True,
                                 1 - 3.245450607900594e-11, "ok")],
                               "id string, num_tokens_scored long, num_green_tokens long, green_fraction double, "
                               "z_score double, p_value double, prediction boolean, confidence double, status string")
    rows = [(r.metric, r.value) for r in rp.display_rows(df, "id", 4.0).orderBy("ord").collect()]
    assert rows == [("Tokens Counted (T)", "200"), ("# Tokens in Greenlist", "90"),
                    ("Fraction of T in Greenlist", "45.0%"), ("z-score", "6.53"), ("p value", "3.25e-11"),
                    ("z-score Threshold", "4.0"), ("Prediction", "Watermarked"), ("Confidence", "100.000%")]


def test_display_negative_and_error(spark):
    schema = ("id string, num_tokens_scored long, num_green_tokens long, green_fraction double, "
              "z_score double, p_value double, prediction boolean, confidence double, status string")
    df = spark.createDataFrame([("n", 200, 50, 0.25, 0.0, 0.5, False, None, "ok"),
                                ("e", None, None, None, None, None, None, None, "too_short")], schema)
    out = rp.display_rows(df, "id", 4.0)
    neg = [(r.metric, r.value) for r in out.where("id = 'n'").orderBy("ord").collect()]
    assert neg[-2:] == [("z-score Threshold", "4.0"), ("Prediction", "Human/Unwatermarked")]
    assert ("z-score", "0") in neg and ("p value", "0.5") in neg
    err = [(r.metric, r.value) for r in out.where("id = 'e'").orderBy("ord").collect()]
    assert err == [("Error", "string too short to compute metrics")] + [("", "")] * 6


def test_percent_rounds_like_python(spark):
    vals = [0.3125, 0.45, 5 / 16, 1 / 3, 0.00005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(rp.fmt_pct(F.col("x"), 1).alias("s")).collect()]
    assert got == [f"{v:.1%}" for v in vals]


def test_g3_like_python(spark):
    vals = [6.531972647421808, 0.5, 0.0, 10.0, 3.245450607900594e-11, 1234.5, -0.577, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(rp.fmt_g3(F.col("x")).alias("s")).collect()]
    assert got == [f"{v:.3g}" for v in vals]


def test_histogram_and_corr(spark):
    df = spark.createDataFrame([("g", float(i), float(2 * i)) for i in range(10)], "grp string, x double, y double")
    h = rp.histograms(df, "grp", ["x", "y"], bins=5)
    assert h.where("metric = 'x'").agg(F.sum("n")).first()[0] == 10
    assert sorted(r.n for r in h.where("metric = 'x'").collect()) == [2, 2, 2, 2, 2]
    c = rp.pair_corr(df, "grp", ["x", "y"]).first()
    assert abs(c.corr - 1.0) < 1e-12 and c.n == 10


def test_category_codes(spark):
    from greenscan.sources.tables import read_table
    d = read_table(spark, SF001, "documents")
    out = rp.category_codes(d, ["lang"], ["doc_id"])
    codes = {r.lang: r.lang_code for r in out.select("lang", "lang_code").distinct().collect()}
    assert [codes[k] for k in sorted(codes)] == list(range(len(codes)))


def test_three_digits_round_the_exact_value(spark):
    xs = [2.125, 1.005, 8.575, 9.996, 9.9949, 0.0001, 9.9996e-5, 9.99e-5, 0.00123456, 123456.0, 999.4, 999.5,
          100.0, 0.5, -2.125, 0.0, 12.25, 0.1235, 1e-123, 54.35, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.s for r in df.select(rp.fmt_g3(F.col("x")).alias("s")).collect()]
    assert got == [None if x is None else f"{x:.3g}" for x in xs]


def test_pair_bins_broadcasts_the_ranges(spark):
    """The ranges, one row per group, never send the rows of a group to one task."""
    df = spark.createDataFrame([("W", 1.0, 2.0), ("WO", 2.0, 3.0), (None, 0.0, 1.0)], "arm string, a double, b double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = rp.pair_bins(df, "arm", ["a", "b"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sum(r.n for r in out.collect()) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
