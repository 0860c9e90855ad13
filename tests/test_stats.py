import math

import pytest
from pyspark.sql import functions as F

from greenscan.functions.stats import erfc_sql, with_normal_sf, z_score

# (T, g, gamma, green_fraction, z, p, prediction) from FIXTURES.md section 3
GOLDEN = [
    (200, 90, 0.25, 0.45, 6.531972647421808, 3.245450607900594e-11, True),
    (200, 50, 0.25, 0.25, 0.0, 0.5, False),
    (1, 1, 0.25, 1.0, 1.7320508075688774, 0.04163225833177522, False),
    (1, 0, 0.25, 0.0, -0.5773502691896258, 0.7181485691746134, False),
    (16, 16, 0.25, 1.0, 6.92820323027551, 2.131095798921832e-12, True),
    (48, 16, 0.25, 0.3333333333333333, 1.3333333333333333, 0.0912112197258679, False),
    (100, 100, 0.5, 1.0, 10.0, 7.619853024160593e-24, True),
]
SF_ONLY = [(-3.0, 0.9986501019683699), (1.96, 0.024997895148220435), (4.0, 3.1671241833119965e-05),
           (8.0, 6.220960574271819e-16), (23.57, 3.9149837662413604e-123)]


def test_golden_z_and_p(spark):
    for T, g, gamma, frac, z, p, pred in GOLDEN:
        df = spark.createDataFrame([(T, g)], "t long, g long")
        df = df.withColumn("z", z_score(F.col("g"), F.col("t"), gamma))
        row = with_normal_sf(df, "z", "p").withColumn("pred", F.col("z") > F.lit(4.0)).first()
        assert row.z == pytest.approx(z, rel=1e-12, abs=1e-15)
        assert row.p == pytest.approx(p, rel=1e-9)
        assert row.pred == pred
        assert g / T == pytest.approx(frac)


def test_survival_tail(spark):
    df = spark.createDataFrame([(z,) for z, _ in SF_ONLY], "z double")
    got = {r.z: r.p for r in with_normal_sf(df, "z", "p").collect()}
    for z, p in SF_ONLY:
        assert got[z] == pytest.approx(p, rel=1e-9)


def test_erfc_against_python(spark):
    xs = [i / 7.0 for i in range(-40, 120)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", F.expr(erfc_sql("x")).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12, abs=1e-300)


def test_threshold_is_strict(spark):
    # T=16, g=16 at gamma .25 gives z = 6.928...; a threshold equal to z must say False
    from greenscan.config import WatermarkConfig
    from greenscan.operators.detect import detect_ids
    ids = list(range(17))
    df = spark.createDataFrame([("a", ids)], "id string, ids array<bigint>")
    cfg = WatermarkConfig()
    z = detect_ids(df, cfg, "ids").first().z_score
    out = detect_ids(df, cfg, "ids", threshold=F.lit(z)).first()
    assert out.prediction is False and out.confidence is None
    out2 = detect_ids(df, cfg, "ids", threshold=F.lit(None).cast("double")).first()
    assert out2.prediction == (z > 4.0)  # null threshold means the default (Q5)
