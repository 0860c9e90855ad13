import numpy as np
import pytest
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig, is_prime, next_prime
from greenscan.functions import greenlist as gl
from greenscan.operators import bigrams as bg
from greenscan.operators.generate import green_py


@pytest.mark.parametrize("head", [True, False])
def test_greenlist_size_exact(spark, head):
    cfg = WatermarkConfig(select_green_tokens=head)
    keys = [0, 1, 2, 77, 31999, 32002]
    toks = spark.range(cfg.vocab_size).withColumnRenamed("id", "tok")
    for p in keys:
        df = toks.select(gl.rank(F.lit(p).cast("bigint"), F.col("tok"), cfg).alias("r"),
                         gl.is_green(F.lit(p).cast("bigint"), F.col("tok"), cfg).alias("g"))
        agg = df.agg(F.countDistinct("r").alias("nr"), F.sum(F.col("g").cast("int")).alias("ng")).first()
        assert agg.nr == cfg.vocab_size  # a permutation
        assert agg.ng == cfg.n_green == 8000


def test_python_and_spark_agree(spark):
    cfg = WatermarkConfig()
    rows = [(p, c) for p in (3, 999, 20001) for c in range(0, 32003, 997)]
    df = spark.createDataFrame(rows, "p long, c long")
    got = {(r.p, r.c): r.g for r in df.select("p", "c", gl.is_green(F.col("p"), F.col("c"), cfg).alias("g")).collect()}
    for p in (3, 999, 20001):
        cs = np.array([c for (pp, c) in rows if pp == p])
        exp = green_py(p, cs, cfg)
        assert [got[(p, int(c))] for c in cs] == list(exp)


def test_explicit_table_matches_closed_form(spark):
    cfg = WatermarkConfig(vocab_size=101, gamma=0.25)
    prevs = spark.createDataFrame([(p,) for p in range(0, 101, 7)], "prev long")
    table = bg.explicit_greenlist(prevs, cfg)
    per_key = table.groupBy("prev").count().collect()
    assert all(r["count"] == cfg.n_green for r in per_key) and len(per_key) == 15
    pairs = prevs.select("prev", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(100).cast("bigint")))
                         .alias("tok"))
    marked = bg.green_by_table(pairs, table)
    bad = marked.where(F.col("is_green") != gl.is_green(F.col("prev"), F.col("tok"), cfg)).count()
    assert bad == 0


def test_config_validation():
    assert is_prime(32003) and next_prime(32004) == 32009
    with pytest.raises(ValueError):
        WatermarkConfig(vocab_size=32004)
    with pytest.raises(NotImplementedError):
        WatermarkConfig(seeding_scheme="other")
    with pytest.raises(ValueError):
        WatermarkConfig(normalizers="unicode,nope")
    assert WatermarkConfig(normalizers="unicode,homoglyphs").normalizers == ("unicode", "homoglyphs")
    assert WatermarkConfig(gamma=0.25).n_green == 8000
