"""Detection with tokens hashed once a block, and normalisers that skip ASCII."""
import pytest
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions import normalize as nz
from greenscan.operators import lookup
from greenscan.operators.detect import detect_text
from greenscan.plans import queries as q

TEXTS = ["One cat sat. The dog saw two cats, and the dog ran.", None, "", "x", "ab", "one two", "é Ж 漢字 😀 a a a a a", " \n ", "the the the the the"]


@pytest.mark.parametrize("cfg", [WatermarkConfig(), WatermarkConfig(ignore_repeated_bigrams=True), WatermarkConfig(lowercase=False, vocab_size=101),
                                 WatermarkConfig(select_green_tokens=False)])
@pytest.mark.parametrize("size", [3, 1 << 21])
def test_batches_score_as_columns_do(spark, monkeypatch, cfg, size):
    monkeypatch.setattr(lookup, "BLOCK", size)
    df = spark.createDataFrame([(i % 4 or None, t) for i, t in enumerate(TEXTS * 2)], "id long, text string").coalesce(2)
    kw = {} if cfg.ignore_repeated_bigrams else {"return_mask": True}
    one, two = (detect_text(df, cfg, "text", normalized_col="t", in_batches=b, **kw) for b in (False, True))
    assert one.dtypes == two.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_no_token_is_hashed_by_itself(spark):
    plan = q.detect_normalized(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan


def test_rulesets_find_their_characters(spark):
    chars = [chr(c) for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xF900, 0x10000)] + ["😀"]
    df = spark.createDataFrame([(f"a {c} {c}{c}b",) for c in chars], "t string")
    for name in ("whitespaces", "idn", "ascii"):
        was = F.regexp_replace("t", nz.RULESETS[name], " ")
        assert df.where(was != nz.ruleset_to_space(F.col("t"), name)).count() == 0
    was = F.regexp_replace("t", " +", " ")
    assert df.where(was != nz.collapse_spaces(F.col("t"))).count() == 0
