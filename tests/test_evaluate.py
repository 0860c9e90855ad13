import pytest
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.functions.tokens import text_to_ids
from greenscan.operators import evaluate as ev
from greenscan.operators.detect import detect_ids
from greenscan.sources.tables import read_table

from conftest import SF001

CFG = WatermarkConfig()


def _doc_ids(spark):
    return read_table(spark, SF001, "documents").select(
        "doc_id", text_to_ids(F.col("text"), CFG.vocab_size).alias("ids"))


def test_paired_columns_and_long_form_agree(spark):
    d = _doc_ids(spark)
    cols = d.select(F.col("doc_id").cast("string").alias("id"), F.col("ids").alias("WO_ids"),
                    F.reverse("ids").alias("W_ids"), F.size("ids").alias("WO_num_output_token"),
                    F.size("ids").alias("W_num_output_token"))
    wide = ev.paired_from_columns(cols, CFG)
    assert wide.columns == ev.RESULT_COLUMNS
    long = ev.unpivot_arms(wide)
    again = ev.pair_long(long)
    assert wide.exceptAll(again).count() == 0


def test_resume_skips_string_ids(spark):
    todo = spark.createDataFrame([("1", "a b"), ("2", "c d"), ("10", "e f")], "id string, document string")
    done = spark.createDataFrame([(1,), (10,)], "id long")  # numeric ids on the done side (Q2)
    assert [r.id for r in ev.skip_done(todo, done).collect()] == ["2"]


def test_results_roundtrip(spark, tmp_path):
    path = str(tmp_path / "res")
    empty = ev.read_results(spark, path)
    assert empty.count() == 0 and empty.columns == ev.RESULT_COLUMNS
    d = _doc_ids(spark).limit(5)
    cols = d.select(F.col("doc_id").cast("string").alias("id"), F.col("ids").alias("WO_ids"),
                    F.col("ids").alias("W_ids"), F.size("ids").alias("WO_num_output_token"),
                    F.size("ids").alias("W_num_output_token"))
    ev.append_results(ev.paired_from_columns(cols, CFG), path)
    back = ev.read_results(spark, path)
    assert back.count() == 5
    assert ev.combine(empty, back).count() == 5


def test_sweep_equals_rescoring(spark):
    d = _doc_ids(spark).select(F.col("doc_id").cast("string").alias("id"), "ids")
    grid = ev.gamma_grid(vocab_size=CFG.vocab_size)
    sweep = ev.sweep_gamma(d, "ids", CFG, grid)
    assert sweep.select("gamma").distinct().count() == len(grid) == 17
    for gamma in (0.1, 0.25, 0.6):
        cfg = CFG.replace(gamma=gamma)
        direct = detect_ids(d, cfg, "ids").where("status = 'ok'").select("id", "num_green_tokens", "z_score")
        swept = sweep.where(F.abs(F.col("gamma") - gamma) < 1e-9).select("id", "num_green_tokens", "z_score")
        assert direct.exceptAll(swept).count() == 0


def test_threshold_rates_brute_force(spark):
    zs = [-1.0, 0.0, 0.3, 0.30000000000000004, 2.0, 3.0, 4.0, 4.05, 9.99, 10.0, 12.0, None]
    arms = spark.createDataFrame([("WO" if i % 2 else "W", z) for i, z in enumerate(zs)] +
                                 [("WO", 5.0), ("W", 0.1)], "arm string, z_score double")
    got = {round(r.threshold, 6): r for r in ev.threshold_rates(arms).collect()}
    assert len(got) == 101
    for j in range(101):
        t = j / 10.0
        for arm, col in (("WO", "fpr"), ("W", "tpr")):
            vals = [z for (a, z) in arms.collect() if a == arm and z is not None]
            exp = sum(1 for z in vals if z > t) / len(vals)
            assert getattr(got[round(t, 6)], col) == pytest.approx(exp), (arm, t)


def test_arm_summary(spark):
    arms = spark.createDataFrame([("WO", 1.0, False, 0.2), ("WO", 3.0, False, 0.3), ("W", 9.0, True, 0.6)],
                                 "arm string, z_score double, prediction boolean, green_fraction double")
    r = {x.arm: x for x in ev.arm_summary(arms).collect()}
    assert r["WO"].n_rows == 2 and r["WO"].mean_z == 2.0 and r["W"].predicted_rate == 1.0


def test_run_evaluation_resumes(spark, tmp_path):
    import yaml
    conf = tmp_path / "params.yaml"
    conf.write_text(yaml.safe_dump({
        "dataset_name_or_path": "documents", "dataset_section": None, "limit_dataset": 6,
        "max_new_tokens": 20, "gamma": 0.25, "delta": 2.0, "normalizers": "",
        "ignore_repeated_bigrams": False, "detection_z_threshold": 4.0, "select_green_tokens": True,
        "model_name_or_path": "ignored", "use_gpu": True}))
    cfg = WatermarkConfig.from_yaml(str(conf)).replace(z_threshold=4.0)
    path = str(tmp_path / "results")
    first = ev.run_evaluation(spark, cfg, SF001, path)
    assert first.count() == 6 and first.columns == ev.RESULT_COLUMNS
    again = ev.run_evaluation(spark, cfg.replace(limit_dataset=8), SF001, path)
    assert again.count() == 8
    assert ev.read_results(spark, path).count() == 8  # the first 6 were not redone


def test_paired_results_independent_of_shuffle_partitions(spark):
    from greenscan.plans.queries import paired_results
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = paired_results(spark, SF001).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = paired_results(spark, SF001).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(a) == sorted(b) and len(a) == 200


def test_settings_are_never_dropped():
    cfg = WatermarkConfig.from_mapping({"detection_z_threshold": "1.5", "select_green_tokens": "no", "gamma": 0.5,
                                        "use_gpu": True, "limit_dataset": 7})
    assert (cfg.z_threshold, cfg.select_green_tokens, cfg.gamma, cfg.limit_dataset) == (1.5, False, 0.5, 7)
    assert WatermarkConfig().limit_dataset is None
    for bad in ({"no_such_key": 1}, {"use_sampling": "perhaps"}):
        with pytest.raises(ValueError):
            WatermarkConfig.from_mapping(bad)


def test_sweep_follows_the_distinct_setting_and_keeps_short_texts(spark):
    df = spark.createDataFrame([("a", [1, 2, 1, 2, 1]), ("b", [5]), ("c", [])], "id string, ids array<bigint>")
    got = {(r.id, r.num_tokens_scored) for r in ev.sweep_gamma(df, "ids", CFG.replace(ignore_repeated_bigrams=True)).collect()}
    assert got == {("a", 2), ("b", None), ("c", None)}
    assert {r.num_tokens_scored for r in ev.sweep_gamma(df, "ids", CFG).where("id = 'a'").collect()} == {4}


def test_unknown_split_is_refused(spark):
    from greenscan.sources.tables import prepare_dataset
    with pytest.raises(ValueError):
        prepare_dataset(spark, SF001, "documents", "nosuchsplit")


def test_paired_results_keep_documents_without_id(spark, tmp_path):
    """Null ids: one row each, equal to that of the same table with ids."""
    from pyspark.sql import functions as F
    from greenscan.plans import queries as q
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12)
    docs = docs.unionByName(docs.orderBy("doc_id").limit(2).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("bigint")))
    rows = docs.collect()
    drop = {r["doc_id"] for r in rows[:5]} | {r["doc_id"] for r in rows if r["doc_id"] >= 10_000_000 or r["doc_id"] == -1}
    drop |= {i - 10_000_000 for i in drop if i >= 10_000_000}
    table = spark.createDataFrame(rows, docs.schema)
    table.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    table.withColumn("doc_id", F.when(~F.col("doc_id").isin(list(drop)), F.col("doc_id"))) \
        .write.parquet(str(tmp_path / "b" / "documents.parquet"))
    a, b = (q.paired_results(spark, str(tmp_path / k)).collect() for k in "ab")
    key = lambda r: tuple(map(str, (None if r["id"] in {str(i) for i in drop} else r["id"], *r[1:])))
    assert len(b) == len(rows) and sum(r["id"] is None for r in b) == len(drop)
    assert sorted(map(key, a)) == sorted(map(key, b))
    n = {r["arm"]: r["n_rows"] for r in q.arm_summary(spark, str(tmp_path / "b")).collect()}
    assert n == {"WO": len(rows), "W": len(rows)}


def test_surface_equals_detection_at_every_setting(spark):
    d = _doc_ids(spark).limit(40)
    odd = spark.createDataFrame([(None, []), (7, [5]), (7, [5, 6, 5, 6, 5, 6])], d.schema)
    d = d.unionByName(odd).unionByName(odd.where("size(ids) = 6")).withColumn("extra", F.lit(1)).cache()
    grid = [(g, int(CFG.vocab_size * g)) for g in (0.25, 0.5, 0.75)]  # 0.25 and 0.75: sizes of head and tail are close
    got = {(r.gamma, r.ignore_repeated, r.select_green, r.threshold): (r.n_scored, r.n_detected, r.rate)
           for r in ev.sweep_surface(d, "ids", CFG, grid, lo=-1.0, hi=4.0, step=0.5).collect()}
    assert len(got) == 3 * 2 * 2 * 11
    for gamma, _ in grid:
        for distinct in (False, True):
            for head in (True, False):
                cfg = CFG.replace(gamma=gamma, ignore_repeated_bigrams=distinct, select_green_tokens=head)
                z = [r.z_score for r in detect_ids(d, cfg, "ids").where("z_score IS NOT NULL").collect()]
                assert len(z) == 42
                for thr in (-1.0, 0.0, 0.5, 2.0, 4.0):
                    hits = sum(x > thr for x in z)
                    assert got[gamma, distinct, head, thr] == (42, hits, hits / 42)
    assert ev.sweep_surface(odd.where("size(ids) < 2"), "ids", CFG).collect() == []


def test_rewrite_counts_give_both_arms(spark, monkeypatch):
    """Both arms from one pass, equal by the literal and the joined way, with odd rows."""
    from greenscan.functions import greenlist as gl
    rows = [(1, [5, 6, 7, 5, 6]), (1, [5, 6, 7, 5, 6]), (2, [5]), (3, []), (4, None), (None, [7, 5])]
    d = spark.createDataFrame(rows, "id long, ids array<long>").withColumn("n", F.size("ids"))
    greedy = spark.createDataFrame([(5, 9), (7, 11)], "prev long, next_tok long")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in ev.rewrite_counts(d, "ids", greedy, CFG).collect()), key=key)
    monkeypatch.setattr(ev, "LITERAL_V", 1)
    joined = sorted((tuple(r) for r in ev.rewrite_counts(d, "ids", greedy, CFG).collect()), key=key)
    assert got == joined and len(got) == len(rows)
    written = {tuple(r) for r in detect_ids(d.where("size(ids) > 1"), CFG, "ids")
               .select("id", "num_tokens_scored", "num_green_tokens").collect()}
    assert {(r[0], r[2], r[3]) for r in got if r[1] is not None and r[1] > 1} == written
    monkeypatch.undo()
    plan = ev.rewrite_counts(d, "ids", greedy, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "md5" not in plan
    assert gl.LITERAL_V >= CFG.vocab_size


def test_surface_makes_ids_and_codes_once(spark):
    """Texts are hashed once for the filter and once for the codes, and no ranks are sorted."""
    plan = ev.sweep_surface(_doc_ids(spark), "ids", CFG)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and plan.count("md5(") <= 2
