"""Results per batch: a run that is cut off anywhere ends with the rows of a single run."""
import pytest
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.operators import batches as bt
from greenscan.operators import evaluate as ev

from conftest import SF001


class Cut(Exception):
    pass


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark):
    ids = [*range(60), 7, 7, None, None]
    return spark.createDataFrame([(i, f"text {i}", k % 3) for k, i in enumerate(ids)], "id long, text string, extra int")


def work(df):
    return df.select("id", F.length("text").cast("long").alias("n"), F.lit("x").alias("mark"))


def want(spark):
    return sorted(((r.id, len(r.text), "x") for r in table(spark).collect()), key=str)


def test_a_run_cut_off_between_batches(spark, tmp_path):
    seen = []

    def cut(k):
        seen.append(k)
        if len(seen) == 2:
            raise Cut
    folder = str(tmp_path / "r")
    with pytest.raises(Cut):
        bt.run_batches(table(spark), folder, "id", work, 5, "run", after=cut)
    assert bt.finished(spark, folder) == {0, 1}
    part = sorted((tuple(r) for r in bt.read_batches(spark, folder).collect()), key=str)
    assert 0 < len(part) < len(want(spark))
    again = []
    out = bt.run_batches(table(spark), folder, "id", work, 99, "run", after=again.append)
    assert again == [2, 3, 4]  # nothing is done twice, the first plan holds
    assert sorted((tuple(r) for r in out.collect()), key=str) == want(spark)
    assert out.columns == ["id", "n", "mark"]


def test_a_batch_cut_off_while_writing_is_invisible(spark, tmp_path):
    folder, calls = str(tmp_path / "r"), []

    def breaks(df):
        calls.append(1)
        if len(calls) == 3:
            # its rows reach the folder, its manifest entry does not
            work(df).write.mode("overwrite").parquet(f"{folder}/rows/_batch=2")
            raise Cut
        return work(df)
    with pytest.raises(Cut):
        bt.run_batches(table(spark), folder, "id", breaks, 4, "run")
    before = bt.read_batches(spark, folder).count()
    assert bt.finished(spark, folder) == {0, 1} and before < len(want(spark))
    out = bt.run_batches(table(spark), folder, "id", work, 4, "run")
    assert sorted((tuple(r) for r in out.collect()), key=str) == want(spark)


def test_an_input_cut_off_is_dealt_anew(spark, tmp_path):
    folder = str(tmp_path / "r")
    table(spark).limit(5).withColumn("_batch", F.lit(0)).write.partitionBy("_batch").parquet(f"{folder}/input")
    out = bt.run_batches(table(spark), folder, "id", work, 3, "run")
    assert sorted((tuple(r) for r in out.collect()), key=str) == want(spark)


def test_other_settings_are_refused_and_empty_tables_work(spark, tmp_path):
    folder = str(tmp_path / "r")
    out = bt.run_batches(table(spark).limit(0), folder, "id", work, 2, "gamma 0.25")
    assert out.count() == 0 and out.columns == ["id", "n", "mark"]
    with pytest.raises(ValueError):
        bt.run_batches(table(spark), folder, "id", work, 2, "gamma 0.5")
    with pytest.raises(ValueError):
        bt.read_batches(spark, str(tmp_path / "none"))


def test_evaluation_keeps_the_batches_before_a_crash(spark, tmp_path, monkeypatch):
    cfg = WatermarkConfig(limit_dataset=12, max_new_tokens=6)
    whole = rows(ev.run_evaluation(spark, cfg, SF001, str(tmp_path / "whole"), batches=1))
    real, calls = ev.append_results, []

    def dies(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise Cut
        real(*a, **k)
    path = str(tmp_path / "parts")
    monkeypatch.setattr(ev, "append_results", dies)
    with pytest.raises(Cut):
        ev.run_evaluation(spark, cfg, SF001, path, batches=6)
    monkeypatch.setattr(ev, "append_results", real)
    left = rows(ev.read_results(spark, path))
    assert 0 < len(left) < len(whole) and set(left) < set(whole)
    assert rows(ev.run_evaluation(spark, cfg, SF001, path, batches=6)) == whole
