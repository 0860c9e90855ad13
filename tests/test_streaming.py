from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.operators.detect import detect_text
from greenscan.sources.tables import read_table
from greenscan.streaming import stream as st

from conftest import SF001

CFG = WatermarkConfig()


def test_stream_equals_batch(spark, tmp_path):
    src = st.read_stream(spark, SF001, "documents.parq[u]et")
    done = read_table(spark, SF001, "labels").select("doc_id")
    scored = st.detect_stream(src, CFG, "doc_id", "text", done=done)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    st.run_to_completion(scored, out, ckpt)
    got = st.results(spark, out).select("doc_id", "z_score")
    docs = read_table(spark, SF001, "documents").join(done, "doc_id", "left_anti")
    exp = detect_text(docs.select("doc_id", "text"), CFG, "text").select("doc_id", "z_score")
    assert got.count() == exp.count() > 0
    assert got.exceptAll(exp).count() == 0
    assert got.where(F.col("doc_id").isNull()).count() == 0
    # replaying an epoch overwrites its folder instead of adding rows
    batch = detect_text(docs.select("doc_id", "text"), CFG, "text")
    sink = st.idempotent_sink(out, "again")
    sink(batch, 0)
    sink(batch, 0)
    assert st.results(spark, out).count() == 2 * exp.count()  # the stream's rows and one run of the sink


def test_scoring_sink_equals_batch(spark, tmp_path):
    src = st.read_stream(spark, SF001, "documents.parq[u]et").select("doc_id", "text")
    done = read_table(spark, SF001, "labels").select("doc_id")
    out = str(tmp_path / "out")
    st.run_to_completion(st.skip_done_stream(src, done, "doc_id"), out, str(tmp_path / "ck"),
                         sink=st.scoring_sink(CFG, "doc_id", "text", out))
    docs = read_table(spark, SF001, "documents").join(done, "doc_id", "left_anti")
    exp = detect_text(docs.select("doc_id", "text"), CFG, "text").select("doc_id", "z_score")
    got = st.results(spark, out).select("doc_id", "z_score")
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def deliver(spark, folder, name, rows):
    full = [(i, t, None, None, k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def arrivals(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stored(spark, out):
    return sorted((str(r.doc_id), r.text) for r in st.results(spark, out).collect())


def test_redelivered_and_null_ids(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    deliver(spark, src, "a", [(1, "a"), (2, "b"), (2, "b again"), (None, "x"), (None, "x")])
    fresh = lambda: st.skip_seen(arrivals(spark, src), "doc_id").select("doc_id", "text")
    st.run_to_completion(fresh(), out, ckpt)
    assert [i for i, _ in stored(spark, out)] == ["1", "2", "None", "None"]
    deliver(spark, src, "b", [(2, "b late"), (3, "c"), (None, "x")])
    st.run_to_completion(fresh(), out, ckpt)  # goes on from the checkpoint, state and run name
    assert [i for i, _ in stored(spark, out)] == ["1", "2", "3", "None", "None", "None"]
    assert len({r._run for r in spark.read.parquet(out).select("_run").collect()}) == 1
    # the checkpoint is lost: ids in the sink are a static table now, rows without an id come again
    done = st.results(spark, out).select("doc_id").where("doc_id is not null")
    deliver(spark, src, "c", [(4, "d"), (1, "a")])
    st.run_to_completion(st.skip_done_stream(fresh(), done, "doc_id"), out, str(tmp_path / "ck2"))
    assert [i for i, _ in stored(spark, out)] == ["1", "2", "3", "4"] + ["None"] * 6


def test_late_rows_and_ids_after_the_bound(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "doc_id long, text string, at timestamp"

    def put(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string, at string").selectExpr(
            "doc_id", "text", "to_timestamp(at) AS at").coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        st.run_to_completion(st.skip_seen(s, "doc_id", "1 hour", "at").select("doc_id", "text"), out, ckpt)

    put("a", [(1, "first", "2024-01-01 10:00:00"), (2, "first", "2024-01-01 10:00:00")])
    run()
    put("b", [(1, "within", "2024-01-01 10:30:00"), (3, "first", "2024-01-01 14:00:00")])
    run()
    put("c", [(4, "late", "2024-01-01 09:00:00"), (2, "after", "2024-01-01 14:30:00"), (5, "untimed", None)])
    run()
    # late rows go, as event time defines them; an id comes back after its bound; no time is not late
    assert stored(spark, out) == [("1", "first"), ("2", "after"), ("2", "first"), ("3", "first"), ("5", "untimed")]


def test_no_batch_reads_the_sink(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, src, "a", [(1, "a b c"), (2, "b c d")])
    plans = []
    sink = st.scoring_sink(CFG, "doc_id", "text", out)

    def spying(batch, epoch):
        plans.append(batch._jdf.queryExecution().toString())
        sink(batch, epoch)
    st.run_to_completion(st.skip_seen(arrivals(spark, src), "doc_id").select("doc_id", "text"), out, str(tmp_path / "ck"), sink=spying)
    deliver(spark, src, "b", [(2, "b c d"), (3, "c d e")])
    st.run_to_completion(st.skip_seen(arrivals(spark, src), "doc_id").select("doc_id", "text"), out, str(tmp_path / "ck"), sink=spying)
    assert len(plans) >= 2 and not any(out in p for p in plans)
    assert sorted(r.doc_id for r in st.results(spark, out).collect()) == [1, 2, 3]
