"""Every registered query of the first part against its oracle on tables whose rows are odd:
repeated and null ids, equal rows, null, empty and very short texts, other scripts."""
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from greenscan.plans.queries import QUERIES
from oracle_compare import canon, duck

LONG = " ".join(f"word{i % 37} the The cat. sat, on é mat!" for i in range(60))
TEXTS = [(2, "One cat sat. The dog saw two cats, and the dog ran. The end is near."), (2, "Two dogs ran on. The cat sat"),
         (None, "A null id. The first one of them."), (None, "Another null id, the second."), (None, "A null id. The first one of them."),
         (None, None), (None, None), (1, "x"), (3, ""), (4, "ab"), (5, None), (6, LONG), (6, LONG), (7, "Ärger über Öl. été naïve"),
         (8, "漢字 かな 한글 mixed with latin l1I0O"), (9, "..."), (10, "one"), (11, " \n\t "), (12, "the The THE the. the"),
         (13, "I l 1 | 0 O `'"), (-4, "minus four"), (9223372036854775807, "the largest id")]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    n = len(TEXTS)
    docs = pa.table({"doc_id": pa.array([i for i, _ in TEXTS], pa.int64()), "text": pa.array([t for _, t in TEXTS], pa.string()),
                     "lang": pa.array([["en", None, "fr", "de"][k % 4] for k in range(n)], pa.string()),
                     "source": pa.array([None if k % 5 == 0 else f"s{k % 3}" for k in range(n)], pa.string()),
                     "n_chars": pa.array([len(t or "") for _, t in TEXTS], pa.int64())})
    talks = pa.table({"conv_id": pa.array([1, 1, None, 2, 2], pa.int64()), "turn": pa.array([0, 0, 1, None, 1], pa.int64()),
                      "role": pa.array(["user", "user", None, "a", "b"], pa.string()),
                      "text": pa.array(["hello there you", "hello there you", "no id", None, ""], pa.string())})
    labels = pa.table({"doc_id": pa.array([1, 6, 6, None], pa.int64()), "quality": pa.array([0, 1, 1, 0], pa.int32()),
                       "toxic": pa.array([0, 0, 0, 1], pa.int32())})
    pq.write_table(docs, f"{d}/documents.parquet")
    pq.write_table(talks, f"{d}/conversations.parquet")
    pq.write_table(labels, f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty_dir(odd_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "conversations", "labels"):
        pq.write_table(pq.read_table(f"{odd_dir}/{name}.parquet").slice(0, 0), f"{d}/{name}.parquet")
    return str(d)


ROWS_ONLY = {"generate_paired"}


def both(spark, name, folder):
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name in ROWS_ONLY:
        return rows, None
    rel = duck(folder).sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    return canon(rows, df.columns), canon(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_detect"}))
def test_odd_rows_match_the_oracle(spark, odd_dir, name):
    got, want = both(spark, name, odd_dir)
    if name in ROWS_ONLY:
        assert got
    else:
        assert got == want


def test_odd_rows_of_the_stream(spark, odd_dir):
    """A repeated id is scored once, rows without an id all are."""
    rows = [r.asDict() for r in QUERIES["stream_detect"](spark, odd_dir).collect()]
    done, seen = {1, 6}, {}
    for i, t in TEXTS:
        if i not in done:
            seen.setdefault(i, []).append(t)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(
        str(i) for i, ts in seen.items() for _ in (ts if i is None else ts[:1]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    got, want = both(spark, name, empty_dir)
    assert got == (want or []), name
    assert np.size(got) == 0 or name in ("threshold_rates",)
