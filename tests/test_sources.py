"""Broken and odd files are named before rows are read."""
import glob
import os

import pytest

from greenscan.sources.tables import SCHEMAS, prepare_dataset
from greenscan.sources.validate import validated

from conftest import SF001


@pytest.fixture
def folder(spark, tmp_path):
    d = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SF001}/documents.parquet").repartition(4).write.parquet(d)
    return d


def truncate(folder, k):
    f = sorted(glob.glob(f"{folder}/part-*"))[k]
    crc = os.path.join(folder, f".{os.path.basename(f)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with open(f, "r+b") as h:
        h.truncate(os.path.getsize(f) // 2)
    return os.path.basename(f)


def test_a_sound_table(spark, folder):
    df, bad = validated(spark, folder, SCHEMAS["documents"])
    assert bad == [] and df.count() == spark.read.parquet(folder).count()


def test_a_truncated_file_is_named_before_any_row_is_read(spark, folder):
    name = truncate(folder, 1)
    with pytest.raises(ValueError, match=name):
        validated(spark, folder, SCHEMAS["documents"])
    with pytest.raises(ValueError, match=name):
        prepare_dataset(spark, os.path.dirname(folder), "documents")


def test_broken_files_set_aside(spark, folder):
    names = {truncate(folder, k) for k in (0, 2)}
    df, bad = validated(spark, folder, SCHEMAS["documents"], set_aside=True)
    assert {os.path.basename(b) for b in bad} == names
    assert 0 < df.count() < 200
    truncate(folder, 1), truncate(folder, 3)
    with pytest.raises(ValueError, match="no readable file"):
        validated(spark, folder, SCHEMAS["documents"], set_aside=True)


def test_other_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.range(3).selectExpr("cast(id as string) AS doc_id", "'x' AS text").write.parquet(path)
    with pytest.raises(ValueError, match="doc_id: string instead of bigint"):
        prepare_dataset(spark, str(tmp_path), "documents")
    with pytest.raises(ValueError, match="lang: missing"):
        validated(spark, path, SCHEMAS["documents"])
    with pytest.raises(ValueError, match="cannot be read"):
        validated(spark, str(tmp_path / "nothing"))
