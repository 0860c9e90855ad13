"""Tables checked before they are used (S2): every Parquet footer is read and the columns are
compared with the contract, in one Spark job over the files, so a broken file is named at once
and not by a task in the middle of a run.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files below a path, as Spark lists them; a path that is not there is refused."""
    try:
        return sorted(spark.read.schema("_none int").parquet(path).inputFiles())
    except Exception as e:
        raise ValueError(f"{path} cannot be read: {_cause(e)}") from e


def _cause(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:500]


def _named(e: Exception, files: list[str]) -> str | None:
    """The file that an error is about."""
    text = unquote(f"{e} {getattr(e, 'java_exception', '')} {e.__cause__ or ''}")
    hits = [f for f in files if os.path.basename(unquote(f)) in text]
    whole = [f for f in hits if unquote(f).split("://")[-1].replace("file:", "") in text]
    return (whole or hits or [None])[0]


def read_footers(spark: SparkSession, files: list[str]) -> T.StructType:
    """The schema that the footers of all files agree on; raises on a footer that is broken or
    in conflict. Spark reads footers in parallel on the executors when it merges schemas."""
    was = spark.conf.get("spark.sql.files.ignoreCorruptFiles")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    try:
        return spark.read.option("mergeSchema", "true").parquet(*files).schema
    finally:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", was)


def check_columns(found: T.StructType, wanted: T.StructType, where: str) -> None:
    have = {f.name: f.dataType for f in found.fields}
    wrong = [f"{f.name}: " + ("missing" if f.name not in have else
                              f"{have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
             for f in wanted.fields if not _fits(have.get(f.name), f.dataType)]
    if wrong:
        raise ValueError(f"{where} has other columns than its contract: {'; '.join(wrong)}")


def _fits(have: T.DataType | None, want: T.DataType) -> bool:
    """Equal, or a narrower integer, which the scan widens."""
    whole = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
    return have == want or (have in whole and want in whole and whole.index(have) <= whole.index(want))


def validated(spark: SparkSession, path: str, schema: T.StructType | None = None,
              set_aside: bool = False) -> tuple[DataFrame, list[str]]:
    """(table, files set aside). Broken files raise ``ValueError`` with their names before any
    job reads rows; with ``set_aside`` they are left out and returned instead. Without readable
    files there is no table. Columns that miss or differ from ``schema`` always raise."""
    files, bad, found = files_of(spark, path), [], None
    causes = {}
    while files and found is None:
        try:
            found = read_footers(spark, files)
        except Exception as e:
            broken = _named(e, files)
            if broken is None:
                raise ValueError(f"{path} cannot be read: {_cause(e)}") from e
            causes[broken] = _cause(e)
            bad.append(broken)
            files = [f for f in files if f != broken]
            if not set_aside:
                break
    if bad and not set_aside:
        raise ValueError(f"{path} holds a broken file: {bad[0]}: {causes[bad[0]]}")
    if found is None:
        raise ValueError(f"{path} holds no readable file" + (f"; broken: {', '.join(bad)}" if bad else ""))
    if schema is not None:
        check_columns(found, schema, path)
    return spark.read.schema(schema or found).parquet(*files), bad
