"""Table scans (S1, S2, P1-P3, T1) and the parallelism guard.

Tables are Parquet files ``{sf_dir}/{name}.parquet``. Readers use explicit schemas
so a malformed file fails the scan (S2) instead of drifting types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.sources.validate import check_columns, validated

SCHEMAS = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]),
}

# Input contract of the evaluation (FIXTURES §1): id STRING, document STRING, split STRING.
INPUT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("document", T.StringType()),
    T.StructField("split", T.StringType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = SCHEMAS.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows when a scan yields fewer partitions than the cluster has
    task slots (a small file with one row group reads as one partition). At scale the
    scan already has many splits and this is a no-op, so no shuffle is added."""
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()  # split planning only, no job
    except Exception:  # sessions without RDD access: leave the scan as it is
        return df
    return df.repartition(want) if have < want else df


# Dataset profiles (S1): name -> (table, renames to the input contract, id expression).
# The reference knows two news sets matched by substring; here the profiles map the
# available text tables onto (id, document).
PROFILES = {
    "documents": ("documents", {"text": "document"}, lambda: F.col("doc_id").cast("string"), ["doc_id"]),
    "conversations": ("conversations", {"text": "document"},
                      lambda: F.concat_ws(":", F.col("conv_id").cast("string"),
                                          F.col("turn").cast("string")), ["conv_id", "turn"]),
    "benchmark": ("benchmark", {"text": "document"}, lambda: F.col("item_id").cast("string"), ["item_id"]),
}


def prepare_dataset(spark: SparkSession, sf_dir: str, name: str, split: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """Scan a profile into (id STRING, document STRING, split STRING).

    ``split`` filters the table's ``split`` column (pushed to the scan) and is refused where
    the table has none; ``limit`` keeps the first ``limit`` rows by id, as the reference's slice does (T1).
    """
    key = next((k for k in PROFILES if k in name), None)
    if key is None:
        raise ValueError(f"no profile for dataset {name!r}; profiles: {', '.join(PROFILES)}")
    table, renames, id_expr, order = PROFILES[key]
    try:  # S2: load failures surface as ValueError, before any job reads rows
        needed = T.StructType([f for f in SCHEMAS[table].fields if f.name in {*renames, *order}])
        df, _ = validated(spark, f"{sf_dir.rstrip('/')}/{table}.parquet")
        check_columns(df.schema, needed, table)
    except ValueError as e:
        raise ValueError(f"dataset {name!r} cannot be read: {e}") from e
    cols = [id_expr().alias("id")]
    for src, dst in renames.items():
        cols.append(F.col(src).alias(dst))
    if "split" in df.columns:
        cols.append(F.col("split"))
        if split is not None:
            df = df.where(F.col("split") == F.lit(split))
    elif split is not None:
        raise ValueError(f"dataset {name!r} has no splits; {split!r} was asked for")
    else:
        cols.append(F.lit(None).cast("string").alias("split"))
    if limit is not None:  # dataset order: the source key, before the id becomes a string
        df = df.orderBy(*order).limit(limit)
    return df.select(*cols)


def limit_ordered(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """First n rows in a stable order (T1); None keeps all rows. Spark plans this
    as TakeOrderedAndProject: a per-partition top-n, then a merge of n rows each."""
    if n is None:
        return df
    return df.orderBy(order_col).limit(n)
