"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from greenscan.config import WatermarkConfig
from greenscan.sources.tables import read_table, spread

# The configuration of the flagship and most registered queries: the reference's
# batch defaults, distinct bigrams as the survey's calibration recommends.
CFG = WatermarkConfig()
CFG_DISTINCT = CFG.replace(ignore_repeated_bigrams=True)
LIMIT_ROWS = 500  # limit_dataset of the reference's settings file


def documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "text")) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(*cols))

