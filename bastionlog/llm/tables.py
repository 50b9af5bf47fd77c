"""The given tables of a data folder, by the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name``; only ``columns`` if any are named, whatever else it holds."""
    whole = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return whole.select(*columns) if columns else whole
