"""Readers for the parquet tables of a data folder.

Every reader selects only the columns it is asked for, so the parquet scan's
``ReadSchema`` is pruned and filters applied later are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; with ``columns`` the scan reads only those."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
