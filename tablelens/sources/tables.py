"""Parquet tables (column pruning and filter pushdown happen in the scan)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table of a scale-factor directory."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register the tables as temporary views for ``spark.sql``."""
    for name in names or TABLES:
        if os.path.exists(table_path(sf_dir, name)):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
