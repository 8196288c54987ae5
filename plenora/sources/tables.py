"""Scans of the corpus tables.

Readers only build lazy scans; column pruning and predicate pushdown happen in
Catalyst once a query selects from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of ``{root}/{name}.parquet`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
