"""Readers for the parquet inputs."""

from __future__ import annotations

import os
import weakref

from pyspark.sql import DataFrame, SparkSession

# One lazily-planned scan per (session, path): file listing and footer reads happen once,
# and every query that projects from it still gets its own pruned ReadSchema.
_SCANS: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; callers project right away so only used columns are read."""
    path = table_path(sf_dir, name)
    per = _SCANS.setdefault(spark, {})
    if path not in per:
        per[path] = spark.read.parquet(path)
    return per[path]
