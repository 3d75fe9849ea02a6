"""Query sets in blocks: the driver holds one bounded block of queries at a time, each block is a Spark job over all rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from stowage.session import ensure_checkpoint_dir


def blocks_of(rows: Iterable, most: int, weigh=lambda r: 1) -> Iterator[list]:
    """Consecutive lists of rows whose weights sum to ``most`` at most (one row at least)."""
    held, total = [], 0
    for r in rows:
        w = weigh(r)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += w
    if held:
        yield held


class BlockTable:
    """One table to which the blocks of a query set are written one after the other, under the shared folder."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema, self.blocks = spark, schema, 0
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/llm-{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/block={self.blocks}")
        self.blocks += 1

    def read(self) -> DataFrame:
        """All blocks' rows; an empty table without blocks."""
        if not self.blocks:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).drop("block")
