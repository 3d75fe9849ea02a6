"""Join sides that are small by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A side whose row count has a bound known from its construction (``max_rows``, e.g. a product of dimension sizes).

    The bound says why the join is cheap; nothing is forced: Spark broadcasts the side when its measured size is
    below ``spark.sql.autoBroadcastJoinThreshold``, at planning or (AQE) at run time, and else shuffles both.
    """
    if max_rows <= 0:
        raise ValueError("bound must be positive")
    return df
