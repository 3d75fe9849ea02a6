"""Dimension maintenance.

Dimensions are small tables; every change is a set operation producing the
new table (anti-join + union), written as a new version by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import norm_key
from stowage.operators.joins import small
from stowage.sources.fixtures import DIM_MAX_ROWS

# Default token map used when the map table is empty.
DEFAULT_TOKEN_MAP = [("A", "ASSEMBLY"), ("B", "BODY"), ("P", "PAINT"), ("BODY", "BODY"), ("LC", "UNK"),
                     ("UNK", "UNK")]


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows with the same key; new keys are added."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def delete(table: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose key is listed."""
    return table.join(keys_df.select(*keys), keys, "left_anti")


def replace_group(table: DataFrame, rows: DataFrame, group_keys: list[str]) -> DataFrame:
    """All rows of each group present in ``rows`` are replaced by ``rows``."""
    groups = rows.select(*group_keys).distinct()
    return table.join(groups, group_keys, "left_anti").unionByName(rows.select(*table.columns))


def fk_filter(rel: DataFrame, parents: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Keep relationship rows whose foreign keys all exist in their parent tables."""
    out = rel
    for parent, keys in parents:
        out = out.join(small(parent.select(*keys).distinct(), DIM_MAX_ROWS), keys, "left_semi")
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """S3: (table, rows) for a set of tables, as one union of counts (no driver loop over data)."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_id(table: DataFrame, id_col: str) -> DataFrame:
    """max(id) + 1 (1 for an empty table)."""
    return table.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("next_id"))


def token_map_or_default(token_map: DataFrame) -> DataFrame:
    """The stored token map, or the default one when the table is empty."""
    spark = token_map.sparkSession
    default = spark.createDataFrame(DEFAULT_TOKEN_MAP, "value string, tech_name string")
    has = token_map.limit(1).select(F.lit(1).alias("_h"))
    return token_map.select("value", "tech_name").unionByName(default.join(has, F.lit(True), "left_anti"))


def derive_location(locations: DataFrame, priorities: DataFrame) -> DataFrame:
    """Name upper-trimmed; travel time (truncated to int) and reserve flag from the priority row."""
    pr = small(priorities.select("location_priority", F.col("travel_time").alias("_tt"), "reserve_allowed"),
               DIM_MAX_ROWS)
    j = locations.drop("travel_time").join(pr, "location_priority", "left")
    return j.select(*[c for c in locations.columns if c not in ("location", "travel_time")],
                    norm_key("location").alias("location"), F.col("_tt").cast("int").alias("travel_time"),
                    "reserve_allowed")


def one_group(table: DataFrame, key: str, value) -> DataFrame:
    """Rows of one group."""
    return table.filter(F.col(key) == F.lit(value))


def listing(table: DataFrame, order: list[str]) -> DataFrame:
    """O1: deterministic listing."""
    return table.orderBy(*order)
