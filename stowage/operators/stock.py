"""Stock export cleaning (D1/D2): parse stock, attach storage type and size, first bin wins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import clean_int
from stowage.operators.joins import small
from stowage.session import dealt
from stowage.sources.fixtures import DIM_MAX_ROWS

# Sizing rule thresholds (stock strictly above the cutoff is small).
SHELF_TYPE_ID, SHELF_CUTOFF = 3, 20
LIFT_TYPE_ID, LIFT_CUTOFF = 4, 30
CABINET_TYPE_ID = 1
RACK_TYPE_ID = 5


def first_per_key(df: DataFrame, key: str, *order_cols: str, parts: int | None = None) -> DataFrame:
    """Keep the first row per key in input order (``order_cols``, of any types that can be ordered).

    One hash aggregate with map-side partial ``min_by``: a hot key is reduced on
    every mapper before the shuffle, so no task ever holds all its rows.

    With ``parts`` (many keys) that many tasks share the rows, so that none holds more as the keys grow.  A key is then
    dealt by slices of its rows first, so a hot one is spread, and its slices' first rows meet, partitioned by the key.
    """
    others = [c for c in df.columns if c != key]
    place = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    picked = F.min_by(F.struct(*[F.col(c) for c in others]), place).alias("_first")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(picked).select(key, *[F.col("_first." + c).alias(c) for c in others])

    if parts:
        sliced = df.withColumn("_slice", F.pmod(F.hash(*order_cols), F.lit(math.isqrt(parts) + 1)))
        df = first(dealt(sliced, parts, key, "_slice"), key, "_slice")
    return first(dealt(df, parts, key), key)


def size_label(type_id, stock) -> F.Column:
    """Storage type (+ stock) to size bucket; unmatched types give null."""
    t, s = F.col(type_id), F.col(stock)
    return (F.when(t == CABINET_TYPE_ID, F.lit("S"))
            .when(t == SHELF_TYPE_ID, F.when(s > SHELF_CUTOFF, "S").otherwise("M"))
            .when(t == LIFT_TYPE_ID, F.when(s > LIFT_CUTOFF, "S").otherwise("M"))
            .when(t == RACK_TYPE_ID, F.lit("L"))
            .otherwise(F.lit(None).cast("string")))


def stock_sized(raw_stock: DataFrame, location_types: DataFrame, sizes: DataFrame, parts: int | None = None) -> DataFrame:
    """Clean stock rows; one row per material (first bin in input order).

    A bin code may name several (location, type) rows; the first of them, by location and type, sizes the bin.
    Output: material, total_stock (bigint), size, size_id, storage_type (bin code), type_id.
    """
    rows = raw_stock.select(
        "row_no", "material", "code", clean_int("total_stock_raw").alias("total_stock")
    ).filter(F.col("material").isNotNull())
    codes = small(location_types.select("code", "location_id", "type_id"), DIM_MAX_ROWS)
    sized = rows.join(codes, "code", "left").withColumn("size", size_label("type_id", "total_stock"))
    size_ids = small(sizes.select("size", "size_id"), DIM_MAX_ROWS)
    sized = sized.join(size_ids, "size", "left")
    first = first_per_key(sized.select("material", "row_no", "location_id", "total_stock", "size", "size_id", "code",
                                       "type_id"), "material", "row_no", "location_id", "type_id", parts=parts)
    return first.select("material", "total_stock", "size", "size_id",
                        F.col("code").alias("storage_type"), "type_id")


def stock_rejects(stock: DataFrame) -> DataFrame:
    """Rows the parts load cannot take (null stock or no size): kept aside instead of aborting the load."""
    return stock.filter(F.col("total_stock").isNull() | F.col("size_id").isNull())
