"""Category tables.

The enriched parts table is big; every category table is an aggregate of it
whose size is bounded by the dimension product priority x movement x size
(x technology, x storage type), so joins *after* the aggregation broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.cleaning import category_dim, category_key, line_down_per_user, per_user, sku_volume
from stowage.operators.joins import small
from stowage.sources.fixtures import ALL_TECHS, DIM_MAX_ROWS

# The storage type and size that carry a penalty together (lift storing small parts).
PENALTY_TYPE_ID, PENALTY_SIZE_ID = 4, 1
# Categories are priority x movement x size; with three letters each this stays tiny.
CATEGORY_BOUND = 3 * 3 * DIM_MAX_ROWS


def parts_enriched(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Inner join to size volumes (parts without a size drop out) + volume, per-user orders, category."""
    sz = small(sizes.select("size", "min_vol", "total_cuft"), DIM_MAX_ROWS)
    j = parts.join(sz, "size", "inner")
    return j.select(
        *[F.col(c) for c in parts.columns], "min_vol", "total_cuft",
        sku_volume("min_vol", "total_stock", "total_cuft").alias("sku_cubic_ft"),
        per_user("orders", "num_users").alias("orders_per_user"),
        line_down_per_user("line_down_orders", "num_users").alias("ld_orders_per_user"),
        category_key("priority", "movement", "size").alias("category"),
    )


def category_summary(enriched: DataFrame) -> DataFrame:
    """D9 (A5 + W4): one row per category with counts and sums; ids 1..n in category order."""
    agg = enriched.groupBy("category").agg(
        F.min("priority").alias("priority"), F.min("movement").alias("movement"), F.min("size").alias("size"),
        F.min("size_id").alias("size_id"),
        F.count("material").cast("bigint").alias("num_sku"),  # parts has one row per material
        F.coalesce(F.sum("total_stock"), F.lit(0.0)).alias("total_stock"),
        F.coalesce(F.sum("orders"), F.lit(0.0)).alias("total_orders"),
        F.coalesce(F.sum("line_down_orders"), F.lit(0.0)).alias("line_down_orders"),
        F.min("min_vol").alias("min_vol"),
        F.coalesce(F.sum("sku_cubic_ft"), F.lit(0.0)).alias("sku_cubic_ft"),
    )
    # the aggregate holds at most CATEGORY_BOUND rows, so one ordered partition is fine here
    ids = F.row_number().over(Window.orderBy("category")).cast("int")
    return agg.select(ids.alias("category_id"), *agg.columns)


def category_tech(enriched: DataFrame, summary: DataFrame, tech_dim: DataFrame,
                  techs: list[str] = ALL_TECHS) -> DataFrame:
    """D10 (R2 + A6 + J11): category x technology; zero rows kept for unused technologies.

    The unpivot is aggregated per (category, tech) with map-side partial sums
    before anything is joined, so only the tiny aggregate meets the id tables.
    """
    long = enriched.unpivot(["category", "orders_per_user", "ld_orders_per_user"], list(techs),
                            "tech_name", "tech_flag")
    f = F.col("tech_flag").cast("double")
    agg = long.groupBy("category", "tech_name").agg(
        F.sum(f).alias("num_sku"),
        F.sum(f * F.col("ld_orders_per_user")).alias("ld_orders_per_user"),
        F.sum(f * F.col("orders_per_user")).alias("orders_per_user"))
    cats = small(summary.select("category", "category_id"), CATEGORY_BOUND)
    tids = small(tech_dim.select(F.upper("tech_name").alias("tech_name"), "tech_id"), DIM_MAX_ROWS)
    return (agg.join(cats, "category", "inner").join(tids, "tech_name", "inner")
            .select("category_id", "category", "tech_id", "tech_name", "num_sku",
                    "ld_orders_per_user", "orders_per_user"))


def category_type(summary: DataFrame, types: DataFrame, type_size: DataFrame) -> DataFrame:
    """D11 (J9 + J10): every category against every storage type, capacity by (type, size).

    Both inputs are bounded (categories <= CATEGORY_BOUND, types <= DIM_MAX_ROWS),
    so the full grid is a broadcast nested-loop product of two small tables.
    ``compatible`` reproduces the reference (always 1: the fill with 0 happens before
    the presence test); ``compatible_strict`` is 1 only when a capacity row exists.
    """
    cats = summary.select("category_id", "category", "size_id")
    ty = small(types.select("type_id", "type", F.col("cubic_capacity").alias("cubic_capacity_per_unit")),
               DIM_MAX_ROWS)
    grid = cats.crossJoin(ty)
    cap = small(type_size.select("type_id", "size_id", "max_sku_per_unit"), DIM_MAX_ROWS)
    j = grid.join(cap, ["type_id", "size_id"], "left")
    return j.select(
        "category_id", "category", "type_id", "type", "size_id", "cubic_capacity_per_unit",
        F.coalesce(F.col("max_sku_per_unit"), F.lit(0.0)).alias("max_sku_per_unit"),
        F.lit(1).alias("compatible"),
        F.when(F.col("max_sku_per_unit").isNotNull(), 1).otherwise(0).alias("compatible_strict"),
        F.when((F.col("size_id") == PENALTY_SIZE_ID) & (F.col("type_id") == PENALTY_TYPE_ID), 1)
        .otherwise(0).alias("penalty"),
    )


def category_letters(parts: DataFrame) -> DataFrame:
    """The (priority, movement) pairs of the parts: one small aggregate, from which both lists follow."""
    return parts.groupBy("priority", "movement").agg(F.count(F.lit(1)).alias("n"))


def category_grid(letters_: DataFrame, sizes: DataFrame) -> DataFrame:
    """All category keys priority x movement x size.

    Priorities and movements are the distinct non-null values of :func:`category_letters`
    (falling back to H/M/L when empty), sizes come from the size dimension.
    """
    def letters(col: str) -> DataFrame:
        vals = letters_.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).distinct()
        fallback = letters_.sparkSession.createDataFrame([("H",), ("M",), ("L",)], "v string")
        has = vals.limit(1).select(F.lit(1).alias("_has"))
        fb = fallback.join(has, F.lit(True), "left_anti")
        return vals.unionByName(fb)

    pr = letters("priority").withColumnRenamed("v", "priority")
    mv = letters("movement").withColumnRenamed("v", "movement")
    sz = sizes.select("size").filter(F.col("size").isNotNull()).distinct()
    grid = small(pr, CATEGORY_BOUND).crossJoin(small(mv, CATEGORY_BOUND)).crossJoin(small(sz, DIM_MAX_ROWS))
    return grid.select(category_key("priority", "movement", "size").alias("category"), "priority", "movement", "size")


def category_dims(df: DataFrame, col: str = "category") -> DataFrame:
    """split a category key back into its three one-letter dimensions."""
    return df.withColumn("cat_priority", category_dim(col, 1)) \
        .withColumn("cat_movement", category_dim(col, 2)) \
        .withColumn("cat_size", category_dim(col, 3))


def category_filter(df: DataFrame, priority: str | None = None, movement: str | None = None,
                    size: str | None = None, col: str = "category") -> DataFrame:
    """P5: optional equality filters on the three category letters (None / 'Any' = no filter)."""
    out = category_dims(df, col)
    for name, val in (("cat_priority", priority), ("cat_movement", movement), ("cat_size", size)):
        if val is not None and val != "Any":
            out = out.filter(F.col(name) == val)
    return out


def category_options(*dfs: DataFrame, col: str = "category") -> DataFrame:
    """P10 + U2: distinct sorted option values of the category letters over several tables."""
    cols = [category_dims(d.select(col), col) for d in dfs]
    u = cols[0]
    for d in cols[1:]:
        u = u.unionByName(d)
    long = u.select(F.explode(F.array(
        F.struct(F.lit("priority").alias("dim"), F.col("cat_priority").alias("value")),
        F.struct(F.lit("movement").alias("dim"), F.col("cat_movement").alias("value")),
        F.struct(F.lit("size").alias("dim"), F.col("cat_size").alias("value")))).alias("o")).select("o.*")
    return long.filter(F.col("value").isNotNull()).distinct().orderBy("dim", "value")
