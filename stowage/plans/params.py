"""Planning-model sets and parameter tables.

Parameters are kept as long DataFrames (one row per parameter instance) rather
than nested dictionaries; all are bounded by dimension products.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import flag
from stowage.operators.joins import small
from stowage.sources.fixtures import DIM_MAX_ROWS


# Members of a set whose table has none.
FALLBACK = {"priority": ["H", "M", "L"], "movement": ["H", "M", "L"], "sizes": ["S", "M", "L"], "priorities": ["1"]}


def _set(df: DataFrame, name: str, col: str) -> DataFrame:
    out = df.select(F.lit(name).alias("set_name"), F.col(col).cast("string").alias("member")) \
        .filter(F.col("member").isNotNull()).distinct()
    if name not in FALLBACK:
        return out
    default = df.sparkSession.createDataFrame([(name, m) for m in FALLBACK[name]], "set_name string, member string")
    return out.unionByName(default.join(out.limit(1).select(F.lit(1).alias("_has")), F.lit(True), "left_anti"))


def model_sets(parts: DataFrame, sizes: DataFrame, locations: DataFrame, types: DataFrame, techs: DataFrame,
               priorities_dim: DataFrame, grid: DataFrame) -> DataFrame:
    """A20 + P9 + J19: every model set as (set_name, member); the cumulative location sets per priority
    are named ``locations_upto_<p>``."""
    loc = locations.join(small(priorities_dim.select("location_priority", "reserve_allowed"), DIM_MAX_ROWS),
                         "location_priority", "left")
    prios = loc.select("location_priority").distinct()
    upto = loc.join(small(prios.withColumnRenamed("location_priority", "p"), DIM_MAX_ROWS),
                    F.col("location_priority") <= F.col("p"), "inner") \
        .select(F.concat(F.lit("locations_upto_"), F.col("p").cast("string")).alias("set_name"),
                F.col("location").alias("member"))
    sets = [_set(parts, "priority", "priority"), _set(parts, "movement", "movement"), _set(sizes, "sizes", "size"),
            _set(grid, "skus", "category"), _set(techs, "users", "tech_name"), _set(locations, "locs", "location"),
            _set(types, "types", "type"), _set(prios, "priorities", "location_priority"),
            _set(loc.filter(F.col("reserve_allowed") == 1), "secondary", "location"), upto]
    return reduce(lambda a, b: a.unionByName(b), sets)


def loc_tech_grid(techs: DataFrame, locations: DataFrame, tech_loc: DataFrame) -> DataFrame:
    """Every technology x location with 0/1 compatibility (bounded product of two dimensions)."""
    grid = techs.select("tech_id", "tech_name").crossJoin(small(locations.select("location_id", "location"),
                                                                DIM_MAX_ROWS))
    ok = small(tech_loc.select("tech_id", "location_id", F.lit(1).alias("_ok")), DIM_MAX_ROWS)
    j = grid.join(ok, ["tech_id", "location_id"], "left")
    return j.select("tech_name", "location", flag("_ok").alias("compatible"))


def type_loc_grid(types: DataFrame, locations: DataFrame, loc_types: DataFrame) -> DataFrame:
    """Every storage type x location with current units (missing = 0)."""
    grid = types.select("type_id", "type").crossJoin(small(locations.select("location_id", "location"), DIM_MAX_ROWS))
    cu = loc_types.groupBy("type_id", "location_id").agg(F.sum("current_units").alias("_u"))
    j = grid.join(small(cu, DIM_MAX_ROWS), ["type_id", "location_id"], "left")
    return j.select("type", "location", F.coalesce(F.col("_u").cast("double"), F.lit(0.0)).alias("current_units"))


def param_long(groups: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """P1 + S12: every parameter as (param, key_1..key_3, value) in one long table.

    ``groups`` maps a group name to (frame, key columns, value columns); each value
    column becomes parameter ``<group>.<column>``.
    """
    out = []
    for g, (df, keys, vals) in groups.items():
        ks = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (3 - len(keys))
        for v in vals:
            out.append(df.select(F.lit(f"{g}.{v}").alias("param"), *[k.alias(f"key_{i}") for i, k in enumerate(ks, 1)],
                                 F.col(v).cast("double").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), out)
