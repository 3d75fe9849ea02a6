"""Decision-variable table of a storage plan, and its reading helpers.

A plan is the sparse table ``plan_vars(plan_id, variable, index_1..index_4,
value, row_no)``, of any number of plans.  Any external planner can write one.  A
plan is bounded by the dimension product categories x types x locations x
technologies; their number is not, so plan tables are never broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import parse_variable
from stowage.operators.joins import small
from stowage.sources.fixtures import DIM_MAX_ROWS

# Values at or below this magnitude are solver noise and dropped.
NONZERO_EPS = 1e-6

PLAN_COLS = ["plan_id", "variable", "index_1", "index_2", "index_3", "index_4", "value"]


def location_types(loc_types: DataFrame, locations: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, type, location_id, location, location_priority, current_units) with valid keys only."""
    lt = loc_types.join(small(locations.select("location_id", "location", "location_priority"), DIM_MAX_ROWS),
                        "location_id", "inner")
    return lt.join(small(types.select("type_id", "type"), DIM_MAX_ROWS), "type_id", "inner") \
        .select("type_id", "type", "location_id", "location", "location_priority",
                F.col("current_units").cast("double").alias("current_units"))


def category_pairs(summary: DataFrame, lt: DataFrame, type_size: DataFrame) -> DataFrame:
    """(category, type, location) where the location has the type and the type stores the category's size."""
    cats = summary.select("category", "size_id")
    p = cats.join(small(type_size.select("type_id", "size_id"), DIM_MAX_ROWS), "size_id", "inner")
    return p.join(small(lt, DIM_MAX_ROWS), "type_id", "inner")


def plan_ids(plan: DataFrame) -> DataFrame:
    return plan.select("plan_id").distinct()


def variable_names(plan: DataFrame) -> DataFrame:
    """Solver-style names ``Base[i1, i2, ...]`` (the form a planner's output file carries)."""
    idx = F.concat_ws(", ", "index_1", "index_2", "index_3", "index_4")
    name = F.when(F.col("index_1").isNull(), F.col("variable")).otherwise(F.format_string("%s[%s]", "variable", idx))
    return plan.select("plan_id", "row_no", name.alias("name"), "value")


def parse_names(named: DataFrame) -> DataFrame:
    """split ``Base[i, j, ...]`` back into variable + up to four trimmed indices."""
    base, *idx = parse_variable("name")
    return named.select("plan_id", "row_no", base.alias("variable"),
                        *[c.alias(f"index_{i}") for i, c in enumerate(idx, 1)], "value")


def nonzero(plan: DataFrame) -> DataFrame:
    """Keep variables whose magnitude exceeds the noise threshold."""
    return plan.filter(F.abs(F.col("value")) > NONZERO_EPS)


def load_plan_text(plan_text: DataFrame) -> DataFrame:
    """Plan read from text; value coerced to double (bad -> null)."""
    return plan_text.withColumn("value", F.trim(F.col("value")).try_cast("double"))


def family(plan: DataFrame, variable: str) -> DataFrame:
    """One variable family."""
    return plan.filter(F.col("variable") == variable)
