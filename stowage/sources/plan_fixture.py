"""Two storage plans derived from the category tables: ``base``, and ``bad``, which breaks every rule.

No solver runs here: the plans follow simple rules over the categories, the
dimensions and the parts behind them, so that reports and audits have input that
changes with the given tables.  FIXTURES.md section 4 states the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.joins import small
from stowage.plans.plan_vars import PLAN_COLS, category_pairs, location_types
from stowage.sources.fixtures import DIM_MAX_ROWS

RESERVE_SHARE = 0.005


def _rows(df: DataFrame, variable: str, i1, i2, i3, i4, value, plan_id: str = "base") -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(plan_id).alias("plan_id"), F.lit(variable).alias("variable"),
                     *[(F.col(c) if isinstance(c, str) else (null if c is None else c)).cast("string").alias(f"index_{n}")
                       for n, c in enumerate((i1, i2, i3, i4), 1)],
                     value.cast("double").alias("value"))


def base_plan(summary: DataFrame, cat_tech: DataFrame, loc_types: DataFrame, locations: DataFrame, types: DataFrame,
              type_size: DataFrame, priorities: DataFrame, tech_loc: DataFrame, techs: DataFrame) -> DataFrame:
    lt = location_types(loc_types, locations, types)
    reserve = priorities.select("location_priority", "reserve_allowed")
    p = category_pairs(summary, lt, type_size).join(small(reserve, DIM_MAX_ROWS), "location_priority")
    cats = Window.partitionBy("category")  # pairs of one category: types x locations at most
    p = p.withColumn("np", F.count(F.lit(1)).over(cats)).withColumn("nr", F.sum("reserve_allowed").over(cats))
    out = [_rows(p, "SKUuniquePct", "category", "type", "location", None, 1.0 / F.col("np")),
           _rows(p, "SKUcubicPct", "category", "type", "location", None,
                 (1.0 - RESERVE_SHARE * F.col("nr")) / F.col("np"))]
    res = p.filter(F.col("reserve_allowed") == 1)
    out += [_rows(res, v, "category", "type", "location", None, F.lit(RESERVE_SHARE))
            for v in ("ResSKUuniquePct", "ResSKUcubicPct")]
    # units: where the priority is 2 one unit is bought per category stored there; where it is 3 one unit
    # moves to the first location that has the type
    used = p.groupBy("type_id", "location_id").agg(F.count(F.lit(1)).alias("nu"))
    lu = lt.join(used, ["type_id", "location_id"], "left").withColumn("nu", F.coalesce("nu", F.lit(0)))
    per_type = Window.partitionBy("type")
    lu = (lu.withColumn("first_id", F.min("location_id").over(per_type))
          .withColumn("first_loc", F.min_by("location", "location_id").over(per_type))
          .withColumn("buy", F.when(F.col("location_priority") == 2, F.col("nu")).otherwise(0))
          .withColumn("out", F.when((F.col("location_priority") == 3) & (F.col("location_id") != F.col("first_id")), 1)
                      .otherwise(0)))
    lu = (lu.withColumn("inb", F.when(F.col("location_id") == F.col("first_id"), F.sum("out").over(per_type)).otherwise(0))
          .withColumn("units", F.col("current_units") + F.col("buy") + F.col("inb") - F.col("out")))
    out += [_rows(lu.filter("buy > 0"), "BuyUnits", "type", "location", None, None, F.col("buy")),
            _rows(lu.filter("out > 0"), "RelocUnits", "type", "location", "first_loc", None, F.col("out")),
            _rows(lu, "StoreUnits", "type", "location", None, None, F.col("units"))]
    pu = p.join(lu.select("type", "location", "units", "nu"), ["type", "location"])
    out.append(_rows(pu, "SKUStoreUnits", "category", "type", "location", None, F.col("units") / F.col("nu")))
    tl = tech_loc.join(small(techs.select("tech_id", "tech_name"), DIM_MAX_ROWS), "tech_id")
    pt = p.join(small(tl.select("location_id", "tech_name"), DIM_MAX_ROWS), "location_id")
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("category", "tech_name"))
    out.append(_rows(pt.withColumn("share", share), "AllocFracUnique", "category", "type", "location", "tech_name",
                     F.col("share")))
    ld = cat_tech.crossJoin(small(priorities.select(F.col("location_priority").alias("prio")), DIM_MAX_ROWS))
    out.append(_rows(ld, "LineDownOrders", "category", "tech_name", "prio", None, F.col("num_sku") + F.col("prio")))
    out.append(_rows(summary.agg(F.count(F.lit(1)).alias("n")), "objective value", None, None, None, None, F.col("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


def bad_plan(base: DataFrame, summary: DataFrame, locations: DataFrame) -> DataFrame:
    """The base plan with every rule broken somewhere: a category left out, shares and units out of
    proportion, a type without units, a move in place, allocations where they may not be."""
    first = summary.agg(F.min("category").alias("first_cat"))
    v, x = F.col("variable"), F.col("value")
    changed = (base.join(F.broadcast(first), F.lit(True))  # one row
               .filter(~(v.isin("SKUuniquePct", "SKUcubicPct", "AllocFracUnique") & (F.col("index_1") == F.col("first_cat"))))
               .filter(~((v == "StoreUnits") & (F.col("index_1") == "ECONOMY")))
               .withColumn("value", F.when(v == "SKUuniquePct", x * 0.5).when(v == "SKUcubicPct", x * 2)
                           .when(v.isin("ResSKUuniquePct", "ResSKUcubicPct"), x * 40)
                           .when(v == "SKUStoreUnits", F.lit(0.0)).when(v == "BuyUnits", x * 100000)
                           .when(v == "StoreUnits", x * 1000).when(v == "AllocFracUnique", x * 0.5).otherwise(x))
               .withColumn("plan_id", F.lit("bad")).select(*PLAN_COLS))
    here = locations.filter("location_priority = 1").agg(F.min("location").alias("loc"))
    cats = summary.select("category").join(F.broadcast(here), F.lit(True))  # one row
    moved = base.filter(v == "RelocUnits")
    more = [_rows(moved, "RelocUnits", "index_1", "index_2", "index_2", None, F.col("value") + 1, "bad"),
            _rows(cats, "AllocFracUnique", "category", F.lit("SMALL"), "loc", F.lit("ASSEMBLY"), F.lit(0.25), "bad"),
            _rows(cats, "SKUStoreUnits", "category", F.lit("SMALL"), "loc", None, F.lit(2000.0), "bad"),
            _rows(cats, "ResSKUuniquePct", "category", F.lit("SMALL"), "loc", None, F.lit(0.25), "bad")]
    return reduce(lambda a, b: a.unionByName(b), [changed, *more])


def fixture_plans(summary: DataFrame, cat_tech: DataFrame, loc_types: DataFrame, locations: DataFrame, types: DataFrame,
                  type_size: DataFrame, priorities: DataFrame, tech_loc: DataFrame, techs: DataFrame) -> DataFrame:
    """Both plans, rows numbered within each plan."""
    base = base_plan(summary, cat_tech, loc_types, locations, types, type_size, priorities, tech_loc, techs)
    both = base.unionByName(bad_plan(base, summary, locations))
    w = Window.partitionBy("plan_id").orderBy("variable", "index_1", "index_2", "index_3", "index_4", "value")
    return both.withColumn("row_no", F.row_number().over(w).cast("bigint"))
