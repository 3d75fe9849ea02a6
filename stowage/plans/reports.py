"""Plan reports: units, buys, relocations, allocation, maps, pivots and tidy forms.

The only big input is the parts table (one row per material); every report
aggregates it first and only then meets the (small) plan tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.cleaning import display_percent, minmax_radius
from stowage.operators.joins import small
from stowage.plans.plan_vars import family, plan_ids
from stowage.session import materialize
from stowage.sources.fixtures import DIM_MAX_ROWS

KEYS = ["category", "type", "location"]


def parts_located(enriched: DataFrame, lt: DataFrame) -> DataFrame:
    """Parts to (location, type) through their bin code (left join; unmatched stay null).

    A code may name several (location, type) rows, and a part then has a row for each.  ``first_place`` is true
    for one row of a part, ``first_here`` for one row of a part at each location: counting those counts distinct materials.
    """
    codes = small(lt.select("code", "location", "type", "first_place", "first_here"), DIM_MAX_ROWS)
    j = enriched.join(codes, enriched.storage_type == codes.code, "left").drop("code")
    return j.withColumn("first_place", F.coalesce("first_place", F.lit(True)))


def location_type_named(loc_types: DataFrame, locations: DataFrame, types: DataFrame) -> DataFrame:
    """Relationship rows with readable names: (code, location, type, current_units, location_id, type_id), and
    whether a row is the first of its code, and of its code at its location."""
    l = small(locations.select("location_id", "location"), DIM_MAX_ROWS)
    t = small(types.select("type_id", "type"), DIM_MAX_ROWS)
    code, here = Window.partitionBy("code"), Window.partitionBy("code", "location_id")
    return loc_types.join(l, "location_id", "inner").join(t, "type_id", "inner").select(
        "code", "location", "type", F.col("current_units").cast("double").alias("current_units"),
        "location_id", "type_id",
        (F.row_number().over(code.orderBy("location_id", "type_id")) == 1).alias("first_place"),
        (F.row_number().over(here.orderBy("type_id")) == 1).alias("first_here"))


def relation_named(rel: DataFrame, left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str,
                   right_name: str) -> DataFrame:
    """Any relationship table with the names of both sides (left joins: rows with an unknown id stay, unnamed)."""
    l = small(left.select(left_id, left_name), DIM_MAX_ROWS)
    r = small(right.select(right_id, right_name), DIM_MAX_ROWS)
    return rel.join(l, left_id, "left").join(r, right_id, "left")


def _pct(plan: DataFrame, variable: str, name: str) -> DataFrame:
    return family(plan, variable).select("plan_id", F.col("index_1").alias("category"), F.col("index_2").alias("type"),
                                         F.col("index_3").alias("location"), F.col("value").alias(name))


def _units(plan: DataFrame, name: str) -> DataFrame:
    return family(plan, "StoreUnits").select("plan_id", F.col("index_1").alias("type"),
                                             F.col("index_2").alias("location"), F.col("value").alias(name))


def units_change(plan: DataFrame, lt_named: DataFrame) -> DataFrame:
    """D15 + J12: recommended store units per plan, type and location with the current units (missing = 0)."""
    cur = lt_named.groupBy("type", "location").agg(F.sum("current_units").alias("current_units"))
    j = _units(plan, "recommended_units").join(small(cur, DIM_MAX_ROWS), ["type", "location"], "left")
    return j.select("plan_id", "type", "location", F.coalesce("current_units", F.lit(0.0)).alias("current_units"),
                    "recommended_units")


def buys(plan: DataFrame) -> DataFrame:
    return family(plan, "BuyUnits").select("plan_id", F.col("index_1").alias("type"), F.col("index_2").alias("location"),
                                           F.col("value").alias("units"))


def relocations(plan: DataFrame) -> DataFrame:
    return family(plan, "RelocUnits").select("plan_id", F.col("index_1").alias("type"),
                                             F.col("index_2").alias("from_location"),
                                             F.col("index_3").alias("to_location"), F.col("value").alias("units"))


def _volume() -> F.Column:
    return F.coalesce(F.sum("sku_cubic_ft"), F.lit(0.0))


def _cell(measure: str) -> F.Column:
    """Measure of a (category, type, location) cell, in which a part has at most one row."""
    return F.count("material").cast("double") if measure == "count" else _volume()


def _total(measure: str) -> F.Column:
    """Measure of a category: distinct materials, or volume over all rows."""
    return F.count_if("first_place").cast("double") if measure == "count" else _volume()


def _variable(measure: str, reserve: bool = False) -> str:
    return ("Res" if reserve else "") + ("SKUuniquePct" if measure == "count" else "SKUcubicPct")


def alloc_report(located: DataFrame, plan: DataFrame, measure: str) -> DataFrame:
    """A7/A8 + J15: current vs recommended forward allocation per plan and (category, type, location).

    ``measure`` = "count" (distinct materials, SKUuniquePct) or "cubic" (volume, SKUcubicPct).
    """
    keyed = located.filter(F.col("type").isNotNull() & F.col("location").isNotNull())
    cell = keyed.groupBy(*KEYS).agg(_cell(measure).alias(f"current_{measure}")).crossJoin(plan_ids(plan))  # cells per plan
    tot = located.groupBy("category").agg(_total(measure).alias(f"total_{measure}"))
    j = cell.join(_pct(plan, _variable(measure), "recommended_pct"), ["plan_id", *KEYS], "full_outer")
    j = j.join(tot, "category", "left")
    total = F.coalesce(F.col(f"total_{measure}"), F.lit(0.0))
    cur_v = F.coalesce(F.col(f"current_{measure}"), F.lit(0.0))
    return j.select("plan_id", *KEYS, cur_v.alias(f"current_{measure}"), total.alias(f"total_{measure}"),
                    F.coalesce(F.try_divide(F.col(f"current_{measure}"), F.col(f"total_{measure}")), F.lit(0.0))
                    .alias("current_pct"),
                    F.coalesce("recommended_pct", F.lit(0.0)).alias("recommended_pct"),
                    (F.coalesce("recommended_pct", F.lit(0.0)) * total).alias(f"recommended_{measure}"))


def reserve_report(located: DataFrame, plan: DataFrame, measure: str) -> DataFrame:
    """D16 reserve side: recommended reserve share and amount per plan and (category, type, location)."""
    tot = located.groupBy("category").agg(_total(measure).alias(f"total_{measure}"))
    j = _pct(plan, _variable(measure, True), "reserve_pct").join(tot, "category", "left")
    total = F.coalesce(F.col(f"total_{measure}"), F.lit(0.0))
    return j.select("plan_id", *KEYS, "reserve_pct", total.alias(f"total_{measure}"),
                    (F.col("reserve_pct") * total).alias(f"reserve_{measure}"))


def forward_reserve(located: DataFrame, plan: DataFrame, measure: str) -> DataFrame:
    """Forward and reserve shares side by side (missing = 0), with the amounts they stand for."""
    f = _pct(plan, _variable(measure), "forward_pct")
    r = _pct(plan, _variable(measure, True), "reserve_pct")
    tot = located.groupBy("category").agg(_total(measure).alias("total"))
    j = f.join(r, ["plan_id", *KEYS], "full_outer").join(tot, "category", "left")
    fp, rp = F.coalesce("forward_pct", F.lit(0.0)), F.coalesce("reserve_pct", F.lit(0.0))
    total = F.coalesce("total", F.lit(0.0))
    return j.select("plan_id", *KEYS, fp.alias("forward_pct"), rp.alias("reserve_pct"),
                    (fp * total).alias(f"forward_{measure}"), (rp * total).alias(f"reserve_{measure}"))


# --- maps -------------------------------------------------------------------------------------------------
def map_current(located: DataFrame, lt_named: DataFrame, locations: DataFrame, type_names: list[str]) -> DataFrame:
    """D17 current side (A9, A10, R4, J17): location x category with location totals, units and travel time."""
    keyed = located.filter(F.col("location").isNotNull())
    cell = keyed.groupBy("location", "category").agg(
        F.coalesce(F.sum("line_down_orders"), F.lit(0.0)).alias("total_ldo"),
        F.count_if("first_here").cast("bigint").alias("material_count"),
        F.coalesce(F.sum("sku_cubic_ft"), F.lit(0.0)).alias("total_cubic_ft"))
    loc_tot = cell.groupBy("location").agg(F.sum("material_count").cast("bigint").alias("loc_total_materials"),
                                           F.sum("total_cubic_ft").alias("loc_total_cubic_ft"),
                                           F.sum("total_ldo").alias("loc_total_ldo"))
    units = units_pivot(lt_named, type_names)
    loc = small(locations.select("location", "lat", "lon", "travel_time"), DIM_MAX_ROWS)
    return (cell.join(loc_tot, "location", "left").join(small(units, DIM_MAX_ROWS), "location", "left")
            .join(loc, "location", "left"))


def units_pivot(units: DataFrame, type_names: list[str], value: str = "current_units",
                prefix: str = "current_", by: list[str] = ["location"]) -> DataFrame:
    """Units per location, one column per storage type plus the total (missing = 0)."""
    p = units.groupBy(*by).pivot("type", type_names).agg(F.sum(value))
    cols = [F.coalesce(F.col(t), F.lit(0.0)).alias(prefix + t.lower()) for t in type_names]
    tot = units.groupBy(*by).agg(F.sum(value).alias(prefix + "total"))
    return p.select(*by, *cols).join(tot, by)


def units_pivot_recommended(plan: DataFrame, type_names: list[str]) -> DataFrame:
    """Recommended store units per plan and location by type."""
    return units_pivot(_units(plan, "units"), type_names, "units", "recommended_", ["plan_id", "location"])


def map_recommended(located: DataFrame, plan: DataFrame, locations: DataFrame, type_names: list[str]) -> DataFrame:
    """D17 recommended side (A11-A14, J18): shares times category totals, per plan, location and category.

    Rows are the (category, location) pairs with a forward volume share.  Line-down orders of a
    category are the plan's first LineDownOrders value; location totals take in every pair with a
    unique share; the recommended units of the location are joined.
    """
    totals = located.groupBy("category").agg(
        F.count_if("first_place").cast("double").alias("cat_materials"),
        F.coalesce(F.sum("sku_cubic_ft"), F.lit(0.0)).alias("cat_cubic_ft"))
    first = family(plan, "LineDownOrders").filter("value IS NOT NULL").groupBy(
        "plan_id", F.col("index_1").alias("category")).agg(F.min_by("value", "row_no").alias("cat_ldo"))
    k = ["plan_id", "category", "location"]
    uni = (_pct(plan, "SKUuniquePct", "u").groupBy(*k).agg(F.sum("u").alias("unique_pct"))
           .join(totals.select("category", "cat_materials"), "category", "left").join(first, ["plan_id", "category"], "left")
           .select(*k, (F.col("unique_pct") * F.col("cat_materials")).alias("rec_materials"),
                   (F.col("unique_pct") * F.col("cat_ldo")).alias("rec_ldo")))
    vol = (_pct(plan, "SKUcubicPct", "v").groupBy(*k).agg(F.sum("v").alias("cubic_pct"))
           .join(totals.select("category", "cat_cubic_ft"), "category", "left")
           .select(*k, (F.col("cubic_pct") * F.col("cat_cubic_ft")).alias("rec_cubic_ft")))
    at = ["plan_id", "location"]
    tot = uni.groupBy(*at).agg(F.sum("rec_materials").alias("loc_rec_materials"), F.sum("rec_ldo").alias("loc_rec_ldo"))
    tot = tot.join(vol.groupBy(*at).agg(F.sum("rec_cubic_ft").alias("loc_rec_cubic_ft")), at, "left")
    loc = small(locations.select("location", "lat", "lon", "travel_time"), DIM_MAX_ROWS)
    return (vol.join(uni, k, "left").join(tot, at, "left").join(units_pivot_recommended(plan, type_names), at, "left")
            .join(loc, "location", "left"))


def _mapped(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def map_totals(current: DataFrame) -> DataFrame:
    """Per mapped location (coordinates required): summed measures, max of the per-location columns."""
    return _mapped(current).groupBy("location", "lat", "lon").agg(
        F.sum("material_count").cast("bigint").alias("materials"), F.sum("total_cubic_ft").alias("cubic_ft"),
        F.sum("total_ldo").alias("ldo"), F.max("current_total").alias("units"),
        F.max("travel_time").alias("travel_time"))


def map_totals_recommended(recommended: DataFrame) -> DataFrame:
    """A15, recommended side, per plan."""
    return _mapped(recommended).groupBy("plan_id", "location", "lat", "lon").agg(
        F.sum("rec_materials").alias("materials"), F.sum("rec_cubic_ft").alias("cubic_ft"),
        F.sum("rec_ldo").alias("ldo"), F.max("recommended_total").alias("units"),
        F.max("travel_time").alias("travel_time"))


def map_radius(totals: DataFrame, value: str = "materials") -> DataFrame:
    """marker radius scaled 10..30 over all mapped locations (one tiny aggregate, broadcast back)."""
    mm = totals.agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    j = totals.join(small(mm, 1), F.lit(True), "inner")
    return j.select("location", F.col(value).cast("double").alias("value"),
                    minmax_radius(F.col(value).cast("double"), F.col("_mn").cast("double"),
                                  F.col("_mx").cast("double")).alias("radius"))


def travel_savings(current: DataFrame, recommended: DataFrame, system: DataFrame) -> DataFrame:
    """Line-down travel minutes now vs recommended by each plan, over mapped locations; savings in hours and money."""
    cur = _mapped(current).agg(F.sum(F.col("total_ldo") * F.col("travel_time")).alias("current_minutes"))
    rec = recommended.groupBy("plan_id").agg(F.sum(F.when(
        F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("rec_ldo") * F.col("travel_time")))
        .alias("recommended_minutes"))
    rate = system.agg(F.max("line_down_cost").alias("rate"))
    j = rec.join(small(cur, 1), F.lit(True)).join(small(rate, 1), F.lit(True))
    diff = F.coalesce("current_minutes", F.lit(0.0)) - F.coalesce("recommended_minutes", F.lit(0.0))
    return j.select("plan_id", F.coalesce("current_minutes", F.lit(0.0)).alias("current_minutes"),
                    F.coalesce("recommended_minutes", F.lit(0.0)).alias("recommended_minutes"),
                    (diff / 60.0).alias("saved_hours"), (diff * F.col("rate")).alias("saved_money"))


def map_breakdown(current: DataFrame) -> DataFrame:
    """A17 + O3: per location, categories ordered by material count desc."""
    return current.select("location", "category", "material_count", "total_cubic_ft", "total_ldo") \
        .orderBy("location", F.desc("material_count"), "category")


def map_breakdown_recommended(recommended: DataFrame) -> DataFrame:
    """A17, recommended side: per plan and location, categories ordered by materials desc."""
    return recommended.select("plan_id", "location", "category", "rec_materials", "rec_cubic_ft", "rec_ldo") \
        .orderBy("plan_id", "location", F.desc("rec_materials"), "category")


def map_units_tidy(units_wide: DataFrame, type_names: list[str], prefix: str = "current_") -> DataFrame:
    """One location's (or every location's) unit columns transposed to (type, units)."""
    cols = [prefix + t.lower() for t in type_names]
    return units_wide.unpivot(["location"], cols, "type", "units") \
        .withColumn("type", F.upper(F.substring("type", len(prefix) + 1, 64)))


# --- pivots and tidy forms ---------------------------------------------------------------------------------
def pivot_relocations(plan: DataFrame, type_names: list[str]) -> DataFrame:
    """Origin x destination rows per plan, one column per storage type; unknown destination labelled."""
    r = relocations(plan).withColumn("to_location", F.coalesce("to_location", F.lit("Unknown")))
    p = r.groupBy("plan_id", "from_location", "to_location").pivot("type", type_names).agg(F.sum("units"))
    return p.select("plan_id", "from_location", "to_location",
                    *[F.coalesce(F.col(t), F.lit(0.0)).alias(t.lower()) for t in type_names])


def _pivot(pct: DataFrame, names: list[str]) -> DataFrame:
    p = pct.groupBy("plan_id", "category", "location").pivot("type", names).agg(F.sum("pct"))
    return p.select("plan_id", "category", "location", *[display_percent(F.col(t)).alias(t.lower()) for t in names])


def pivot_forward(plan: DataFrame, type_names: list[str], measure: str = "count") -> DataFrame:
    """Forward % by plan, category and location, one display-formatted column per type; unique or volume shares."""
    return _pivot(_pct(plan, _variable(measure), "pct"), type_names)


def pivot_forward_reserve(plan: DataFrame, type_names: list[str], measure: str = "count") -> DataFrame:
    """U1 + R8: forward rows plus reserve rows (type suffixed _Reserve), pivoted by type; unique or volume shares."""
    r = _pct(plan, _variable(measure, True), "pct").withColumn("type", F.concat("type", F.lit("_Reserve")))
    return _pivot(_pct(plan, _variable(measure), "pct").unionByName(r),
                  list(type_names) + [t + "_Reserve" for t in type_names])


# Sections of a plan's dashboard, and the variables that each sums up: forward ones, then reserve ones.
SECTIONS = {"units": ("StoreUnits", None), "relocations": ("RelocUnits", None), "forward_count": ("SKUuniquePct", None),
            "forward_cubic": ("SKUcubicPct", None), "forward_reserve_count": ("SKUuniquePct", "ResSKUuniquePct"),
            "forward_reserve_cubic": ("SKUcubicPct", "ResSKUcubicPct")}


def plan_sections(plan: DataFrame, type_names: list[str]) -> DataFrame:
    """All sections of a plan from one scan and one aggregate.

    Every variable goes to the sections that show it, each with the row it falls on (``key_1``, ``key_2``: location;
    origin and destination; or category and location) and the column (a type, or a type's reserve); summed by row, all
    columns at once.  One row per plan, section and keys: the type columns, the ``_reserve`` ones, and their total.
    """
    v, i1, i2, i3 = (F.col(c) for c in ("variable", "index_1", "index_2", "index_3"))
    null = F.lit(None).cast("string")

    def at(section, key_1, key_2, kind, suffix=""):
        return F.struct(F.lit(section).alias("section"), key_1.alias("key_1"), key_2.alias("key_2"),
                        F.concat(kind, F.lit(suffix)).alias("col"))

    def place(section: str, reserve: bool) -> F.Column:
        if section == "units":
            return at(section, i2, null, i1)
        if section == "relocations":
            return at(section, i2, F.coalesce(i3, F.lit("Unknown")), i1)
        return at(section, i1, i3, i2, "_Reserve" if reserve else "")

    by_variable: dict[str, list] = {}
    for section, names in SECTIONS.items():
        for reserve, name in enumerate(names):
            if name:
                by_variable.setdefault(name, []).append(place(section, bool(reserve)))
    places = None
    for name, found in by_variable.items():
        places = F.when(v == name, F.array(*found)) if places is None else places.when(v == name, F.array(*found))
    rows = plan.select("plan_id", "value", F.explode(places).alias("p")).select("plan_id", "value", "p.*")
    names = [*type_names, *(t + "_Reserve" for t in type_names)]
    return rows.groupBy("plan_id", "section", "key_1", "key_2").agg(
        *[F.sum(F.when(F.col("col") == n, F.col("value"))).alias(n.lower()) for n in names], F.sum("value").alias("total"))


def plan_pivots(plan: DataFrame, type_names: list[str]) -> dict[str, DataFrame]:
    """The sections of :func:`plan_sections`, written once, each cut out in its own shape."""
    rows = materialize(plan_sections(plan, type_names), "plan_sections")
    plain, reserve = [t.lower() for t in type_names], [f"{t.lower()}_reserve" for t in type_names]

    def cut(section: str) -> DataFrame:
        r = rows.filter(F.col("section") == section)
        if section == "units":
            return r.select("plan_id", F.col("key_1").alias("location"),
                            *[F.coalesce(t, F.lit(0.0)).alias(f"recommended_{t}") for t in plain],
                            F.col("total").alias("recommended_total"))
        if section == "relocations":
            return r.select("plan_id", F.col("key_1").alias("from_location"), F.col("key_2").alias("to_location"),
                            *[F.coalesce(t, F.lit(0.0)).alias(t) for t in plain])
        shown = plain + (reserve if SECTIONS[section][1] else [])
        return r.select("plan_id", F.col("key_1").alias("category"), F.col("key_2").alias("location"),
                        *[display_percent(F.col(t)).alias(t) for t in shown])

    return {section: cut(section) for section in SECTIONS}


def tidy_alloc(report: DataFrame) -> DataFrame:
    """Current / recommended shares as (metric, value) rows with a segment label."""
    keys = ["plan_id", *KEYS]
    long = report.select(*keys, "current_pct", "recommended_pct").unpivot(
        keys, ["current_pct", "recommended_pct"], "metric", "value")
    label = F.when(F.col("metric") == "current_pct", "Current").otherwise("Recommended")
    return long.select(*keys, label.alias("metric"), "value",
                       F.concat_ws(" - ", label, F.col("type")).alias("segment"))


def tidy_units(units: DataFrame) -> DataFrame:
    """Current / recommended units per plan, type and location as tidy rows."""
    keys = ["plan_id", "type", "location"]
    long = units.unpivot(keys, ["current_units", "recommended_units"], "metric", "units")
    return long.select(*keys, F.when(F.col("metric") == "current_units", "Current").otherwise("Recommended")
                       .alias("metric"), "units")


def tidy_phase_percent(alloc: DataFrame, fwd_res: DataFrame) -> DataFrame:
    """Per plan and (category, type, location) three rows: Current, Forward, Reserve; either measure."""
    keys = ["plan_id", *KEYS]
    j = alloc.select(*keys, "current_pct").join(fwd_res.select(*keys, "forward_pct", "reserve_pct"), keys, "full_outer")
    return j.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("phase"), F.coalesce(col, F.lit(0.0)).alias("pct"))
        for name, col in (("Current", "current_pct"), ("Forward", "forward_pct"), ("Reserve", "reserve_pct"))]))
        .alias("r")).select(*keys, "r.phase", "r.pct")
