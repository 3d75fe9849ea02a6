"""Plan audits on tiny plans, and the two fixture plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001
from stowage.plans import audit as au
from stowage.plans import reports as rep

PLAN = "plan_id string, variable string, index_1 string, index_2 string, index_3 string, index_4 string, value double, row_no long"


def plan(spark, *rows):
    return spark.createDataFrame([(p, v, *(list(ix) + [None] * (4 - len(ix))), x, k)
                                  for k, (p, v, ix, x) in enumerate(rows)], PLAN)


def test_budget_leaves_self_relocations_out(spark):
    types = spark.createDataFrame([("A", 1.0, 250000.0)], "type string, buy_cost double, reloc_cost double")
    system = spark.createDataFrame([(1000.0,)], "plan_budget double")
    p = plan(spark, ("x", "RelocUnits", ("A", "N", "N"), 100.0), ("y", "RelocUnits", ("A", "N", "S"), 100.0))
    assert {r.plan_id: (r.lhs, r.violated) for r in au.budget(p, types, system).collect()} == {
        "x": (0.0, 0), "y": (12_500_000.0, 1)}


def test_flow_reports_pairs_without_store_units(spark):
    lt = spark.createDataFrame([("A", "N", 3.0)], "type string, location string, current_units double")
    p = plan(spark, ("x", "BuyUnits", ("A", "S"), 5.0), ("x", "StoreUnits", ("A", "N"), 3.0))
    got = {(r.key_1, r.key_2): (r.lhs, r.rhs, r.violated) for r in au.flow(p, lt).collect()}
    assert got == {("A", "N"): (3.0, 3.0, 0), ("A", "S"): (0.0, 5.0, 1)}


def test_rules_over_full_index_sets(spark):
    cats = spark.createDataFrame([("c1",), ("c2",)], "category string")
    techs = spark.createDataFrame([("T",)], "tech_name string")
    p = plan(spark, ("x", "SKUuniquePct", ("c1", "A", "N"), 1.0), ("x", "SKUcubicPct", ("c1", "A", "N"), 1.0),
             ("x", "AllocFracUnique", ("c1", "A", "N", "T"), 1.0))
    for rows in (au.cover_unique(p, cats), au.cover_volume(p, cats), au.alloc_total(p, cats, techs)):
        assert {r.key_1: r.violated for r in rows.collect()} == {"c1": 0, "c2": 1}


def test_allocation_on_incompatible_type(spark):
    ct = spark.createDataFrame([("c1", "A", 0)], "category string, type string, compatible_strict int")
    p = plan(spark, ("x", "AllocFracUnique", ("c1", "A", "N", "T"), 0.5))
    r = au.type_category(p, ct).first()
    assert (r.rule, r.key_4, r.violated) == ("type_category_alloc", "T", 1)


def test_plans_are_not_added_together(spark):
    p = plan(spark, ("x", "SKUuniquePct", ("c1", "ECONOMY", "N"), 0.5), ("y", "SKUuniquePct", ("c1", "ECONOMY", "N"), 0.25))
    assert sorted((r.plan_id, r.economy) for r in rep.pivot_forward(p, ["ECONOMY"]).collect()) == [("x", 0.5), ("y", 0.25)]
    assert set(rep.plan_pivots(p, ["ECONOMY"])) == {"units", "relocations", "forward_count", "forward_cubic",
                                                     "forward_reserve_count", "forward_reserve_cubic"}


def test_sections_come_from_one_scan_and_one_exchange(spark):
    p = plan(spark, ("x", "SKUuniquePct", ("c1", "ECONOMY", "N"), 0.5), ("x", "ResSKUuniquePct", ("c1", "ECONOMY", "N"), 0.25),
             ("x", "RelocUnits", ("ECONOMY", "N", None), 2.0), ("x", "StoreUnits", ("ECONOMY", "N"), 4.0))
    assert rep.plan_sections(p, ["ECONOMY"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {n: [tuple(r) for r in df.collect()] for n, df in rep.plan_pivots(p, ["ECONOMY"]).items()}
    assert got == {"units": [("x", "N", 4.0, 4.0)], "relocations": [("x", "N", "Unknown", 2.0)],
                   "forward_count": [("x", "c1", "N", 0.5)], "forward_cubic": [],
                   "forward_reserve_count": [("x", "c1", "N", 0.5, 0.25)], "forward_reserve_cubic": []}


def test_audit_state_reads_the_plan_once(spark):
    """Every rule of a plan with keys named twice, from one aggregate of the plan."""
    from stowage.plans import audit_pass as ap

    p = plan(spark, *(("x", v, ("c1", "A", "N"), x) for v, x in (("SKUuniquePct", 0.5), ("SKUuniquePct", 0.25), ("SKUcubicPct", 1.0),
                                                               ("SKUStoreUnits", 2.0), ("SKUStoreUnits", 3.0))),
             ("x", "RelocUnits", ("A", "N", "N"), 1.0), ("x", "objective value", (), 7.0))
    state = ap.plan_state(p)
    assert state._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    cell = state.filter("category = 'c1'").first()
    assert sorted(x.v for x in cell.uniq) == [0.25, 0.5] and sorted(x.v for x in cell.units) == [2.0, 3.0] and cell.alloc == []
    assert [x.v for x in state.filter("category IS NULL AND type = 'A'").first().own] == [1.0]


def test_first_line_down_value_of_a_category(spark):
    located = spark.createDataFrame([("m", "c1", 100.0, 2.0, True)], "material string, category string, line_down_orders double, "
                                    "sku_cubic_ft double, first_place boolean")
    loc = spark.createDataFrame([("N", 1.0, 1.0, 5.0)], "location string, lat double, lon double, travel_time double")
    p = plan(spark, ("x", "SKUuniquePct", ("c1", "ECONOMY", "N"), 0.5), ("x", "SKUcubicPct", ("c1", "ECONOMY", "N"), 1.0),
             ("x", "LineDownOrders", ("c1", "T", "1"), 7.0), ("x", "LineDownOrders", ("c1", "T", "2"), 9.0),
             ("x", "StoreUnits", ("ECONOMY", "N"), 4.0))
    r = rep.map_recommended(located, p, loc, ["ECONOMY"]).first()
    assert (r.rec_ldo, r.rec_materials, r.rec_cubic_ft, r.recommended_economy) == (3.5, 0.5, 2.0, 4.0)


def test_materials_of_a_shared_code_count_once(spark):
    """A code that names two rows gives a part two cells, but the part is one material of its category."""
    lt = spark.createDataFrame([(1, 1, "B1", 1), (2, 1, "B1", 1), (2, 2, "B1", 1)],
                               "location_id int, type_id int, code string, current_units int")
    named = rep.location_type_named(lt, spark.createDataFrame([(1, "L1"), (2, "L2")], "location_id int, location string"),
                                    spark.createDataFrame([(1, "ECONOMY"), (2, "SMALL")], "type_id int, type string"))
    parts = spark.createDataFrame([("a", "c1", "B1", 1.0, 5.0), ("b", "c1", "B1", 1.0, 5.0), ("c", "c1", "??", 1.0, 5.0)],
                                  "material string, category string, storage_type string, line_down_orders double, sku_cubic_ft double")
    located = rep.parts_located(parts, named)
    p = plan(spark, ("x", "SKUuniquePct", ("c1", "ECONOMY", "L1"), 0.5))
    got = {(r.type, r.location): (r.current_count, r.total_count, round(r.current_pct, 6))
           for r in rep.alloc_report(located, p, "count").collect()}
    assert got == dict.fromkeys([("ECONOMY", "L1"), ("ECONOMY", "L2"), ("SMALL", "L2")], (2.0, 3.0, 0.666667))
    geo = spark.createDataFrame([("L1", 1.0, 1.0, 5.0), ("L2", 1.0, 1.0, 5.0)], "location string, lat double, lon double, travel_time double")
    cur = {r.location: (r.material_count, r.loc_total_materials) for r in rep.map_current(located, named, geo, ["ECONOMY", "SMALL"]).collect()}
    assert cur == {"L1": (2, 2), "L2": (2, 2)}
    full = plan(spark, ("x", "SKUuniquePct", ("c1", "ECONOMY", "L1"), 1.0), ("x", "SKUcubicPct", ("c1", "ECONOMY", "L1"), 1.0),
                ("x", "StoreUnits", ("ECONOMY", "L1"), 1.0))
    assert rep.map_recommended(located, full, geo, ["ECONOMY", "SMALL"]).first().rec_materials == 3.0


@pytest.mark.parametrize("rule", ["budget", "space", "flow", "units_split", "cover_volume", "cover_unique", "share_ratio",
                                  "type_category", "tech_location", "alloc_total", "sku_capacity", "reserve_location"])
def test_every_rule_holds_and_breaks(spark, rule):
    seen = {r.violated for r in entry.queries()[f"audit_{rule}"](spark, SF001).select("violated").distinct().collect()}
    assert seen == {0, 1}


def test_parts_key_is_unique(spark):
    """Counts of materials per group stand for distinct counts because parts has one row per material."""
    parts = entry.queries()["parts_normalized"](spark, SF001)
    assert parts.count() == parts.select("material").distinct().count()
    assert parts.filter(F.col("material").isNull()).count() == 0


def test_sets_of_empty_tables_fall_back(spark):
    from stowage.plans import params as pm

    parts = spark.createDataFrame([], "priority string, movement string")
    sizes = spark.createDataFrame([], "size string")
    locs = spark.createDataFrame([], "location string, location_priority int")
    types, techs = spark.createDataFrame([("t",)], "type string"), spark.createDataFrame([("u",)], "tech_name string")
    prio = spark.createDataFrame([(1, 1)], "location_priority int, reserve_allowed int")
    grid = spark.createDataFrame([("HHS",)], "category string")
    got = {}
    for r in pm.model_sets(parts, sizes, locs, types, techs, prio, grid).collect():
        got.setdefault(r.set_name, set()).add(r.member)
    assert got == {"priority": set("HML"), "movement": set("HML"), "sizes": set("SML"), "priorities": {"1"},
                   "types": {"t"}, "users": {"u"}, "skus": {"HHS"}}
