"""All audit rules from one pass over the plans.

The plan table is read once: one aggregate brings every variable of a (plan, category, type, location) together in a
row, and the units, buys and moves of a (plan, type, location) in another (:func:`plan_state`).  The rules of a cell are
then rows that it emits by itself, with the category and dimension values it needs joined to it; rules over coarser
keys are aggregates of these rows, whose number is bounded by categories x types x locations for each plan.

The values of one variable are kept as lists, so that a plan that names a key twice is audited as the single rules
audit it.  :mod:`stowage.plans.audit` states the single rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators.categories import CATEGORY_BOUND
from stowage.operators.curves import interpolate
from stowage.operators.joins import small
from stowage.plans.audit import EPS, OUT, SHARE_RATIO, UNITS_PER_COMPATIBLE, ld_increment
from stowage.session import materialize
from stowage.sources.fixtures import DIM_MAX_ROWS

# Variables by (category, type, location), and by (type, location).
CELL = {"SKUuniquePct": "uniq", "SKUcubicPct": "cubic", "ResSKUuniquePct": "runiq", "ResSKUcubicPct": "rcubic",
        "SKUStoreUnits": "units"}
STORE = {"StoreUnits": "store", "BuyUnits": "buy"}
KEYS = ["plan_id", "category", "type", "location"]


def _zero() -> Column:
    return F.lit(0.0)


def plan_state(plan: DataFrame) -> DataFrame:
    """One row per (plan, category, type, location), category null for units, buys and moves; lists of values by variable.

    A move counts as ``out`` where it starts and ``inb`` where it ends, and as ``own`` where both are the same.
    """
    v, i1, i2, i3, i4 = (F.col(c) for c in ("variable", "index_1", "index_2", "index_3", "index_4"))
    none = F.lit(None).cast("string")

    def at(field, category, kind, location, tech=none):
        return F.struct(field.alias("field"), category.alias("category"), kind.alias("type"), location.alias("location"),
                        tech.alias("tech"))

    cell = F.create_map(*[F.lit(x) for p in (CELL | STORE).items() for x in p])[v]
    places = (F.when(v.isin(*CELL), F.array(at(cell, i1, i2, i3)))
              .when(v == "AllocFracUnique", F.array(at(F.lit("alloc"), i1, i2, i3, i4)))
              .when(v.isin(*STORE), F.array(at(cell, none, i1, i2)))
              .when((v == "RelocUnits") & (i2 == i3), F.array(at(F.lit("own"), none, i1, i2)))
              .when((v == "RelocUnits") & (i2 != i3), F.array(at(F.lit("out"), none, i1, i2), at(F.lit("inb"), none, i1, i3)))
              .otherwise(F.array(at(F.lit("other"), none, none, none))))  # every plan has a row
    rows = plan.select("plan_id", "value", F.explode(places).alias("p")).select("plan_id", "value", "p.*")
    field, one = F.col("field"), F.struct(F.col("value").alias("v"))  # a struct, so that null values stay
    lists = [F.collect_list(F.when(field == n, one)).alias(n) for n in (*CELL.values(), *STORE.values(), "own")]
    sums = [F.sum(F.when(field == n, F.col("value"))).alias(n) for n in ("inb", "out")]
    counts = [F.count_if(field == n).alias(f"n_{n}") for n in ("inb", "out")]
    alloc = F.collect_list(F.when(field == "alloc", F.struct("tech", F.col("value").alias("v")))).alias("alloc")
    return rows.groupBy(*KEYS).agg(*lists, *sums, *counts, alloc)


def _row(rule: str, keys: list, lhs, rhs, sense: str) -> Column:
    ks = [k.cast("string") for k in keys] + [F.lit(None).cast("string")] * (4 - len(keys))
    return F.struct(F.lit(rule).alias("rule"), *[k.alias(f"key_{i}") for i, k in enumerate(ks, 1)],
                    lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), F.lit(sense).alias("sense"))


def _or_null(values: Column) -> Column:
    """The list, or one null in place of an empty one: the side of an outer join that has no row."""
    return F.when(F.size(values) == 0, F.array(F.lit(None).cast("struct<v:double>"))).otherwise(values)


def _emit(df: DataFrame, rows: list[Column]) -> DataFrame:
    """(plan_id, rule row) of every row that a frame's rows emit."""
    return df.select("plan_id", F.explode(F.concat(*rows)).alias("r")).select("plan_id", "r.*")


def _if(cond: Column, rows: Column) -> Column:
    return F.when(cond, rows).otherwise(F.slice(rows, 1, 0))


def cells(state: DataFrame, cats: DataFrame, cat_type: DataFrame, cat_tech: DataFrame, types: DataFrame,
          loc_reserve: DataFrame, tech_loc: DataFrame) -> DataFrame:
    """Cells with the category and dimension values that their rules need; each of those tables is a bounded one."""
    ct = cat_tech.groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("tech_name", "num_sku"))).alias("tech_sku"))  # a row per technology
    tl = tech_loc.groupBy("location").agg(F.collect_set("tech").alias("ok_techs"))
    c = (state.filter(F.col("category").isNotNull())
         .join(small(cats.select("category", "num_sku", "sku_cubic_ft", "min_vol", F.lit(True).alias("known")), CATEGORY_BOUND),
               "category", "left")
         .join(cat_type.select("category", "type", "max_sku_per_unit", "compatible_strict", "penalty"), ["category", "type"], "left")
         .join(small(types.select("type", "cubic_capacity"), DIM_MAX_ROWS), "type", "left")
         .join(small(loc_reserve.select("location", F.col("reserve_allowed").cast("double").alias("ra")), DIM_MAX_ROWS),
               "location", "left")
         .join(small(tl, DIM_MAX_ROWS), "location", "left").join(small(ct, CATEGORY_BOUND), "category", "left"))

    def pairs(kind: str, a: str, b: str) -> Column:
        both = F.flatten(F.transform(_or_null(F.col(a)), lambda x: F.transform(_or_null(F.col(b)), lambda y: F.struct(
            F.lit(kind).alias("kind"), F.coalesce(x["v"], _zero()).alias("uniq"), F.coalesce(y["v"], _zero()).alias("cubic")))))
        return F.when(F.size(a) + F.size(b) > 0, both).otherwise(F.slice(both, 1, 0))

    shares = F.concat(pairs("forward", "uniq", "cubic"), pairs("reserve", "runiq", "rcubic"))
    need = F.when(F.col("known"), F.transform("uniq", lambda x: F.struct((x["v"] * F.col("num_sku")).alias("v")))) \
        .otherwise(F.slice("uniq", 1, 0))
    alloc = F.transform("alloc", lambda a: F.struct(a["tech"].alias("tech"), a["v"].alias("v"), (
        a["v"] * F.coalesce(F.try_element_at("tech_sku", a["tech"]), _zero())).alias("sku")))
    return c.withColumn("shares", shares).withColumn("need", need).withColumn("alloc", alloc)


def cell_rules(c: DataFrame, n_tech: int) -> DataFrame:
    """Every row that a cell emits by itself."""
    k = [F.col("category"), F.col("type"), F.col("location")]
    known, num = F.coalesce("known", F.lit(False)), F.col("num_sku")
    strict, ra = F.coalesce("compatible_strict", F.lit(0)).cast("double"), F.coalesce("ra", _zero())

    def each(values, rule, lhs, rhs, sense, key=None):
        return F.transform(values, lambda x: _row(rule, k + ([key(x)] if key else []), lhs(x), rhs(x), sense))

    kind = lambda s: s["kind"]
    capacity = F.flatten(F.transform("shares", lambda s: F.transform(_or_null(F.col("units")), lambda u: _row(
        "sku_capacity", k + [s["kind"]], F.coalesce(u["v"], _zero()) * F.coalesce("max_sku_per_unit", _zero()), num * s["uniq"], "ge"))))
    reserve = F.flatten(F.transform(F.filter("shares", lambda s: s["kind"] == "reserve"), lambda s: F.array(
        _row("reserve_location", k + [F.lit("unique")], s["uniq"], ra, "le"),
        _row("reserve_location", k + [F.lit("cubic")], s["cubic"], ra, "le"))))
    cubic = F.aggregate("shares", _zero(), lambda acc, s: acc + s["cubic"])
    total = F.aggregate("alloc", _zero(), lambda acc, a: acc + F.coalesce(a["sku"], _zero()))
    limit = F.flatten(F.transform("alloc", lambda a: F.transform(_or_null(F.col("need")), lambda n: _row(
        "alloc_limit", k + [a["tech"]], a["sku"], F.coalesce(n["v"], _zero()), "le"))))
    some = F.size("alloc") + F.size("need") > 0
    return _emit(c, [
        each("shares", "share_ratio", lambda s: s["cubic"], lambda s: F.lit(SHARE_RATIO) * s["uniq"], "le", kind),
        _if(known, each("shares", "min_volume", lambda s: F.col("sku_cubic_ft") * s["cubic"],
                        lambda s: s["uniq"] * num * F.col("min_vol"), "ge", kind)),
        _if(known, capacity), reserve,
        _if(F.size("units") + F.size("shares") > 0, each(
            _or_null(F.col("units")), "volume", lambda u: F.coalesce(u["v"], _zero()) * F.coalesce("cubic_capacity", _zero()),
            lambda u: F.coalesce("sku_cubic_ft", _zero()) * cubic, "ge")),
        each("units", "type_category_units", lambda u: u["v"], lambda u: F.lit(UNITS_PER_COMPATIBLE) * strict, "le"),
        each("alloc", "type_category_alloc", lambda a: a["v"], lambda a: strict, "le", lambda a: a["tech"]),
        each("alloc", "tech_location", lambda a: a["v"], lambda a: F.when(
            F.array_contains(F.coalesce("ok_techs", F.array().cast("array<string>")), a["tech"]), 1.0).otherwise(_zero()),
            "le", lambda a: a["tech"]),
        limit,
        _if(some, each(_or_null(F.col("need")), "alloc_cover", lambda n: total, lambda n: F.coalesce(n["v"], _zero()), "ge")),
        _if(some, each(_or_null(F.col("need")), "alloc_capacity", lambda n: total,
                       lambda n: F.lit(float(n_tech)) * F.coalesce(n["v"], _zero()), "le"))])


def store_rules(state: DataFrame, c: DataFrame, plans: DataFrame, lt_named: DataFrame) -> DataFrame:
    """Units, buys and moves of a (type, location) against its current units and its categories' units."""
    at = ["plan_id", "type", "location"]
    split = c.filter(F.size("units") > 0).select(*at, F.aggregate("units", _zero(), lambda s, u: s + u["v"]).alias("split")) \
        .groupBy(*at).agg(F.sum("split").alias("split"))
    cur = lt_named.groupBy("type", "location").agg(F.sum("current_units").alias("cur"))
    every = plans.crossJoin(small(cur, DIM_MAX_ROWS))
    own = state.filter(F.col("category").isNull() & F.col("type").isNotNull()).select(
        *at, "store", "buy", "own", "inb", "out", "n_inb", "n_out")
    j = own.join(split, at, "full_outer").join(every, at, "full_outer")
    empty = F.array().cast("array<struct<v:double>>")
    for name in ("store", "buy", "own"):
        j = j.withColumn(name, F.coalesce(name, empty))
    k = [F.col("type"), F.col("location")]
    moved = F.coalesce("n_inb", F.lit(0)) + F.coalesce("n_out", F.lit(0))
    named = (F.size("store") + F.size("buy") + moved > 0) | F.col("cur").isNotNull()
    flow = F.flatten(F.transform(_or_null(F.col("store")), lambda s: F.transform(_or_null(F.col("buy")), lambda b: _row(
        "flow", k, F.coalesce(s["v"], _zero()), F.coalesce("cur", _zero()) + F.coalesce(b["v"], _zero()) + F.coalesce("inb", _zero())
        - F.coalesce("out", _zero()), "eq"))))
    halves = F.transform(_or_null(F.col("store")), lambda s: _row(
        "units_split", k, F.coalesce(s["v"], _zero()), F.coalesce("split", _zero()), "eq"))
    return _emit(j, [_if(named, flow), _if((F.size("store") > 0) | F.col("split").isNotNull(), halves),
                     F.transform("own", lambda x: _row("self_reloc", k, x["v"], _zero(), "eq"))])


def sum_rules(state: DataFrame, c: DataFrame, plans: DataFrame, cats: DataFrame, techs: DataFrame, types: DataFrame,
              locations: DataFrame, system: DataFrame) -> DataFrame:
    """Sums over a plan's categories, locations and technologies, 0 where it has none."""
    def added(values: str) -> Column:
        return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x["v"], s, x["v"]))

    per_cat = c.groupBy("plan_id", "category").agg(
        F.sum(added("uniq")).alias("unique"),
        F.sum(F.coalesce(added("cubic") + added("rcubic"), added("cubic"), added("rcubic"))).alias("volume"))
    every_cat = plans.crossJoin(small(cats.select("category"), CATEGORY_BOUND))
    key = F.col("category")
    cover = _emit(every_cat.join(per_cat, ["plan_id", "category"], "left"), [F.array(
        _row("cover_volume", [key], F.coalesce("volume", _zero()), F.lit(1.0), "eq"),
        _row("cover_unique", [key], F.coalesce("unique", _zero()), F.lit(1.0), "ge"))])
    by_tech = c.select("plan_id", "category", F.explode("alloc").alias("a")).groupBy(
        "plan_id", "category", F.col("a.tech").alias("tech")).agg(F.sum("a.v").alias("s"))
    every_tech = every_cat.crossJoin(small(techs.select(F.col("tech_name").alias("tech")), DIM_MAX_ROWS))
    total = _emit(every_tech.join(by_tech, ["plan_id", "category", "tech"], "left"), [F.array(
        _row("alloc_total", [key, F.col("tech")], F.coalesce("s", _zero()), F.lit(1.0), "eq"))])
    store = (state.filter(F.col("category").isNull()).join(
        small(types.select("type", "buy_cost", "reloc_cost", "sqft_req"), DIM_MAX_ROWS), "type")
        .select("plan_id", "location", (added("store") * F.col("sqft_req")).alias("used"),
                (added("buy") * F.col("buy_cost")).alias("bought"),
                (F.col("out") * F.col("reloc_cost") / 2).alias("moved")))
    limits = small(system.agg(F.max("plan_budget").alias("budget"), F.max("space_factor").alias("sf")), 1)
    used = store.groupBy("plan_id", "location").agg(F.sum("used").alias("used"))
    space = plans.crossJoin(small(locations.select("location", "floor_space"), DIM_MAX_ROWS)).join(
        used, ["plan_id", "location"], "left").join(limits, F.lit(True))
    spent = store.groupBy("plan_id").agg(F.sum("bought").alias("bought"), F.sum("moved").alias("moved"))
    budget = plans.join(spent, "plan_id", "left").join(limits, F.lit(True))
    rows = [cover, total,
            _emit(space, [F.array(_row("space", [F.col("location")], F.coalesce("used", _zero()),
                                       F.col("floor_space") * F.col("sf"), "le"))]),
            _emit(budget, [F.array(_row("budget", [], F.coalesce("bought", _zero()) + F.coalesce("moved", _zero()),
                                        F.col("budget"), "le"))])]
    return reduce(lambda a, b: a.unionByName(b), rows)


def judged(rows: DataFrame) -> DataFrame:
    """The common shape: how far a row is from its limit (negative beyond it), and whether it breaks the rule."""
    lhs, rhs, sense = F.col("lhs"), F.col("rhs"), F.col("sense")
    slack = F.when(sense == "le", rhs - lhs).when(sense == "ge", lhs - rhs).when(sense == "eq", 0 - F.abs(lhs - rhs))
    bad = F.when(sense == "le", lhs > rhs + EPS).when(sense == "ge", lhs < rhs - EPS).when(sense == "eq", F.abs(lhs - rhs) > EPS)
    return rows.withColumn("slack", slack).withColumn("violated", F.when(bad, 1).otherwise(0)).select(*OUT)


def audit_all(plan: DataFrame, cats: DataFrame, cat_type: DataFrame, cat_tech: DataFrame, types: DataFrame, techs: DataFrame,
              locations: DataFrame, loc_reserve: DataFrame, tech_loc: DataFrame, system: DataFrame,
              lt_named: DataFrame) -> DataFrame:
    """C6-C23 of every plan, from one scan of the plan table: the rows of all single rules."""
    state = materialize(plan_state(plan), "plan_state")
    plans = state.select("plan_id").distinct()
    c = cells(state, cats, cat_type, cat_tech, types, loc_reserve, tech_loc)
    n_tech = techs.count()  # a dimension
    rows = [cell_rules(c, n_tech), store_rules(state, c, plans, lt_named),
            sum_rules(state, c, plans, cats, techs, types, locations, system)]
    return judged(reduce(lambda a, b: a.unionByName(b), rows))


def objective_terms(plan: DataFrame, cats: DataFrame, cat_type: DataFrame, cat_tech: DataFrame, types: DataFrame,
                    techs: DataFrame, locations: DataFrame, loc_reserve: DataFrame, tech_loc: DataFrame, system: DataFrame,
                    priorities: DataFrame, fwd_points: DataFrame, res_points: DataFrame) -> DataFrame:
    """C1-C5 with C24 and C25 of every plan, from the same state: (plan_id, term, value)."""
    state = materialize(plan_state(plan), "plan_state")
    plans = state.select("plan_id").distinct()
    c = cells(state, cats, cat_type, cat_tech, types, loc_reserve, tech_loc)

    def added(values: str) -> Column:
        return F.aggregate(values, _zero(), lambda s, x: s + F.coalesce(x["v"], _zero()))

    store = state.filter(F.col("category").isNull()).join(
        small(types.select("type", "buy_invest", "reloc_invest"), DIM_MAX_ROWS), "type")
    spent = store.groupBy("plan_id").agg(F.sum(added("buy") * F.col("buy_invest")).alias("buy"),
                                         F.sum(F.col("out") * F.col("reloc_invest") / 2).alias("relocation"))
    penalty = c.groupBy("plan_id").agg(F.sum(F.col("penalty") * added("units")).alias("penalty"))
    # Materials within reach of each priority, for every category and technology
    prio = small(priorities.select(F.col("location_priority").alias("p"), "travel_time"), DIM_MAX_ROWS)
    reach = (c.select(*KEYS, F.explode("alloc").alias("a"))
             .join(small(locations.select("location", "location_priority"), DIM_MAX_ROWS), "location")
             .join(prio, F.col("location_priority") <= F.col("p"))
             .groupBy("plan_id", "category", F.col("a.tech").alias("tech"), "p").agg(F.sum("a.sku").alias("x_eval")))
    every_cat = plans.crossJoin(small(cats.select("category"), CATEGORY_BOUND))
    every = every_cat.crossJoin(small(techs.select(F.col("tech_name").alias("tech")), DIM_MAX_ROWS)).crossJoin(prio)
    cum = interpolate(fwd_points, every.join(reach, ["plan_id", "category", "tech", "p"], "left")
                      .withColumn("x_eval", F.coalesce("x_eval", _zero())), "x_eval")
    rates = small(system.agg(F.max("line_down_cost").alias("ldc"), F.max("reserve_cost").alias("rc")), 1)
    down = ld_increment(cum).join(rates, F.lit(True)).groupBy("plan_id").agg(
        F.sum(F.col("ldc") * F.col("travel_time") * F.col("inc")).alias("line_down"))
    # Reserve materials of every category and location
    kept = c.filter(F.col("known")).groupBy("plan_id", "category", "location").agg(
        F.sum(added("runiq") * F.col("num_sku")).alias("x_eval"))
    held = (every_cat.crossJoin(small(locations.select("location"), DIM_MAX_ROWS))
            .join(kept, ["plan_id", "category", "location"], "left")
            .withColumn("x_eval", F.coalesce("x_eval", _zero())).withColumn("tech", F.lit("")))
    orders = interpolate(res_points, held, "x_eval").join(
        small(cats.select("category", "line_down_orders"), CATEGORY_BOUND), "category").join(rates, F.lit(True))
    reserve = orders.groupBy("plan_id").agg(
        F.sum(F.col("rc") / (F.col("line_down_orders") + 1) * F.col("y_eval")).alias("reserve"))
    wide = plans
    for part in (spent, down, reserve, penalty):
        wide = wide.join(part, "plan_id", "left")
    terms = ["buy", "relocation", "line_down", "reserve", "penalty"]
    total = reduce(lambda a, b: a + b, [F.coalesce(t, _zero()) for t in terms])
    return wide.withColumn("total", total).select("plan_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.coalesce(t, _zero()).alias("value")) for t in (*terms, "total")])).alias("t")) \
        .select("plan_id", "t.*")
