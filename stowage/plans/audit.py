"""Plan audit (C1-C25): the planning model's objective terms and constraints, evaluated on a plan.

Every rule returns rows of one shape:
``plan_id, rule, key_1..key_4, lhs, rhs, slack, violated`` (violated = 0/1; slack is the
distance to the limit, negative beyond it), so many plans can be scored in one job;
:mod:`stowage.plans.audit_pass` scores all rules from one scan of the plans.  Inputs are the plan table plus
the category tables (aggregates of the parts table) and dimensions.  Rules that the
planning model states for every index are evaluated over the full index sets, so
what a plan leaves out shows as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.curves import interpolate
from stowage.operators.joins import small
from stowage.operators.categories import CATEGORY_BOUND
from stowage.plans.plan_vars import family, plan_ids
from stowage.sources.fixtures import DIM_MAX_ROWS

# Tolerance for equality/inequality checks, cap on units per compatible
# (category, type), and the allowed ratio of volume share to unique share.
EPS = 1e-6
UNITS_PER_COMPATIBLE = 1000.0
SHARE_RATIO = 1.2

OUT = ["plan_id", "rule", "key_1", "key_2", "key_3", "key_4", "lhs", "rhs", "slack", "violated"]


def _out(df: DataFrame, rule: str, keys: list, lhs, rhs, sense: str) -> DataFrame:
    """sense: 'le' (lhs <= rhs), 'ge', 'eq' or 'info' (no check)."""
    if sense == "le":
        bad, slack = lhs > rhs + EPS, rhs - lhs
    elif sense == "ge":
        bad, slack = lhs < rhs - EPS, lhs - rhs
    elif sense == "eq":
        bad, slack = F.abs(lhs - rhs) > EPS, 0 - F.abs(lhs - rhs)
    else:
        bad, slack = F.lit(False), F.lit(None)
    ks = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    ks += [F.lit(None).cast("string")] * (4 - len(ks))
    return df.select(F.col("plan_id"), F.lit(rule).alias("rule"),
                     *[k.alias(f"key_{i}") for i, k in enumerate(ks, 1)],
                     lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), slack.cast("double").alias("slack"),
                     F.when(bad, 1).otherwise(0).alias("violated"))


def _v3(plan: DataFrame, variable: str, name: str) -> DataFrame:
    return family(plan, variable).select("plan_id", F.col("index_1").alias("category"),
                                         F.col("index_2").alias("type"), F.col("index_3").alias("location"),
                                         F.col("value").alias(name))


def _v2(plan: DataFrame, variable: str, name: str) -> DataFrame:
    return family(plan, variable).select("plan_id", F.col("index_1").alias("type"),
                                         F.col("index_2").alias("location"), F.col("value").alias(name))


def _alloc(plan: DataFrame) -> DataFrame:
    return family(plan, "AllocFracUnique").select(
        "plan_id", F.col("index_1").alias("category"), F.col("index_2").alias("type"),
        F.col("index_3").alias("location"), F.col("index_4").alias("tech"), F.col("value").alias("alloc"))


def self_reloc(plan: DataFrame) -> DataFrame:
    """C9."""
    r = family(plan, "RelocUnits").filter(F.col("index_2") == F.col("index_3"))
    return _out(r, "self_reloc", ["index_1", "index_2"], F.col("value"), F.lit(0.0), "eq")


def budget(plan: DataFrame, types: DataFrame, system: DataFrame) -> DataFrame:
    """Purchase cost plus half the relocation cost within the budget."""
    t = small(types.select("type", "buy_cost", "reloc_cost"), DIM_MAX_ROWS)
    buy = family(plan, "BuyUnits").join(t, F.col("index_1") == t.type).groupBy("plan_id") \
        .agg(F.sum(F.col("value") * F.col("buy_cost")).alias("c"))
    rel = family(plan, "RelocUnits").filter(F.col("index_2") != F.col("index_3")) \
        .join(t, F.col("index_1") == t.type).groupBy("plan_id") \
        .agg(F.sum(F.col("value") * F.col("reloc_cost") / 2).alias("c"))
    cost = plan_ids(plan).join(buy, "plan_id", "left").join(rel.withColumnRenamed("c", "r"), "plan_id", "left")
    sysv = small(system.agg(F.max("plan_budget").alias("budget")), 1)
    j = cost.join(sysv, F.lit(True))
    return _out(j, "budget", [], F.coalesce("c", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)), F.col("budget"), "le")


def space(plan: DataFrame, types: DataFrame, locations: DataFrame, system: DataFrame) -> DataFrame:
    """C11: floor space used by store units within the usable floor space per location."""
    s = _v2(plan, "StoreUnits", "units").join(small(types.select("type", "sqft_req"), DIM_MAX_ROWS), "type")
    used = s.groupBy("plan_id", "location").agg(F.sum(F.col("units") * F.col("sqft_req")).alias("used"))
    cap = locations.select("location", "floor_space").join(
        small(system.agg(F.max("space_factor").alias("sf")), 1), F.lit(True))
    j = plan_ids(plan).crossJoin(small(cap, DIM_MAX_ROWS)).join(used, ["plan_id", "location"], "left")
    return _out(j, "space", ["location"], F.coalesce("used", F.lit(0.0)), F.col("floor_space") * F.col("sf"), "le")


def units_split(plan: DataFrame) -> DataFrame:
    """Store units equal the sum of the per-category units."""
    st = _v2(plan, "StoreUnits", "units")
    sk = _v3(plan, "SKUStoreUnits", "u").groupBy("plan_id", "type", "location").agg(F.sum("u").alias("split"))
    j = st.join(sk, ["plan_id", "type", "location"], "full_outer")
    return _out(j, "units_split", ["type", "location"], F.coalesce("units", F.lit(0.0)),
                F.coalesce("split", F.lit(0.0)), "eq")


def flow(plan: DataFrame, lt_named: DataFrame) -> DataFrame:
    """store = current + buys + inbound - outbound, for every (type, location) that any of them names."""
    st = _v2(plan, "StoreUnits", "units")
    buy = _v2(plan, "BuyUnits", "buy")
    rel = family(plan, "RelocUnits").filter(F.col("index_2") != F.col("index_3"))
    inb = rel.groupBy("plan_id", F.col("index_1").alias("type"), F.col("index_3").alias("location")) \
        .agg(F.sum("value").alias("inb"))
    outb = rel.groupBy("plan_id", F.col("index_1").alias("type"), F.col("index_2").alias("location")) \
        .agg(F.sum("value").alias("outb"))
    cur = lt_named.groupBy("type", "location").agg(F.sum("current_units").alias("cur"))
    k = ["plan_id", "type", "location"]
    keys = reduce(lambda a, b: a.unionByName(b), [x.select(*k) for x in (
        st, buy, inb, outb, plan_ids(plan).crossJoin(small(cur.select("type", "location"), DIM_MAX_ROWS)))]).distinct()
    j = keys.join(st, k, "left").join(buy, k, "left").join(inb, k, "left").join(outb, k, "left") \
        .join(small(cur, DIM_MAX_ROWS), ["type", "location"], "left")
    rhs = (F.coalesce("cur", F.lit(0.0)) + F.coalesce("buy", F.lit(0.0)) + F.coalesce("inb", F.lit(0.0))
           - F.coalesce("outb", F.lit(0.0)))
    return _out(j, "flow", ["type", "location"], F.coalesce("units", F.lit(0.0)), rhs, "eq")


def _per_category(plan: DataFrame, cats: DataFrame, sums: DataFrame) -> DataFrame:
    """Every category for every plan with its sum, 0 where the plan has no share of it."""
    every = plan_ids(plan).crossJoin(small(cats.select("category"), CATEGORY_BOUND))
    return every.join(sums, ["plan_id", "category"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def cover_volume(plan: DataFrame, cats: DataFrame) -> DataFrame:
    """C17: forward plus reserve volume shares sum to 1 per category."""
    v = family(plan, "SKUcubicPct").unionByName(family(plan, "ResSKUcubicPct"))
    g = v.groupBy("plan_id", F.col("index_1").alias("category")).agg(F.sum("value").alias("s"))
    return _out(_per_category(plan, cats, g), "cover_volume", ["category"], F.col("s"), F.lit(1.0), "eq")


def cover_unique(plan: DataFrame, cats: DataFrame) -> DataFrame:
    """Forward unique shares cover the category."""
    g = family(plan, "SKUuniquePct").groupBy("plan_id", F.col("index_1").alias("category")) \
        .agg(F.sum("value").alias("s"))
    return _out(_per_category(plan, cats, g), "cover_unique", ["category"], F.col("s"), F.lit(1.0), "ge")


def _shares(plan: DataFrame) -> DataFrame:
    """(plan, category, type, location, kind, unique, cubic) for forward and reserve shares."""
    k = ["plan_id", "category", "type", "location"]
    f = _v3(plan, "SKUuniquePct", "uniq").join(_v3(plan, "SKUcubicPct", "cubic"), k, "full_outer") \
        .withColumn("kind", F.lit("forward"))
    r = _v3(plan, "ResSKUuniquePct", "uniq").join(_v3(plan, "ResSKUcubicPct", "cubic"), k, "full_outer") \
        .withColumn("kind", F.lit("reserve"))
    return f.unionByName(r).select(*k, "kind", F.coalesce("uniq", F.lit(0.0)).alias("uniq"),
                                   F.coalesce("cubic", F.lit(0.0)).alias("cubic"))


def share_ratio(plan: DataFrame) -> DataFrame:
    """Volume share at most 1.2 x unique share."""
    s = _shares(plan)
    return _out(s, "share_ratio", ["category", "type", "location", "kind"], F.col("cubic"),
                F.lit(SHARE_RATIO) * F.col("uniq"), "le")


def min_volume(plan: DataFrame, cats: DataFrame) -> DataFrame:
    """C14: volume placed covers the minimum volume of the SKUs placed."""
    s = _shares(plan).join(small(cats.select("category", "num_sku", "sku_cubic_ft", "min_vol"), CATEGORY_BOUND),
                           "category")
    return _out(s, "min_volume", ["category", "type", "location", "kind"],
                F.col("sku_cubic_ft") * F.col("cubic"), F.col("uniq") * F.col("num_sku") * F.col("min_vol"), "ge")


def sku_capacity(plan: DataFrame, cats: DataFrame, cat_type: DataFrame) -> DataFrame:
    """Units x SKUs-per-unit hold the SKUs placed (forward and reserve)."""
    k = ["plan_id", "category", "type", "location"]
    s = _shares(plan).join(_v3(plan, "SKUStoreUnits", "units"), k, "left")
    s = s.join(small(cats.select("category", "num_sku"), CATEGORY_BOUND), "category") \
        .join(cat_type.select("category", "type", "max_sku_per_unit"), ["category", "type"], "left")
    return _out(s, "sku_capacity", ["category", "type", "location", "kind"],
                F.coalesce("units", F.lit(0.0)) * F.coalesce("max_sku_per_unit", F.lit(0.0)),
                F.col("num_sku") * F.col("uniq"), "ge")


def volume(plan: DataFrame, cats: DataFrame, types: DataFrame) -> DataFrame:
    """Unit capacity holds the category volume placed (forward + reserve)."""
    k = ["plan_id", "category", "type", "location"]
    sh = _shares(plan).groupBy(*k).agg(F.sum("cubic").alias("cubic"))
    j = _v3(plan, "SKUStoreUnits", "units").join(sh, k, "full_outer") \
        .join(small(cats.select("category", "sku_cubic_ft"), CATEGORY_BOUND), "category", "left") \
        .join(small(types.select("type", "cubic_capacity"), DIM_MAX_ROWS), "type", "left")
    return _out(j, "volume", ["category", "type", "location"],
                F.coalesce("units", F.lit(0.0)) * F.coalesce("cubic_capacity", F.lit(0.0)),
                F.coalesce("sku_cubic_ft", F.lit(0.0)) * F.coalesce("cubic", F.lit(0.0)), "ge")


def type_category(plan: DataFrame, cat_type: DataFrame) -> DataFrame:
    """Allocations (per technology) and units only on storage types compatible with the category (strict flag)."""
    ct = cat_type.select("category", "type", "compatible_strict")
    u = _alloc(plan).join(ct, ["category", "type"], "left")
    n = _v3(plan, "SKUStoreUnits", "v").join(ct, ["category", "type"], "left")
    comp = F.coalesce("compatible_strict", F.lit(0)).cast("double")
    a = _out(u, "type_category_alloc", ["category", "type", "location", "tech"], F.col("alloc"), comp, "le")
    b = _out(n, "type_category_units", ["category", "type", "location"], F.col("v"),
             F.lit(UNITS_PER_COMPATIBLE) * comp, "le")
    return a.unionByName(b)


def tech_location(plan: DataFrame, tech_loc_named: DataFrame) -> DataFrame:
    """Technology allocation only at locations the technology may use."""
    tl = small(tech_loc_named.select("location", "tech", F.lit(1.0).alias("ok")), DIM_MAX_ROWS)
    j = _alloc(plan).join(tl, ["location", "tech"], "left")
    return _out(j, "tech_location", ["category", "type", "location", "tech"], F.col("alloc"),
                F.coalesce("ok", F.lit(0.0)), "le")


def _per_category_tech(plan: DataFrame, cats: DataFrame, techs: DataFrame) -> DataFrame:
    return (plan_ids(plan).crossJoin(small(cats.select("category"), CATEGORY_BOUND))
            .crossJoin(small(techs.select(F.col("tech_name").alias("tech")), DIM_MAX_ROWS)))


def alloc_total(plan: DataFrame, cats: DataFrame, techs: DataFrame) -> DataFrame:
    """The allocation of every (category, tech) sums to 1; none counts as 0."""
    g = _alloc(plan).groupBy("plan_id", "category", "tech").agg(F.sum("alloc").alias("s"))
    g = _per_category_tech(plan, cats, techs).join(g, ["plan_id", "category", "tech"], "left")
    return _out(g, "alloc_total", ["category", "tech"], F.coalesce("s", F.lit(0.0)), F.lit(1.0), "eq")


def _alloc_skus(plan: DataFrame, cat_tech: DataFrame) -> DataFrame:
    ctn = cat_tech.select("category", F.col("tech_name").alias("tech"), F.col("num_sku").alias("tech_sku"))
    return _alloc(plan).join(ctn, ["category", "tech"], "left") \
        .withColumn("alloc_sku", F.col("alloc") * F.coalesce("tech_sku", F.lit(0.0)))


def alloc_rules(plan: DataFrame, cats: DataFrame, cat_tech: DataFrame, n_tech: int) -> DataFrame:
    """C19 (cover), C20 (per-tech limit), C22 (aggregate limit)."""
    k = ["plan_id", "category", "type", "location"]
    a = _alloc_skus(plan, cat_tech)
    need = _v3(plan, "SKUuniquePct", "uniq").join(small(cats.select("category", "num_sku"), CATEGORY_BOUND), "category")
    need = need.withColumn("need", F.col("uniq") * F.col("num_sku"))
    per = a.join(need.select(*k, "need"), k, "left")
    limit = _out(per, "alloc_limit", ["category", "type", "location", "tech"], F.col("alloc_sku"),
                 F.coalesce("need", F.lit(0.0)), "le")
    tot = a.groupBy(*k).agg(F.sum("alloc_sku").alias("s")).join(need.select(*k, "need"), k, "full_outer")
    cover = _out(tot, "alloc_cover", ["category", "type", "location"], F.coalesce("s", F.lit(0.0)),
                 F.coalesce("need", F.lit(0.0)), "ge")
    cap = _out(tot, "alloc_capacity", ["category", "type", "location"], F.coalesce("s", F.lit(0.0)),
               F.lit(float(n_tech)) * F.coalesce("need", F.lit(0.0)), "le")
    return cover.unionByName(limit).unionByName(cap)


def reserve_location(plan: DataFrame, loc_reserve: DataFrame) -> DataFrame:
    """Reserve shares only where reserve stock is allowed."""
    s = _shares(plan).filter(F.col("kind") == "reserve")
    lr = small(loc_reserve.select("location", F.col("reserve_allowed").cast("double").alias("ra")), DIM_MAX_ROWS)
    s = s.join(lr, "location", "left")
    long = s.select("plan_id", "category", "type", "location", F.explode(F.array(
        F.struct(F.lit("unique").alias("m"), F.col("uniq").alias("v")),
        F.struct(F.lit("cubic").alias("m"), F.col("cubic").alias("v")))).alias("x"), "ra").select(
        "plan_id", "category", "type", "location", "x.m", "x.v", "ra")
    return _out(long, "reserve_location", ["category", "type", "location", "m"], F.col("v"),
                F.coalesce("ra", F.lit(0.0)), "le")


def ld_cumulative(plan: DataFrame, cats: DataFrame, techs: DataFrame, cat_tech: DataFrame, loc_prio: DataFrame,
                  priorities: DataFrame, fwd_points: DataFrame) -> DataFrame:
    """C24 + D14: SKUs within reach up to each priority (J19 range join; none counts as 0) and the curve value there,
    for every category, technology and priority."""
    a = _alloc_skus(plan, cat_tech).join(small(loc_prio.select("location", "location_priority"), DIM_MAX_ROWS),
                                         "location")
    pr = small(priorities.select(F.col("location_priority").alias("p")), DIM_MAX_ROWS)
    reach = a.join(pr, a.location_priority <= pr.p, "inner").groupBy("plan_id", "category", "tech", "p") \
        .agg(F.sum("alloc_sku").alias("x_eval"))
    every = _per_category_tech(plan, cats, techs).crossJoin(pr)
    reach = every.join(reach, ["plan_id", "category", "tech", "p"], "left") \
        .withColumn("x_eval", F.coalesce("x_eval", F.lit(0.0)))
    return interpolate(fwd_points, reach, "x_eval")


def ld_increment(cum: DataFrame) -> DataFrame:
    """Increment over the previous priority (first priority as is)."""
    w = Window.partitionBy("plan_id", "category", "tech").orderBy("p")
    return cum.withColumn("inc", F.col("y_eval") - F.coalesce(F.lag("y_eval").over(w), F.lit(0.0)))


def reserve_orders(plan: DataFrame, cats: DataFrame, locations: DataFrame, res_points: DataFrame) -> DataFrame:
    """C25 + D14: reserve SKUs of every (category, location) and the reserve curve value there."""
    r = _v3(plan, "ResSKUuniquePct", "v").join(small(cats.select("category", "num_sku"), CATEGORY_BOUND), "category")
    z = r.groupBy("plan_id", "category", "location").agg(F.sum(F.col("v") * F.col("num_sku")).alias("x_eval"))
    every = (plan_ids(plan).crossJoin(small(cats.select("category"), CATEGORY_BOUND))
             .crossJoin(small(locations.select("location"), DIM_MAX_ROWS)))
    z = every.join(z, ["plan_id", "category", "location"], "left") \
        .withColumn("x_eval", F.coalesce("x_eval", F.lit(0.0))).withColumn("tech", F.lit(""))
    return interpolate(res_points, z, "x_eval")


def cost(plan: DataFrame, types: DataFrame, system: DataFrame, priorities: DataFrame, cats: DataFrame,
         cat_type: DataFrame, inc: DataFrame, res_orders: DataFrame) -> DataFrame:
    """Objective terms per plan and their total."""
    t = small(types.select("type", "buy_invest", "reloc_invest"), DIM_MAX_ROWS)
    sysv = small(system.agg(F.max("line_down_cost").alias("ldc"), F.max("reserve_cost").alias("rc")), 1)
    buy = family(plan, "BuyUnits").join(t, F.col("index_1") == t.type) \
        .groupBy("plan_id").agg(F.sum(F.col("value") * F.col("buy_invest")).alias("v")).withColumn("term", F.lit("buy"))
    rel = family(plan, "RelocUnits").filter(F.col("index_2") != F.col("index_3")).join(t, F.col("index_1") == t.type) \
        .groupBy("plan_id").agg(F.sum(F.col("value") * F.col("reloc_invest") / 2).alias("v")) \
        .withColumn("term", F.lit("relocation"))
    tt = small(priorities.select(F.col("location_priority").alias("p"), "travel_time"), DIM_MAX_ROWS)
    ld = inc.join(tt, "p").join(sysv, F.lit(True)).groupBy("plan_id") \
        .agg(F.sum(F.col("ldc") * F.col("travel_time") * F.col("inc")).alias("v")).withColumn("term", F.lit("line_down"))
    rs = res_orders.join(small(cats.select("category", "line_down_orders"), CATEGORY_BOUND), "category") \
        .join(sysv, F.lit(True)).groupBy("plan_id") \
        .agg(F.sum(F.col("rc") / (F.col("line_down_orders") + 1) * F.col("y_eval")).alias("v")) \
        .withColumn("term", F.lit("reserve"))
    pen = _v3(plan, "SKUStoreUnits", "u").join(
        cat_type.select("category", "type", "penalty"), ["category", "type"]) \
        .groupBy("plan_id").agg(F.sum(F.col("penalty") * F.col("u")).alias("v")).withColumn("term", F.lit("penalty"))
    terms = reduce(lambda a, b: a.unionByName(b), [buy, rel, ld, rs, pen])
    total = terms.groupBy("plan_id").agg(F.sum("v").alias("v")).withColumn("term", F.lit("total"))
    return terms.unionByName(total).select("plan_id", "term", F.coalesce("v", F.lit(0.0)).alias("value"))
