"""End-to-end build over the driver's tables: raw exports -> parts -> category tables.

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame; nothing is
collected.  ``Stages`` memoises the shared intermediate plans of one build so the
same logical subtree is reused (Spark then reuses its exchanges).
"""

from __future__ import annotations

import contextvars
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from stowage.operators import categories as cat
from stowage.operators import curves as cur
from stowage.operators import consumption as con
from stowage.operators import cost_center as cc
from stowage.operators import dims as dm
from stowage.operators import master as mst
from stowage.operators import parts as prt
from stowage.operators import stock as stk
from stowage.plans import audit as au
from stowage.plans import plan_vars as pv
from stowage.plans import reports as rep
from stowage.session import dealt, material_parts, materialize, parts_for
from stowage.sources import fixtures as fx
from stowage.sources import plan_fixture as pf
from stowage.sources.tables import read_table


@dataclass
class Stages:
    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict)

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def prefetch(self, *steps: str) -> None:
        """Build independent stage tables as concurrent Spark jobs (one driver thread each).

        The steps must not share un-built memo keys; their common lazy inputs are
        created first by the caller.
        """
        with ThreadPoolExecutor(max_workers=len(steps)) as pool:
            for f in [pool.submit(contextvars.copy_context().run, getattr(self, st)) for st in steps]:
                f.result()

    def dim(self, name: str) -> DataFrame:
        """A dimension table, derived from the given tables; written once per build if it reads a large one."""
        def build():
            d = fx.dim(self.spark, self.sf_dir, name)
            return materialize(d, name, True) if fx.reads_large(name) else d
        return self._get(("dim", name), build)

    def techs(self) -> list[str]:
        """Names of the technology dimension, by id."""
        return self._get("techs", lambda: [r["tech_name"] for r in self.dim("dim_tech").orderBy("tech_id").collect()])

    def dims(self, *names: str) -> None:
        """Build dimension tables as concurrent Spark jobs."""
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            for f in [pool.submit(contextvars.copy_context().run, self.dim, n) for n in names]:
                f.result()

    def parallel(self, *steps: str) -> "Stages":
        """Build the shared category inputs, then the given independent stage tables concurrently."""
        self.dims(*fx.DIM_SQL)
        self.parts(), self.enriched(), self.category_summary(), self.grid(), self.category_tech()
        self.prefetch(*[st for st in steps if st != "category_tech"])
        return self

    # raw exports -----------------------------------------------------------
    def raw_stock(self):
        return self._get("raw_stock", lambda: fx.raw_stock(self.spark, self.sf_dir))

    def raw_master(self):
        return self._get("raw_master", lambda: fx.raw_master(self.spark, self.sf_dir))

    def raw_cost_center(self):
        return self._get("raw_cc", lambda: fx.raw_cost_center(self.spark, self.sf_dir))

    def raw_consumption(self):
        return self._get("raw_cons", lambda: fx.raw_consumption(self.spark, self.sf_dir))

    # cleaned ---------------------------------------------------------------
    def stock(self):
        return self._get("stock", lambda: stk.stock_sized(self.raw_stock(), self.dim("dim_location_type"),
                                                          self.dim("dim_size"), self.export_parts()))

    def master(self):
        return self._get("master", lambda: mst.master_flags(self.raw_master(), self.token_map(), self.techs(),
                                                            self.export_parts()))

    def export_parts(self):
        """Partitions by material of what is made from the stock and master exports."""
        return self._get("export_parts", lambda: material_parts(
            self.spark, self.raw_stock().select("material").unionAll(self.raw_master().select("material")).count()))

    def token_map(self):
        return self._get("token_map", lambda: dm.token_map_or_default(self.dim("dim_token_map")))

    def cc_tech(self):
        return self._get("cc_tech", lambda: cc.cost_center_tech(self.raw_cost_center(), self.techs()))

    def cc_loaded(self):
        return self._get("cc_loaded", lambda: materialize(
            cc.cost_center_loaded(self.cc_tech(), self.techs()), "cost_center"))

    def cons_lines(self):
        """The order lines, reduced by (material, center): the one read of the fact, in tasks of equal size at any scale."""
        def build():
            lines = read_table(self.spark, self.sf_dir, "lineitem").count()  # from the footers
            parts = parts_for(self.spark, lines)
            return materialize(con.consumption_lines(fx.raw_consumption(self.spark, self.sf_dir, parts), parts),
                               "consumption_lines")
        return self._get("cons_lines", build)

    def cons_stats(self):
        return self._get("cons_stats", lambda: materialize(con.consumption_stats(self.cons_lines()), "consumption_stats"))

    def cons_priority(self):
        return self._get("cons_prio", lambda: con.consumption_priority(self.cons_stats()))

    def cons_orders(self):
        return self._get("cons_orders", lambda: con.consumption_orders(self.cons_stats()))

    def cons_movement(self):
        return self._get("cons_mov", lambda: materialize(con.consumption_movement(self.cons_stats()),
                                                         "consumption_movement"))

    def cons_tech(self):
        return self._get("cons_tech", lambda: materialize(
            con.consumption_tech(self.cons_lines(), self.cc_loaded(), self.techs()), "consumption_tech"))

    # parts chain -----------------------------------------------------------
    def parts_from_stock(self):
        return self._get("p1", lambda: prt.parts_from_stock(self.stock(), self.techs()))

    def parts_with_master(self):
        return self._get("p2", lambda: materialize(prt.parts_with_master(
            self.parts_from_stock(), self.master(), self.techs()),
                                                   "parts_base"))

    def merged(self, df: DataFrame) -> DataFrame:
        """A table of the merge chain, dealt by material into tasks of equal size at any scale."""
        parts = self._get("merge_parts", lambda: material_parts(
            self.spark, self.parts_with_master().count() + self.cons_stats().count()))  # from the footers
        return dealt(df, parts, "material")

    def parts_with_priority(self):
        return self._get("p4", lambda: prt.parts_with_priority(
            self.merged(self.parts_with_master()), self.merged(self.cons_priority()), self.techs()))

    def parts_with_movement(self):
        return self._get("p5", lambda: prt.parts_with_movement(
            self.parts_with_priority(), self.merged(self.cons_movement()), self.techs()))

    def parts_full(self):
        return self._get("p6", lambda: prt.parts_with_tech(
            self.parts_with_movement(), self.merged(self.cons_tech()), self.techs()))

    def known_materials(self):
        """Movement of the materials that are in stock."""
        return self._get("known", lambda: dealt(self.cons_movement(), self.export_parts(), "material").join(
            self.parts_from_stock().select("material"), "material", "left_semi"))

    def parts(self):
        """M8-normalized parts: the table every category build reads."""
        def build():
            self.cons_lines()  # shared inputs, built once
            self.dims("dim_location_type", "dim_size")
            # independent stage tables: stock+master merge, Pareto movement, consumption tech
            self.prefetch("parts_with_master", "cons_movement", "cons_tech")
            return materialize(prt.parts_normalized(self.parts_full(), self.techs()), "parts")
        return self._get("p8", build)

    # categories --------------------------------------------------------------
    def enriched(self):
        return self._get("enr", lambda: cat.parts_enriched(self.parts(), self.dim("dim_size")))

    def category_summary(self):
        return self._get("i_sku", lambda: materialize(cat.category_summary(self.enriched()), "i_sku", True))

    def category_tech(self):
        return self._get("i_sku_user", lambda: materialize(cat.category_tech(
            self.enriched(), self.category_summary(), self.dim("dim_tech"), self.techs()), "i_sku_user", True))

    def category_type(self):
        return self._get("i_sku_type", lambda: materialize(cat.category_type(
            self.category_summary(), self.dim("dim_type"), self.dim("dim_type_size")), "i_sku_type", True))


    # curves ------------------------------------------------------------------
    def grid(self):
        return self._get("grid", lambda: materialize(cat.category_grid(
            materialize(cat.category_letters(self.parts()), "letters", True), self.dim("dim_size")), "grid", True))

    def fwd_fit(self):
        return self._get("fwd_fit", lambda: cur.curve_fit(
            cur.forward_demand(self.enriched(), self.techs())))

    def res_fit(self):
        return self._get("res_fit", lambda: cur.curve_fit(cur.reserve_demand(self.enriched())))

    def fwd_points(self):
        def build():
            g = self.grid().select("category").crossJoin(self.dim("dim_tech").select(F.col("tech_name").alias("tech")))
            return materialize(cur.curve_points(self.fwd_fit(), g), "curve_forward", True)
        return self._get("fwd_points", build)

    def res_points(self):
        return self._get("res_points", lambda: materialize(cur.curve_points(
            self.res_fit(), self.grid().select("category", F.lit("").alias("tech"))), "curve_reserve", True))


    # plan and reports ----------------------------------------------------------
    def lt_named(self):
        return self._get("lt_named", lambda: materialize(rep.location_type_named(
            self.dim("dim_location_type"), self.dim("dim_location"), self.dim("dim_type")), "lt_named", True))

    def plan(self):
        if "plan" not in self._memo:
            self.dims("dim_location_type", "dim_location", "dim_type", "dim_type_size", "dim_priority",
                      "dim_tech_location", "dim_tech")
        return self._get("plan", lambda: materialize(pf.fixture_plans(
            self.category_summary(), self.category_tech(), self.dim("dim_location_type"), self.dim("dim_location"),
            self.dim("dim_type"), self.dim("dim_type_size"), self.dim("dim_priority"), self.dim("dim_tech_location"),
            self.dim("dim_tech")), "plan_vars"))

    def located(self):
        return self._get("located", lambda: rep.parts_located(self.enriched(), self.lt_named()))

    def map_current(self):
        return self._get("map_current", lambda: rep.map_current(self.located(), self.lt_named(),
                                                                self.dim("dim_location"), fx.TYPE_NAMES))

    def map_recommended(self):
        return self._get("map_rec", lambda: rep.map_recommended(self.located(), self.plan(),
                                                                self.dim("dim_location"), fx.TYPE_NAMES))


    def tech_loc_named(self):
        def build():
            l = self.dim("dim_location").select("location_id", "location")
            t = self.dim("dim_tech").select("tech_id", F.col("tech_name").alias("tech"))
            return self.dim("dim_tech_location").join(l, "location_id").join(t, "tech_id").select("location", "tech")
        return self._get("tl_named", build)

    def loc_reserve(self):
        return self._get("loc_res", lambda: self.dim("dim_location").join(
            self.dim("dim_priority").select("location_priority", "reserve_allowed"), "location_priority")
            .select("location", "location_priority", "reserve_allowed"))

    def ld_cum(self):
        return self._get("ld_cum", lambda: au.ld_cumulative(
            self.plan(), self.category_summary(), self.dim("dim_tech"), self.category_tech(), self.dim("dim_location"),
            self.dim("dim_priority"), self.fwd_points()))

    def res_orders(self):
        return self._get("res_orders", lambda: au.reserve_orders(
            self.plan(), self.category_summary(), self.dim("dim_location"), self.res_points()))


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages(spark, sf_dir)


def workflow_outputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The whole workflow in one build: every persisted table and report from the raw exports.

    Intermediate stage tables are written once and shared by all outputs of this run.
    """
    s = stages(spark, sf_dir).parallel("category_tech", "category_type", "fwd_points", "res_points", "plan")
    located, plan = s.located(), s.plan()
    return {
        "parts": s.parts(),
        "i_sku": s.category_summary(), "i_sku_user": s.category_tech(), "i_sku_type": s.category_type(),
        "curve_forward": s.fwd_points(), "curve_reserve": s.res_points(),
        "alloc_counts": rep.alloc_report(located, plan, "count"),
        "alloc_cubic": rep.alloc_report(located, plan, "cubic"),
        "units_change": rep.units_change(plan, s.lt_named()),
        "map_current": s.map_current(), "map_recommended": s.map_recommended(),
        "ld_cumulative": s.ld_cum(), "reserve_orders": s.res_orders(),
    }
