"""Cost center export (D4) and its load (M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.sources.fixtures import ALL_TECHS, UNKNOWN_TECH

# Department prefix -> technology (only these departments are kept).
DEPARTMENT_PREFIX_TECH = [("TX-2", "BODY"), ("TX-3", "PAINT"), ("TX-4", "ASSEMBLY")]


def department_tech(c) -> F.Column:
    """department code to technology by prefix (null when no prefix matches)."""
    col = F.col(c)
    expr = None
    for prefix, tech in DEPARTMENT_PREFIX_TECH:
        cond = col.startswith(prefix)
        expr = F.when(cond, F.lit(tech)) if expr is None else expr.when(cond, F.lit(tech))
    return expr.otherwise(F.lit(None).cast("string"))


def cost_center_tech(raw_cc: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """D4 (P3 + F10 + A4/R1): one row per cost center text, 0/1 flag per technology."""
    rows = raw_cc.select("cost_center", department_tech("department").alias("tech")).filter(F.col("tech").isNotNull())
    return rows.groupBy("cost_center").agg(
        *[F.max(F.when(F.col("tech") == t, 1).otherwise(0)).alias(t) for t in techs])


def cost_center_key(c) -> F.Column:
    """Canonical numeric cost-center key (both sides of the consumption lookup use it)."""
    d = F.trim(F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def cost_center_loaded(cc_tech: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M3: numeric ids only, first row per id (in center-text order), flags 0/1."""
    keyed = cc_tech.select(cost_center_key("cost_center").alias("cc"), F.col("cost_center").alias("_txt"),
                           *techs).filter(F.col("cc").isNotNull())
    first = keyed.groupBy("cc").agg(F.min_by(F.struct(*[F.col(t) for t in techs]), F.col("_txt")).alias("f"))
    return first.select(F.col("cc").alias("cost_center"),
                        *[F.coalesce(F.col("f." + t), F.lit(0)).alias(t) for t in techs])


__all__ = ["cost_center_tech", "cost_center_loaded", "cost_center_key", "department_tech", "UNKNOWN_TECH"]
