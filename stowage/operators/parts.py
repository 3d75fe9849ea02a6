"""The parts table and its merge chain (M1-M8).

Each step is a pure ``parts -> parts`` function: a left join on ``material``
plus ``when``/``coalesce``, the row-set form of the reference's UPDATE ... FROM.
Both sides of every join are hash-partitioned on ``material``, so after the
first exchange the chain reuses that partitioning instead of shuffling again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import normalize_priority
from stowage.sources.fixtures import ALL_TECHS, UNKNOWN_TECH


def _concrete(techs: list[str]) -> list[str]:
    return [t for t in techs if t != UNKNOWN_TECH]


def _any(cols: list[str]) -> F.Column:
    return reduce(lambda a, b: a | b, [F.col(c) == 1 for c in cols]) if cols else F.lit(False)


def parts_columns(techs: list[str] = ALL_TECHS) -> list[str]:
    return (["material", "priority", "movement", "size", "orders", "line_down_orders", "total_stock",
             "num_users"] + list(techs) + ["size_id", "storage_type"])


def parts_from_stock(stock: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M1: one part per cleaned stock row that has stock and a size; flags 0, other attributes null."""
    ok = stock.filter(F.col("total_stock").isNotNull() & F.col("size_id").isNotNull())
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    return ok.select(
        "material", null_s.alias("priority"), null_s.alias("movement"), "size",
        null_d.alias("orders"), null_d.alias("line_down_orders"),
        F.col("total_stock").cast("double").alias("total_stock"), null_d.alias("num_users"),
        *[F.lit(0).alias(t) for t in techs],
        F.col("size_id").cast("int").alias("size_id"), "storage_type")


def parts_with_master(parts: DataFrame, master: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M2: for materials with a master record, overwrite priority, movement and flags (nulls included)."""
    src = master.select(F.col("material").alias("_m"), F.col("priority").alias("_priority"),
                        F.col("movement").alias("_movement"), *[F.col(t).alias("_" + t) for t in techs])
    j = parts.join(src, parts.material == src._m, "left")
    hit = F.col("_m").isNotNull()
    repl = {"priority": F.when(hit, F.col("_priority")).otherwise(F.col("priority")),
            "movement": F.when(hit, F.col("_movement")).otherwise(F.col("movement"))}
    for t in techs:
        repl[t] = F.when(hit, F.coalesce(F.col("_" + t), F.lit(0))).otherwise(F.col(t))
    return j.select(*[repl.get(c, F.col(c)).alias(c) for c in parts_columns(techs)])


def parts_with_priority(parts: DataFrame, prio: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M4: fill a missing priority from consumption, rest L; take line-down orders for matches, else 0."""
    src = prio.select(F.col("material").alias("_m"), F.col("priority").alias("_priority"),
                      F.col("line_down_orders").alias("_ldo"))
    j = parts.join(src, parts.material == src._m, "left")
    hit = F.col("_m").isNotNull()
    pr = F.when(F.col("priority").isNull() & hit, F.col("_priority")).otherwise(F.col("priority"))
    ldo = F.when(hit, F.col("_ldo").cast("double")).otherwise(F.col("line_down_orders"))
    repl = {"priority": F.coalesce(pr, F.lit("L")), "line_down_orders": F.coalesce(ldo, F.lit(0.0))}
    return j.select(*[repl.get(c, F.col(c)).alias(c) for c in parts_columns(techs)])


def parts_with_movement(parts: DataFrame, movement: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M5: where movement is missing take movement *and* orders from consumption; then L / 0."""
    src = movement.select(F.col("material").alias("_m"), F.col("movement").alias("_movement"),
                          F.col("orders").alias("_orders"))
    j = parts.join(src, parts.material == src._m, "left")
    take = F.col("movement").isNull() & F.col("_m").isNotNull() & F.col("_movement").isNotNull()
    mv = F.when(take, F.col("_movement")).otherwise(F.col("movement"))
    od = F.when(take, F.col("_orders").cast("double")).otherwise(F.col("orders"))
    repl = {"movement": F.coalesce(mv, F.lit("L")), "orders": F.coalesce(od, F.lit(0.0))}
    return j.select(*[repl.get(c, F.col(c)).alias(c) for c in parts_columns(techs)])


def parts_with_tech(parts: DataFrame, tech: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M6: OR in concrete technologies from consumption (never UNK), clear UNK when any concrete
    is set, and recount num_users as the number of set flags (UNK included)."""
    concrete = _concrete(techs)
    src = tech.filter(F.col("material").isNotNull()).select(
        F.col("material").alias("_m"), *[F.col(t).alias("_" + t) for t in concrete])
    j = parts.join(src, parts.material == src._m, "left")
    repl = {t: F.when((F.col(t) == 1) | (F.coalesce(F.col("_" + t), F.lit(0)) > 0), F.lit(1)).otherwise(F.lit(0))
            for t in concrete}
    stage = j.select(*[repl.get(c, F.col(c)).alias(c) for c in parts_columns(techs)])
    if UNKNOWN_TECH in techs:
        stage = stage.withColumn(UNKNOWN_TECH, F.when(_any(concrete), F.lit(0)).otherwise(F.col(UNKNOWN_TECH)))
    users = reduce(lambda a, b: a + b, [F.coalesce(F.col(t), F.lit(0)) for t in techs])
    return stage.withColumn("num_users", users.cast("double")).select(*parts_columns(techs))


def parts_normalized(parts: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """M8: priority to H/M/L (else L); UNK set iff no concrete technology (num_users untouched)."""
    out = parts.withColumn("priority", normalize_priority("priority"))
    if UNKNOWN_TECH in techs:
        concrete = _concrete(techs)
        unk = F.lit(1) if not concrete else F.when(_any(concrete), F.lit(0)).otherwise(F.lit(1))
        out = out.withColumn(UNKNOWN_TECH, unk)
    return out.select(*parts_columns(techs))
