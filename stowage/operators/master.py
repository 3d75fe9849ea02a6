"""Material master cleaning (D3): description tokens to technology flags, MRP rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.cleaning import desc_or_unknown, is_missing_like, norm_key, split_tokens
from stowage.operators.joins import small
from stowage.operators.stock import first_per_key
from stowage.sources.fixtures import ALL_TECHS, DIM_MAX_ROWS, UNKNOWN_TECH

# MRP controller whose materials are forced to movement L.
SLOW_MRP_CONTROLLER = 899


def master_dedup(raw_master: DataFrame, parts: int | None = None) -> DataFrame:
    """First record per material, in export order."""
    base = raw_master.filter(F.col("material").isNotNull())
    return first_per_key(base.select("material", "row_no", "priority", "mrp_controller", "std_desc"),
                         "material", "row_no", parts=parts)


def master_tokens(raw_master: DataFrame, parts: int | None = None) -> DataFrame:
    """F6 + F7: (material, pos, token) for every split token, empty ones included."""
    m = master_dedup(raw_master, parts)
    toks = split_tokens(desc_or_unknown("std_desc"))
    return m.select("material", F.posexplode(toks).alias("pos", "token"))


def token_map_norm(token_map: DataFrame) -> DataFrame:
    """Lookup keys and labels trimmed + upper-cased; one label per key."""
    return (token_map.select(norm_key("value").alias("value"), norm_key("tech_name").alias("tech_name"))
            .filter(F.col("value").isNotNull())
            .groupBy("value").agg(F.min("tech_name").alias("tech_name")))


def master_tech_long(raw_master: DataFrame, token_map: DataFrame, parts: int | None = None) -> DataFrame:
    """F8 + F9: (material, tech) for each token: substring match on any map key, no match = UNK.

    The map is a small dimension, so the substring join is a broadcast
    nested-loop join that never moves the token rows.
    """
    toks = master_tokens(raw_master, parts).filter(~is_missing_like("token"))
    mp = small(token_map_norm(token_map), DIM_MAX_ROWS)
    j = toks.join(mp, F.upper(toks.token).contains(mp.value), "left")
    tech = F.coalesce(mp.tech_name, F.lit(UNKNOWN_TECH))
    return j.select(toks.material, tech.alias("tech")).distinct()


def master_flags(raw_master: DataFrame, token_map: DataFrame, techs: list[str] = ALL_TECHS,
                 parts: int | None = None) -> DataFrame:
    """D3 output: material, priority, movement, one 0/1 column per technology; in ``parts`` partitions by material, if given."""
    m = master_dedup(raw_master, parts)
    long = master_tech_long(raw_master, token_map, parts)
    wide = long.groupBy("material").agg(
        *[F.max(F.when(F.col("tech") == t, 1).otherwise(0)).alias(t) for t in techs])
    movement = F.when(F.col("mrp_controller") == SLOW_MRP_CONTROLLER, F.lit("L")).otherwise(F.lit(None).cast("string"))
    out = m.join(wide, "material", "left").select(
        "material", "priority", movement.alias("movement"),
        *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in techs])
    return out
