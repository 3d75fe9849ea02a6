"""Table contracts (V1-V5): named StructTypes, validation, output enforcement, typed coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.cleaning import clean_float, clean_int, clean_int_commas, clean_ts


class ContractError(ValueError):
    pass


S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Technologies whose flags the contracts below list; load_contract() puts others in their place.
TECHS = ["ASSEMBLY", "BODY", "PAINT", "UNK"]

# Required columns (in order) and types of every named input and output.
CONTRACTS: dict[str, T.StructType] = {
    "stock": _st(("material", S), ("code", S), ("total_stock_raw", S)),
    "stock_output": _st(("material", S), ("size", S), ("total_stock", L), ("size_id", I), ("storage_type", S)),
    "master": _st(("material", S), ("years", D), ("mrp_controller", L), ("std_desc", S), ("priority", S)),
    "master_output": _st(("material", S), ("priority", S), ("movement", S), ("ASSEMBLY", I), ("BODY", I),
                         ("PAINT", I), ("UNK", I)),
    "cost_center": _st(("cost_center", S), ("department", S)),
    "cost_center_output": _st(("cost_center", S), ("ASSEMBLY", I), ("BODY", I), ("PAINT", I), ("UNK", I)),
    "consumption": _st(("material", S), ("movement_type", S), ("cost_center", S), ("order_no", S),
                       ("order_type", S)),
    "material_to_priority": _st(("material", S), ("priority", S), ("line_down_orders", L)),
    "material_to_movement": _st(("material", S), ("movement", S), ("orders", L)),
    "material_to_tech": _st(("material", S), ("ASSEMBLY", I), ("BODY", I), ("PAINT", I), ("UNK", I)),
    "i_sku": _st(("category_id", I), ("category", S), ("priority", S), ("movement", S), ("size", S),
                 ("total_stock", D), ("total_orders", D), ("line_down_orders", D), ("size_id", I),
                 ("min_vol", D), ("sku_cubic_ft", D)),
    "i_sku_user": _st(("category_id", I), ("category", S), ("tech_id", I), ("tech_name", S), ("num_sku", D),
                      ("ld_orders_per_user", D), ("orders_per_user", D)),
    "i_sku_type": _st(("category_id", I), ("category", S), ("type_id", I), ("type", S), ("size_id", I),
                      ("cubic_capacity_per_unit", D), ("max_sku_per_unit", D), ("compatible", I), ("penalty", I)),
}


def load_contract(name: str, techs: list[str] | None = None) -> T.StructType:
    """V1; a contract that lists technology flags lists those of ``techs`` instead, when given."""
    if name not in CONTRACTS:
        raise ContractError(f"unknown contract {name!r}")
    contract = CONTRACTS[name]
    if techs is None or TECHS[0] not in contract.names:
        return contract
    plain = [f for f in contract.fields if f.name not in TECHS]
    return T.StructType(plain + [T.StructField(t, I, True) for t in techs])


def required_cols(name: str, techs: list[str] | None = None) -> list[str]:
    return [f.name for f in load_contract(name, techs).fields]


def validate(df: DataFrame, name: str, check_types: bool = True,
             techs: list[str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """V2: fail on missing columns or a type mismatch; project to the required columns in order."""
    contract = load_contract(name, techs)
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in contract.fields if f.name not in have]
    extra = [c for c in df.columns if c not in {f.name for f in contract.fields}]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    if check_types:
        bad = [f.name for f in contract.fields if have[f.name] != f.dataType]
        if bad:
            raise ContractError(f"type mismatch for columns: {bad}")
    return df.select(*[f.name for f in contract.fields]), missing, extra


def enforce_output(df: DataFrame, name: str, defaults: dict | None = None,
                   techs: list[str] | None = None) -> DataFrame:
    """Add each missing required column (default or null, typed); keep other columns."""
    defaults = defaults or {}
    out = df
    for f in load_contract(name, techs).fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(defaults.get(f.name)).cast(f.dataType))
    return out


# Cleaning variant per column type and input family (V5): the stock and consumption exports strip
# every non-numeric character from integers and commas from floats; master and cost-center exports strip only the
# commas of integers, so a float with a comma becomes null.
_INT_RULE = {"stock": clean_int, "consumption": clean_int, "master": clean_int_commas,
             "cost_center": clean_int_commas}


def coerce(df: DataFrame, types: dict[str, str], family: str = "stock") -> DataFrame:
    """V5: best-effort typed cleanup; absent columns skipped, bad values become null."""
    exprs: dict[str, Column] = {}
    for c, t in types.items():
        if c not in df.columns:
            continue
        if t in ("int", "bigint", "long"):
            exprs[c] = _INT_RULE.get(family, clean_int)(c)
        elif t in ("double", "float"):
            exprs[c] = clean_float(c, strip_commas=family in ("stock", "consumption"))
        elif t == "timestamp":
            exprs[c] = clean_ts(c)
        elif t == "string":
            exprs[c] = F.col(c).cast("string")
        else:
            exprs[c] = F.col(c).try_cast(t)
    return df.select(*[exprs.get(c, F.col(c)).alias(c) for c in df.columns])
