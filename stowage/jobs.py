"""End-to-end jobs (D20): exports become tables of a workspace, and those the parts and category tables.

Each export job reads the delimited files (headers matched without case and blanks, rows kept in the order of the
files), coerces the columns by the rules of its family (V5), checks the input contract (V2), applies the operator,
checks the output contract (V4) and saves the table under its name (M9), with a report of what it read.
A job is one transaction: its tables become visible together, or not at all.

Per-material tables are cut into buckets; ``build_parts`` computes only the buckets whose inputs changed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions import cleaning as fn
from stowage.functions.contracts import (CONTRACTS, ContractError, coerce, enforce_output, load_contract, required_cols,
                                         validate)
from stowage.operators import categories as cat
from stowage.operators import consumption as con
from stowage.operators import cost_center as cc
from stowage.operators import dims as dm
from stowage.operators import master as mst
from stowage.operators import parts as prt
from stowage.operators import stock as stk
from stowage.session import dealt, material_parts, materialize, parts_for, stage_scope
from stowage.sources.files import export_bytes, read_export
from stowage.sources.fixtures import ALL_TECHS
from stowage.sources.workspace import Transaction, Workspace

# Export header of each column, by family.
HEADERS: dict[str, dict[str, str]] = {
    "stock": {"Material": "material", "Storage Type": "code", "Total Stock": "total_stock_raw"},
    "master": {"Material": "material", "Years": "years", "MRP Controller": "mrp_controller", "Std Desc": "std_desc",
               "Priority": "priority"},
    "cost_center": {"Cost Center": "cost_center", "Department": "department"},
    "consumption": {"Material": "material", "Movement Type": "movement_type", "Cost Center": "cost_center",
                    "Order": "order_no", "Order Type": "order_type"},
}
# Families in which the first row of a material counts.
ORDERED = ("stock", "master")
# Columns whose text a family parses, and how: a text that is there but gives no value is counted in the report.
PARSED = {"stock": {"total_stock_raw": fn.clean_int},
          "master": {"years": lambda c: fn.clean_float(c, strip_commas=False), "mrp_controller": fn.clean_int_commas},
          "cost_center": {"cost_center": cc.cost_center_key}, "consumption": {"cost_center": cc.cost_center_key}}
# Bytes of a short row of an export, so that the size of its files tells about how many rows there are at most.
LINE_BYTES = 20
# What the parts table is built from; all are cut into buckets of the material.
PART_INPUTS = ("stock", "master", "material_to_priority", "material_to_movement", "material_to_tech")
# Tables with a flag for each technology.
FLAGGED = ("master", "cost_center", "material_to_tech", "parts")


def _read(ws: Workspace, path: str, family: str) -> tuple[DataFrame, Observation]:
    """Headers, types, input contract; rows and unreadable texts are counted as the job reads them."""
    raw = read_export(ws.spark, path, HEADERS[family], order_col="row_no" if family in ORDERED else None)
    seen = Observation()
    bad = [F.count_if((F.trim(F.col(c)) != "") & parse(c).isNull()).alias(c) for c, parse in PARSED[family].items()]
    raw = raw.observe(seen, F.count(F.lit(1)).alias("rows"), *bad)
    typed = coerce(raw, {c: t for c, t in {"years": "double", "mrp_controller": "bigint"}.items() if c in raw.columns},
                   family)
    for f in load_contract(family).fields:
        typed = typed.withColumn(f.name, F.col(f.name).cast(f.dataType))
    validate(typed, family)
    return typed.select(*[c for c in ("row_no",) if c in typed.columns], *required_cols(family)), seen


def _report(t: Transaction, family: str, seen: Observation) -> None:
    """Table ``load_<family>``: rows read, and per parsed column the texts that gave no value."""
    found = dict(seen.get)
    rows = [(family, "rows", None, found.pop("rows"))] + [(family, "unreadable", c, n) for c, n in found.items()]
    t.replace(f"load_{family}", t.ws.spark.createDataFrame(rows, "family string, metric string, name string, value long"))


def _checked(df: DataFrame, contract: str, techs: list[str] | None = None) -> DataFrame:
    """V4: the columns of the output contract, in its types, and nothing missing; other columns follow."""
    out = enforce_output(df, contract, techs=techs)
    typed = [F.col(f.name).cast(f.dataType) for f in load_contract(contract, techs).fields]
    rest = [c for c in out.columns if c not in required_cols(contract, techs)]
    checked = out.select(*typed, *rest)
    validate(checked, contract, techs=techs)
    return checked


def technologies(t: Transaction) -> list[str]:
    """Names of the technology dimension by id; the default ones without a dimension."""
    if t.entry("dim_tech") is None:
        return list(ALL_TECHS)
    return [r["tech_name"] for r in t.read("dim_tech").select(F.upper("tech_name").alias("tech_name"), "tech_id")
            .orderBy("tech_id").collect()]  # a dimension


def build_stock(ws: Workspace, path: str, location_types: DataFrame | None = None, sizes: DataFrame | None = None) -> str:
    """Stock export to the sized stock table; rows that the load can't take go to ``stock_rejects``."""
    with stage_scope(ws.spark), ws.transaction() as t:
        rows, seen = _read(ws, path, "stock")
        lt = t.read("dim_location_type") if location_types is None else location_types
        parts = material_parts(ws.spark, export_bytes(ws.spark, path) // LINE_BYTES)
        sized = materialize(stk.stock_sized(rows, lt, t.read("dim_size") if sizes is None else sizes, parts), "stock_job")
        t.replace("stock_rejects", stk.stock_rejects(sized))
        fine = sized.filter("total_stock IS NOT NULL AND size_id IS NOT NULL")
        t.replace_buckets("stock", _checked(fine, "stock_output"), "material")
        _report(t, "stock", seen)
    return "stock"


def build_master(ws: Workspace, path: str, token_map: DataFrame | None = None) -> str:
    with ws.transaction() as t:
        rows, seen = _read(ws, path, "master")
        techs = technologies(t)
        known = dm.token_map_or_default(t.read("dim_token_map") if token_map is None else token_map)
        parts = material_parts(ws.spark, export_bytes(ws.spark, path) // LINE_BYTES)
        t.replace_buckets("master", _checked(mst.master_flags(rows, known, techs, parts), "master_output", techs), "material")
        _report(t, "master", seen)
    return "master"


def build_cost_center(ws: Workspace, path: str) -> str:
    with ws.transaction() as t:
        rows, seen = _read(ws, path, "cost_center")
        techs = technologies(t)
        t.replace("cost_center", cc.cost_center_loaded(
            _checked(cc.cost_center_tech(rows, techs), "cost_center_output", techs), techs))
        _report(t, "cost_center", seen)
    return "cost_center"


def build_consumption(ws: Workspace, path: str) -> list[str]:
    """Order lines to priority, movement and technologies per material, from one read of the export; needs cost centers."""
    with stage_scope(ws.spark), ws.transaction() as t:
        rows, seen = _read(ws, path, "consumption")
        techs = technologies(t)
        parts = parts_for(ws.spark, export_bytes(ws.spark, path) // LINE_BYTES)
        lines = materialize(con.consumption_lines(rows, parts, by_order=False), "consumption_lines")
        stats = materialize(con.consumption_stats(lines), "consumption_stats")
        tables = {"material_to_priority": con.consumption_priority(stats),
                  "material_to_movement": con.consumption_movement(stats),
                  "material_to_tech": con.consumption_tech(lines, t.read("cost_center"), techs)}
        for name, df in tables.items():
            t.replace_buckets(name, _checked(df, name, techs), "material")
        _report(t, "consumption", seen)
    return list(tables)


def build_parts(ws: Workspace) -> list[str]:
    """M1-M8 over the saved tables, for the buckets that changed; returns those.

    A bucket remembers the folders it was built from.  A bucket whose inputs are the same is left as it is; the
    others are computed from their inputs' buckets alone, by the same chain as a full build: only base tables
    go in, so it makes no difference how often consumption came in before.
    """
    with ws.transaction() as t:
        missing = [n for n in PART_INPUTS if t.entry(n) is None]
        if missing:
            raise ContractError(f"parts need tables that are not there: {missing}")
        techs = technologies(t)
        inputs = {n: t.entry(n) for n in PART_INPUTS}
        now = {str(b): json.dumps([techs, [e.folders.get(str(b), [None])[0] for e in inputs.values()]])
               for b in range(ws.buckets)}
        old = t.entry("parts")
        touched = [b for b in now if old is None or old.built.get(b) != now[b]]
        if not touched:
            t.confirm("parts")
            return []
        tables = [t.read(n, touched) for n in PART_INPUTS]
        deal = material_parts(ws.spark, max(df.count() for df in tables[:2]) + tables[2].count())  # from the footers
        stock, master, priority, movement, tech = (dealt(df, deal, "material") for df in tables)
        parts = prt.parts_with_master(prt.parts_from_stock(stock, techs), master, techs)
        parts = prt.parts_with_priority(parts, priority, techs)
        parts = prt.parts_with_movement(parts, movement, techs)
        parts = prt.parts_normalized(prt.parts_with_tech(parts, tech, techs), techs)
        t.replace_buckets("parts", parts, "material", touched, {b: now[b] for b in touched})
    return touched


def build_categories(ws: Workspace) -> list[str]:
    """D8-D11 over the saved parts; the three category tables become visible together."""
    with stage_scope(ws.spark), ws.transaction() as t:
        techs = technologies(t)
        enriched = cat.parts_enriched(t.read("parts"), t.read("dim_size"))
        summary = materialize(cat.category_summary(enriched), "i_sku", bounded=True)
        tables = {"i_sku": summary, "i_sku_user": cat.category_tech(enriched, summary, t.read("dim_tech"), techs),
                  "i_sku_type": cat.category_type(summary, t.read("dim_type"), t.read("dim_type_size"))}
        for name, df in tables.items():
            t.replace(name, _checked(df, name))
    return list(tables)


def register_technology(ws: Workspace, name: str) -> str:
    """A new technology: a row of the dimension, and a flag 0 in every table that has flags; its indicator name.

    No table is written anew: rows saved before show 0 until their next build.  An indicator that is there already changes
    nothing; a name without a letter, digit or underscore is refused.
    """
    named = ws.spark.range(1).select(fn.sanitize_name(F.lit(name))).first()[0]
    if not named:
        raise ContractError(f"technology name {name!r} holds no letter or digit")
    with ws.transaction() as t:
        techs = t.read("dim_tech")
        if techs.filter(F.upper("tech_name") == named).isEmpty():
            kinds = dict(techs.dtypes)
            row = dm.next_id(techs, "tech_id").select(F.col("next_id").cast(kinds["tech_id"]).alias("tech_id"),
                                                      F.lit(named).alias("tech_name"))
            t.replace("dim_tech", techs.select("tech_id", "tech_name").unionByName(row))
        for table in FLAGGED:
            if t.entry(table) is not None:
                t.add_column(table, named, T.IntegerType(), 0)
    return named


def load_dimension(ws: Workspace, table: str, rows: DataFrame,
                   parents: list[tuple[DataFrame, list[str]]] = ()) -> str:
    """S3 + S4: save a dimension or relationship, without rows whose foreign keys name nothing."""
    ws.replace(table, dm.fk_filter(rows, list(parents)) if parents else rows)
    return table


def load_dimension_export(ws: Workspace, table: str, path: str, schema: T.StructType,
                          parents: list[tuple[DataFrame, list[str]]] = ()) -> str:
    """S3 from a delimited file: headers by column name, columns cast to ``schema``, foreign keys checked."""
    raw = read_export(ws.spark, path, {f.name: f.name for f in schema.fields})
    return load_dimension(ws, table, raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]),
                          parents)


def reset_dimensions(ws: Workspace, dims: dict[str, DataFrame]) -> None:
    """Load every dimension anew from its source, in one commit."""
    with ws.transaction() as t:
        for name, rows in dims.items():
            t.replace(name, rows)


def save_outputs(ws: Workspace, outputs: dict[str, DataFrame]) -> list[str]:
    """M9: save the tables of a workflow run under their names, together; a table of CONTRACTS is checked first (V4)."""
    with ws.transaction() as t:
        for name, df in outputs.items():
            t.replace(name, _checked(df, name) if name in CONTRACTS else df)
    return list(outputs)
