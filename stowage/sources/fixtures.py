"""Adapter views over the driver's tables, and the planner's dimensions derived from them.

The four raw exports (stock, material master, cost centers, order consumption)
and the ten dimension tables are queries over the TPC-H-like tables, so every
result changes with them: locations are nations, storage types are part types,
capacities and prices follow part counts and sizes.  The rules are listed in
FIXTURES.md.  The dimension texts run in Spark SQL and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.sources.tables import read_table

# Storage types: the part types, numbered so that the sizing rule of the stock export has its cases (1, 3, 4, 5).
TYPE_NAMES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD"]
# Concrete technologies in indicator order, plus the "unknown" bucket.
CONCRETE_TECHS = ["ASSEMBLY", "BODY", "PAINT"]
UNKNOWN_TECH = "UNK"
ALL_TECHS = CONCRETE_TECHS + [UNKNOWN_TECH]
# Upper bound on rows of any dimension below (25 nations x 6 types / 3, 25 nations x 4 technologies).
DIM_MAX_ROWS = 256

_TYPES = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(TYPE_NAMES, 1)) + ") AS t(type_id, type)"
_TECHS = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(ALL_TECHS, 1)) + ") AS k(tech_id, tech_name)"

# Tables that a dimension text may name.
DIM_TABLES = ["nation", "region", "part", "supplier"]
DIM_SQL: dict[str, str] = {
    "dim_tech": f"SELECT tech_id, tech_name FROM {_TECHS}",
    # the keys need normalizing; one is part of another, and the token LC matches none
    "dim_token_map": (
        "SELECT CASE r_regionkey WHEN 0 THEN ' a' WHEN 1 THEN 'B' WHEN 2 THEN 'p ' WHEN 3 THEN 'body' ELSE 'ZZ' END AS value, "
        "CASE r_regionkey % 3 WHEN 0 THEN 'assembly' WHEN 1 THEN 'BODY' ELSE ' PAINT' END AS tech_name FROM {region}"
    ),
    "dim_size": (
        "SELECT s.size_id, s.size, CAST(s.f * p.low AS DOUBLE) AS min_vol, CAST(s.g * p.low AS DOUBLE) AS total_cuft "
        "FROM (VALUES (1, 'S', 0.0625, 0.03125), (2, 'M', 0.375, 0.125), (3, 'L', 1.5, 0.75)) AS s(size_id, size, f, g) "
        "CROSS JOIN (SELECT min(p_size) AS low FROM {part}) p"
    ),
    "dim_type": (
        "SELECT t.type_id, t.type, CAST(3 * t.type_id + p.low AS DOUBLE) AS sqft_req, "
        "CAST(40 * t.type_id + p.top AS DOUBLE) AS buy_cost, CAST(25 * t.type_id + p.low AS DOUBLE) AS buy_invest, "
        "CAST(12 * t.type_id + p.top AS DOUBLE) AS reloc_cost, CAST(8 * t.type_id + p.low AS DOUBLE) AS reloc_invest, "
        f"CAST(16 * p.n + t.type_id AS DOUBLE) AS cubic_capacity FROM {_TYPES} "
        "JOIN (SELECT p_type, max(p_size) AS top, min(p_size) AS low, count(*) AS n FROM {part} GROUP BY p_type) p "
        "ON p.p_type = t.type"
    ),
    "dim_priority": (
        "SELECT x.k + 1 AS location_priority, CAST(7 * x.k + 0.5 AS DOUBLE) AS travel_time, "
        "CASE WHEN x.k = 0 THEN 0 ELSE 1 END AS reserve_allowed "
        "FROM (SELECT DISTINCT n_regionkey % 3 AS k FROM {nation}) x"
    ),
    "dim_location": (
        "SELECT n.n_nationkey + 1 AS location_id, n.n_name AS location, "
        "CAST(300 + 40 * COALESCE(s.n, 0) AS DOUBLE) AS floor_space, n.n_regionkey % 3 + 1 AS location_priority, "
        "CAST(7 * (n.n_regionkey % 3) + n.n_nationkey % 2 AS DOUBLE) AS travel_time, "
        "CASE WHEN n.n_nationkey % 6 = 5 THEN NULL ELSE CAST(2 * n.n_nationkey - 24 AS DOUBLE) END AS lat, "
        "CASE WHEN n.n_nationkey % 6 = 5 THEN NULL ELSE CAST(30 * n.n_regionkey AS DOUBLE) END AS lon "
        "FROM {nation} n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s "
        "ON s.s_nationkey = n.n_nationkey"
    ),
    # one row names a location that doesn't exist: foreign-key filters drop it; two rows share the code of another row, one
    # at another location and one at the same
    "dim_location_type": (
        "SELECT n.n_nationkey + 1 AS location_id, t.type_id, "
        "concat('N', CAST(n.n_nationkey AS STRING), '-', CAST(t.type_id AS STRING)) AS code, "
        "CAST(COALESCE(s.n, 0) + t.type_id AS INTEGER) AS current_units "
        f"FROM {{nation}} n JOIN {_TYPES} ON (n.n_nationkey + t.type_id) % 3 = 0 "
        "LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s "
        "ON s.s_nationkey = n.n_nationkey "
        "UNION ALL SELECT max(n_nationkey) + 100, 1, 'LOST', CAST(count(*) AS INTEGER) FROM {nation} "
        "UNION ALL SELECT min(n_nationkey) + 2, 3, 'N0-3', CAST(count(*) AS INTEGER) FROM {nation} "
        "UNION ALL SELECT min(n_nationkey) + 3, 2, 'N2-1', CAST(count(*) AS INTEGER) FROM {nation}"
    ),
    "dim_tech_location": (
        "SELECT k.tech_id, n.n_nationkey + 1 AS location_id "
        f"FROM {{nation}} n JOIN {_TECHS} ON k.tech_id = 4 OR (n.n_regionkey + k.tech_id) % 2 = 0 "
        "UNION ALL SELECT 4, max(n_nationkey) + 100 FROM {nation}"
    ),
    "dim_type_size": (
        "SELECT t.type_id, z.size_id, CAST(240 * t.type_id - 60 * z.size_id AS DOUBLE) AS max_sku_per_unit "
        f"FROM {_TYPES} JOIN (VALUES (1), (2), (3)) AS z(size_id) ON 2 * (z.size_id - 1) <= t.type_id "
        "JOIN (SELECT DISTINCT p_type FROM {part}) p ON p.p_type = t.type"
    ),
    "dim_system": (
        "SELECT min(r_name) AS team, CAST(100 * count(*) AS DOUBLE) AS line_down_cost, "
        "CAST(5000 * max(p.n) AS DOUBLE) AS plan_budget, CAST(0.625 AS DOUBLE) AS space_factor, "
        "CAST(2 + count(*) AS DOUBLE) AS reserve_cost "
        "FROM {region} CROSS JOIN (SELECT count(*) AS n FROM {part}) p"
    ),
}


def reads_large(name: str) -> bool:
    """Whether a dimension is computed from a table that grows (the others take a few rows of nations or regions)."""
    return "{part}" in DIM_SQL[name] or "{supplier}" in DIM_SQL[name]


def dim_text(name: str) -> str:
    """A dimension's query over tables of their own names (for DuckDB)."""
    return DIM_SQL[name].format(**{t: t for t in DIM_TABLES})


# ---------------------------------------------------------------------------
# Adapter views (DuckDB text is used by the oracle; Spark builds them below)
# ---------------------------------------------------------------------------
ADAPTER_SQL: dict[str, str] = {
    "raw_stock": """
SELECT p_partkey * 2 AS row_no, CAST(p_partkey AS VARCHAR) AS material,
  CASE WHEN p_partkey % 29 = 0 THEN 'BULK' WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'N' || (3 * (p_partkey % 8) + 2) || '-1'
       WHEN p_type = 'MEDIUM' THEN 'N' || (3 * (p_partkey % 8)) || '-3'
       WHEN p_type = 'PROMO' THEN 'N' || (3 * (p_partkey % 8) + 2) || '-4'
       ELSE 'N' || (3 * (p_partkey % 8) + 1) || '-5' END AS code,
  CASE WHEN p_partkey % 31 = 0 THEN 'n/a' WHEN p_partkey % 10 = 0 THEN concat('1,', lpad(CAST(p_size AS VARCHAR), 3, '0'))
       WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS VARCHAR), ' EA')
       ELSE CAST(p_size AS VARCHAR) END AS total_stock_raw
FROM part
UNION ALL
SELECT p_partkey * 2 + 1, CAST(p_partkey AS VARCHAR), 'N2-1', '7' FROM part WHERE p_partkey % 7 = 0
UNION ALL
SELECT -1 - s_suppkey, 'S' || s_suppkey, 'N' || (3 * (s_suppkey % 8)) || '-3', CAST(s_suppkey % 40 AS VARCHAR)
FROM supplier""",
    "raw_master": """
SELECT CAST(p_partkey AS VARCHAR) AS material, CAST(p_size AS DOUBLE) AS years,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN 899 ELSE 100 + p_partkey % 7 END AS BIGINT) AS mrp_controller,
  CASE p_partkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B/P' WHEN 2 THEN 'LC' WHEN 3 THEN '?' WHEN 4 THEN NULL
                     WHEN 5 THEN 'A; LC' WHEN 6 THEN 'BODY' ELSE 'ZZ,' END AS std_desc,
  CASE p_partkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'm' WHEN 2 THEN 'X' ELSE NULL END AS priority
FROM part""",
    "raw_cost_center": """
SELECT CAST(1000 + s_suppkey AS VARCHAR) AS cost_center,
       concat('TX-', CAST(1 + s_suppkey % 5 AS VARCHAR), '00') AS department FROM supplier
UNION ALL
SELECT CAST(1000 + s_suppkey AS VARCHAR), 'TX-300' FROM supplier WHERE s_suppkey % 6 = 0""",
    "raw_consumption": """
SELECT CAST(l_partkey AS VARCHAR) AS material, '261' AS movement_type,
       CAST(1000 + l_suppkey AS VARCHAR) AS cost_center, l_orderkey AS order_no,
       CASE WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'R' THEN 'OR09' ELSE 'OR01' END AS order_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def dim(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the dimension tables."""
    used = {t: read_table(spark, sf_dir, t) for t in DIM_TABLES if "{" + t + "}" in DIM_SQL[name]}
    return spark.sql(DIM_SQL[name], **used)


def raw_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock export: several bins per material, messy stock text, materials unknown to the master (row_no = input order)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    k, t, s = F.col("p_partkey"), F.col("p_type"), F.col("s_suppkey")
    size_txt = F.col("p_size").cast("string")

    def bin_code(key, rest: int, type_id: int):
        return F.concat(F.lit("N"), (3 * (key % 8) + rest).cast("string"), F.lit(f"-{type_id}"))

    main = part.select(
        (k * 2).alias("row_no"),
        k.cast("string").alias("material"),
        F.when(k % 29 == 0, "BULK").when(t.isin("ECONOMY", "SMALL"), bin_code(k, 2, 1))
        .when(t == "MEDIUM", bin_code(k, 0, 3)).when(t == "PROMO", bin_code(k, 2, 4))
        .otherwise(bin_code(k, 1, 5)).alias("code"),
        F.when(k % 31 == 0, "n/a").when(k % 10 == 0, F.concat(F.lit("1,"), F.lpad(size_txt, 3, "0")))
        .when(k % 3 == 0, F.concat(size_txt, F.lit(" EA")))
        .otherwise(size_txt).alias("total_stock_raw"),
    )
    second = part.filter(k % 7 == 0).select(
        (k * 2 + 1).alias("row_no"), k.cast("string").alias("material"),
        F.lit("N2-1").alias("code"), F.lit("7").alias("total_stock_raw"),
    )
    unknown = supplier.select(
        (-1 - s).alias("row_no"), F.concat(F.lit("S"), s.cast("string")).alias("material"),
        bin_code(s, 0, 3).alias("code"), (s % 40).cast("string").alias("total_stock_raw"),
    )
    return main.unionByName(second).unionByName(unknown)


def raw_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material master export, one row per part."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    r8 = k % 8
    return part.select(
        k.cast("string").alias("material"),
        F.col("p_size").cast("double").alias("years"),
        F.when(k % 11 == 0, F.lit(899)).otherwise(100 + k % 7).cast("bigint").alias("mrp_controller"),
        F.when(r8 == 0, "A").when(r8 == 1, "B/P").when(r8 == 2, "LC").when(r8 == 3, "?")
        .when(r8 == 4, F.lit(None).cast("string")).when(r8 == 5, "A; LC").when(r8 == 6, "BODY")
        .otherwise("ZZ,").alias("std_desc"),
        F.when(k % 5 == 0, "H").when(k % 5 == 1, "m").when(k % 5 == 2, "X")
        .otherwise(F.lit(None).cast("string")).alias("priority"),
        # input order of the export (the adapter is one row per part, ordered by key)
        k.alias("row_no"),
    )


def raw_cost_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-center export: center id text and department code (one center in two departments)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    s = F.col("s_suppkey")
    cc = (1000 + s).cast("string")
    main = sup.select(cc.alias("cost_center"),
                      F.concat(F.lit("TX-"), (1 + s % 5).cast("string"), F.lit("00")).alias("department"),
                      (s * 2).alias("row_no"))
    extra = sup.filter(s % 6 == 0).select(cc.alias("cost_center"), F.lit("TX-300").alias("department"),
                                          (s * 2 + 1).alias("row_no"))
    return main.unionByName(extra)


def raw_consumption(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Order consumption: one row per order line (the big fact), joined in ``parts`` partitions by order, if given."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    if parts:
        li, od = li.repartition(parts, "l_orderkey"), od.repartition(parts, "o_orderkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("l_partkey").cast("string").alias("material"),
        F.lit("261").alias("movement_type"),
        (1000 + F.col("l_suppkey")).cast("string").alias("cost_center"),
        F.col("l_orderkey").alias("order_no"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("l_returnflag") == "R"), "OR09")
        .otherwise("OR01").alias("order_type"),
    )
