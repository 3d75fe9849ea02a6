"""Order consumption (D5): priority (A1), distinct orders (A2), Pareto movement (W1), tech flags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.cost_center import cost_center_key
from stowage.session import materialize
from stowage.sources.fixtures import ALL_TECHS, CONCRETE_TECHS, UNKNOWN_TECH

# Order type of a line-down order; Pareto cut for fast movers.
LINE_DOWN_ORDER_TYPE = "OR09"
PARETO_CUT = 0.80


def consumption_lines(cons: DataFrame, parts: int | None = None, by_order: bool = True) -> DataFrame:
    """Order lines reduced to (material, cost center): line-down lines, and orders counted once per material.

    A1, A2 and A3 all follow from this table, which has a row per distinct pair, not per line.  Within an order the
    first line of a material stands for the (material, order) pair, so summing these over centers gives the exact distinct
    orders.  The window needs the lines of an order together: lines that come out of a join on the order key already
    are, and others are shuffled once.  What is shuffled after that is pre-aggregated by (material, center).  Lines without
    an order count no order; they are spread over tasks, however many there are.

    With ``parts`` (large facts) that many tasks share the lines, so that none holds more as the fact grows; they come in
    so many partitions by order, or are dealt here (``by_order`` false).  A pair is then dealt by slices of its orders, so
    a hot one is spread too, and has a row per slice: what reads the table sums, or takes the largest.
    """
    order = F.col("order_no")
    spread = F.when(order.isNull(), F.spark_partition_id())
    lines = cons.select("material", "order_no", "cost_center", (F.col("order_type") == LINE_DOWN_ORDER_TYPE).alias("_down"),
                        spread.alias("_spread"))
    nth = F.row_number().over(Window.partitionBy("order_no", "material", "_spread").orderBy("cost_center"))
    lines = lines.select("*", (order.isNotNull() & (nth == 1)).alias("_first"))
    keys = ["material", "cost_center"]
    if parts:
        keys.append("_slice")
        lines = lines.withColumn("_slice", F.pmod(F.hash("order_no", "_spread"), F.lit(math.isqrt(parts) + 1)))
        lines = lines.repartition(parts, *keys)
    return lines.groupBy(*keys).agg(F.count_if("_down").alias("line_down"),
                                    F.count_if("_first").alias("orders")).drop("_slice")


def consumption_stats(lines: DataFrame) -> DataFrame:
    """A1 + A2: per material, line-down order lines and exact distinct orders."""
    return lines.filter(F.col("material").isNotNull()).groupBy("material").agg(
        F.sum("line_down").cast("bigint").alias("line_down_orders"), F.sum("orders").cast("bigint").alias("orders"))


def consumption_priority(stats: DataFrame) -> DataFrame:
    """A1: line-down order lines per material; H when any, else L."""
    return stats.select("material", F.when(F.col("line_down_orders") > 0, "H").otherwise("L").alias("priority"),
                        "line_down_orders")


def consumption_orders(stats: DataFrame) -> DataFrame:
    """A2: exact distinct (non-null) orders per material."""
    return stats.select("material", "orders")


def _share_ok(cum_before, value, j, total) -> F.Column:
    """Pareto test for the j-th row of a block, evaluated exactly as the double ratio."""
    return ((cum_before + value * j).cast("double") / total.cast("double")) <= F.lit(PARETO_CUT)


def pareto_blocks(orders: DataFrame) -> DataFrame:
    """Histogram of order counts with, per block, how many of its rows fall inside the cut.

    Rows are ranked by orders desc, ties by material asc; inside a block of equal
    counts v the running sum grows by v per row, so the number of H rows is the
    largest j with (cum_before + v*j) / total <= cut: found in closed form, then
    confirmed on the neighbours with the same double comparison.
    """
    hist = orders.groupBy("orders").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("orders")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    h = (hist.withColumn("block_sum", F.col("orders") * F.col("n"))
         .withColumn("cum_before", F.coalesce(F.sum("block_sum").over(before), F.lit(0)))
         .withColumn("total", F.sum("block_sum").over(everything)))
    v, n, cb, tot = F.col("orders"), F.col("n"), F.col("cum_before"), F.col("total")
    est = F.floor((F.lit(PARETO_CUT) * tot.cast("double") - cb.cast("double")) / v.cast("double"))
    kc = F.least(F.greatest(est, F.lit(0)), n)
    k_general = (F.when((kc + 1 <= n) & _share_ok(cb, v, kc + 1, tot), kc + 1)
                 .when((kc >= 1) & _share_ok(cb, v, kc, tot), kc)
                 .when((kc >= 2) & _share_ok(cb, v, kc - 1, tot), kc - 1)
                 .otherwise(F.lit(0)))
    k = (F.when(tot == 0, n)
         .when(v == 0, F.when(_share_ok(cb, F.lit(0), F.lit(0), tot), n).otherwise(F.lit(0)))
         .otherwise(k_general))
    return h.withColumn("k_fast", k.cast("bigint")).select("orders", "n", "cum_before", "total", "k_fast")


def _kth_material(block: DataFrame, k: int, parts: int) -> str:
    """The k-th smallest material of a block, exactly, without sorting it in one task.

    The block is written once in ``parts`` ranges of materials; the counts of the ranges (a row each) tell which
    one holds rank k, and only that one, about a ``parts``-th of the block, is ranked.
    """
    ranged = materialize(block.repartitionByRange(parts, "material").withColumn("_pid", F.spark_partition_id()),
                         "pareto_ranges")
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    at = counts.filter((F.col("before") < k) & (F.lit(k) <= F.col("before") + F.col("n"))).first()
    nth = F.row_number().over(Window.orderBy("material"))
    return (ranged.filter(F.col("_pid") == at["_pid"]).withColumn("_nth", nth)
            .filter(F.col("_nth") == k - at["before"]).first()["material"])


def consumption_movement(stats: DataFrame, range_parts: int | None = None) -> DataFrame:
    """Pareto movement per material (H inside the first 80% of orders, else M), with Orders.

    ``stats`` is the per-material table of ``consumption_stats``, read more than once, so callers pass a
    materialised copy.  Shares grow along the ranking (orders descending, then material), so one border separates H from M:
    an order count and, if the border lies inside the block of materials with that count, the last of its materials.
    The border is the same at every size; only this one count and material reach the driver.
    """
    orders = consumption_orders(stats)
    border = (pareto_blocks(orders).filter(F.col("k_fast") > 0).orderBy("orders").limit(1)
              .select("orders", "n", "k_fast").first())
    if border is None:
        fast = F.lit(False)
    else:
        fast = F.col("orders") > border["orders"]
        here = F.col("orders") == border["orders"]
        if border["k_fast"] < border["n"]:
            parts = range_parts or max(2, int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            here &= F.col("material") <= _kth_material(orders.filter(here).select("material"), border["k_fast"], parts)
        fast |= here
    return orders.select("material", F.when(fast, "H").otherwise("M").alias("movement"), "orders")


def consumption_tech(cons: DataFrame, cc_loaded: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """A3 + D7: OR of cost-center flags per material; a failed lookup counts as UNK;
    UNK cleared when any concrete technology is set.

    Callers pass the pairs of ``consumption_lines``, so the lookup join sees a pair, not its lines; rows that repeat a
    pair change no OR, so nothing is made distinct first, and the OR is taken within each task before the shuffle.
    """
    pairs = cons.select("material", cost_center_key("cost_center").alias("cc"))
    cc = cc_loaded.select(F.col("cost_center").alias("cc_r"), *[F.col(t).alias("r_" + t) for t in techs])
    j = pairs.join(cc, pairs.cc == cc.cc_r, "left")
    miss = F.col("cc_r").isNull()
    row_flags = []
    for t in techs:
        base = F.coalesce(F.col("r_" + t), F.lit(0))
        if t == UNKNOWN_TECH:
            base = F.when(miss, F.lit(1)).otherwise(base)
        row_flags.append(base.alias(t))
    per_row = j.select("material", *row_flags)
    agg = per_row.groupBy("material").agg(*[F.max(t).alias(t) for t in techs])
    concrete = [t for t in techs if t != UNKNOWN_TECH]
    any_concrete = F.greatest(*[F.col(t) for t in concrete]) > 0 if len(concrete) > 1 else F.col(concrete[0]) > 0
    cols = [F.when(any_concrete, F.lit(0)).otherwise(F.col(t)).alias(t) if t == UNKNOWN_TECH else F.col(t)
            for t in techs]
    return agg.select("material", *cols)


__all__ = ["consumption_priority", "consumption_orders", "consumption_movement", "consumption_tech",
           "pareto_blocks", "CONCRETE_TECHS"]
