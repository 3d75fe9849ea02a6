"""Contiguous shards of equal bytes, by global prefix sums of sizes (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import row_seq, stage_table


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``n_shards`` contiguous shards of near equal bytes.

    Documents are range-partitioned by (hash of the text, id), so equal texts are
    neighbours, while a group of copies, however large, still spreads over
    partitions by id.  Each partition's bytes and rows are totalled, a running sum
    over these totals (one row per partition) gives each partition's offset, and
    offset plus running sum within the partition is a document's global place.
    A document goes to the shard in which its middle byte falls.  No shard's bytes
    differ from the target by more than its two border documents; cuts split at
    most ``n_shards - 1`` groups of equal texts.

    Only (id, size, crc, hash) rows are shuffled, never texts.  A null text has no
    bytes (crc32 0, size 1); null ids sort first; repeated rows each take a slot of
    their own (a row number breaks the tie); an empty table gives no rows.  Other
    columns of ``docs`` are not read.

    Returns id_col, size, text_crc32, shard, slot (gapless from 0 within the shard).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), row_seq().alias("seq"))
    parts = stage_table(rows.repartitionByRange("key", "id", "seq").withColumn("part", F.spark_partition_id()),
                        "shard-rows")
    # one row per partition: its offset in bytes and rows
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
               .select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
                       F.sum("bytes").over(W.partitionBy()).alias("total")))
    within = W.partitionBy("part").orderBy("key", "id", "seq")
    placed = (parts.withColumn("before", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("row", F.row_number().over(within) - 1)
              .join(F.broadcast(offsets), "part")  # as many rows as range partitions, a setting
              .withColumn("at", 2 * (F.col("bytes_before") + F.col("before")) + F.col("size"))
              .select("id", "size", "crc", (F.col("rows_before") + F.col("row")).alias("place"),
                      F.least(F.lit(n_shards - 1), F.expr(f"cast((at * {n_shards}L) div (2 * total) as int)"))
                      .alias("shard")))
    placed = stage_table(placed, "shard-placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return (placed.join(F.broadcast(starts), "shard")  # n_shards rows
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("place") - F.col("start")).alias("slot")))
