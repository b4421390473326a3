"""Contiguous shards of near-equal byte size, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import checkpointed

#: Added to each row's bytes, so that rows without text have a size as well.
ROW_OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Rows in order of the id are cut where the global prefix sum of sizes passes k/n_shards of the total, so each
    shard is one contiguous range within a row of its target. Only (id, size, crc) is shuffled, never the text.
    Range partitions are written once, so that the totals and the rows see the same partitions; the totals are one
    row for each partition, which is all that is broadcast or met in a single task.

    Null texts have size ROW_OVERHEAD and crc 0; null ids sort first; repeated ids are ordered by (size, crc, row
    number); an empty table gives no rows. Other columns are not read. One text
    larger than a shard's target leaves the shards it spans empty.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("_size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # A row's number is last, so that rows of a common id, or without one, are dealt over range partitions as well.
    order = ["_id", "_size", "_crc", "_row"]
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {"_local": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_nth": F.row_number().over(within).cast("long") - 1}
    )
    earlier, all_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        ranged.groupBy("_part")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(all_parts).alias("_total"),
        )
    )
    placed = local.join(F.broadcast(totals), "_part").select(
        *order,
        F.expr(f"cast(((_bytes_before + _local) * {int(n_shards)}) div _total as int)").alias("shard"),
        (F.col("_rows_before") + F.col("_nth")).alias("_global"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_global").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_global") - F.col("_first")).alias("slot")
    )
