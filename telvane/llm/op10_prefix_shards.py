"""Sharding by global byte-size prefix sums.

Rows are ordered by doc_id (nulls first), then size and checksum, and put into ranges of that order. Each range's total
size and count, summed over the ranges before it, shifts the running sums inside the range, which gives every row its
place in the global sums without a global sort in one task. A row belongs to the shard in whose equal share of the
total the middle of its bytes falls, so shards are contiguous and each misses its target by less than the largest row.
Slots count the rows of a shard from 0.

A null text has size 1, like an empty one. Rows that tie in everything are interchangeable; a salt spreads them over
ranges. Columns that are passed in travel with their rows. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telvane.llm.common import Scratch


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1 for the separator) and text_crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard(rows: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, ...) with shard and slot."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "shards")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("__salt")]
    ranged = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096))).repartitionByRange(ranges, *order)
    ranged = scratch.settle(ranged.withColumn("__range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select(
        "__range", F.coalesce(F.sum("__bytes").over(earlier), F.lit(0)).alias("__bytes_before"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before")
    )
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    inside = Window.partitionBy("__range").orderBy(*order)
    placed = ranged.join(F.broadcast(totals), "__range")  # as many rows as ranges
    middle = 2 * (F.col("__bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    at = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(1, 2 * total)))).cast("int")
    placed = placed.select(*rows.columns, (F.col("__rows_before") + F.row_number().over(inside) - 1).alias("__row"), at.alias("shard"))
    placed = scratch.settle(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    out = placed.join(F.broadcast(firsts), "shard")  # at most one row per shard
    scratch.drop(ranged)
    return out.select(*rows.columns, "shard", (F.col("__row") - F.col("__first")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write the documents as one folder per shard, in slot order within each file."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text))
    shard(rows, shards).repartitionByRange(8 * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
