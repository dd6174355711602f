"""Contiguous shards of nearly equal bytes from global prefix sums of partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import stored

#: Rows that a range of the key order holds on average.
RANGE_ROWS = 1 << 16


def byte_shards(documents: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus `overhead`. Rows stand in order of doc_id
    (nulls first), then of the text's checksum and hash. A row belongs to the shard in which the
    middle of its bytes falls when the whole is cut at equal targets, so shards are contiguous and
    differ from their target by less than a row at either end. slot counts a shard's rows from 0.
    The law is `bytes`; grown_shard is null. Rows that repeat are kept, in any order among
    themselves; an empty table gives an empty result. Other columns are ignored.

    Only DataFrame functions: a range exchange of numbers (never texts), sums within a range, and
    a prefix sum over the table of ranges, which has one row for each RANGE_ROWS rows. Rows that
    are equal in all columns are salted by their input partition, so a range can be cut among
    them. The ranges are written once: they depend on a sample and must not be drawn again.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(overhead).cast("long")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = stored(rows, "shard-rows")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = ("doc_id", "text_crc32", "tie", "salt")
    ranged = stored(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "range",
        F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("range_bytes").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(within)).withColumn("at", F.count("*").over(within) - 1).join(totals, "range")
    # decimals: bytes times shards may exceed a long
    middle = (F.col("bytes_before") + F.col("upto")).cast("decimal(30,0)") * 2 - F.col("size")
    shard = F.least(F.floor(middle * shards / (F.col("total").cast("decimal(30,0)") * 2)).cast("int"), F.lit(shards - 1))
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("at")).alias("row")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
