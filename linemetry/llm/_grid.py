"""A stated query set against all rows of a vector table, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def finite(vector: str):
    """Whether a vector is neither null nor empty and has no null or non-finite component."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~wrong, F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, kernel: Callable, ascending: bool, block_rows: int, block_queries: int, least_cells: int) -> DataFrame:
    """query_id, rank, vec_id, value from `vectors` and `queries` (vec_id, embedding).

    Rows and queries are cut into blocks by hash, of about `block_rows` and `block_queries`; a
    cell is one block of each. `kernel(query numbers, query ids, query vectors, row ids, row
    vectors)` returns its best k for each query: arrays of query number, row id, value. A query
    meets each row in one cell; vectors of another length than the query's never meet it (blocks
    hold one length). Small tables are cut by their queries, to have `least_cells`. Cells keep k
    rows for each query, and the ranking reduces them before its shuffle (window group limit).
    Queries are numbered, so those with equal ids are ranked apart.
    """
    queries = queries.withColumn("number", F.monotonically_increasing_id())
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("rows"))
    asked = queries.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("asked"))
    row_blocks = F.ceil(F.col("rows") / block_rows)
    plan = lengths.join(asked, "dim").select("dim", row_blocks.cast("int").alias("row_blocks"), F.greatest(F.ceil(F.col("asked") / block_queries), F.least(F.ceil(least_cells / row_blocks), F.col("asked"))).cast("int").alias("query_blocks"))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.withColumn("dim", F.size("embedding")).join(plan, "dim").withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(f"{own}s")).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("row_blocks", "query_blocks")

    keys = ("dim", "row_block", "query_block")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            n, q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
        else:
            ids, numbers, asked = right.column("vec_id").to_numpy(), left.column("number").to_numpy(), left.column("vec_id").to_numpy()
            order, by = np.argsort(ids, kind="stable"), np.argsort(numbers)
            n, v, s = kernel(numbers[by], asked[by], np.stack(matrix(left.column("embedding")))[by], ids[order], np.stack(matrix(right.column("embedding")))[order])
            q = asked[by][np.searchsorted(numbers[by], n)]
        return pa.table([pa.array(n, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["number", "query_id", "vec_id", "value"])

    found = side(queries, "query_block", "row_block").groupBy(*keys).cogroup(side(vectors, "row_block", "query_block").groupBy(*keys)).applyInArrow(cell, "number long, query_id long, vec_id long, value double")
    direction = F.asc("value") if ascending else F.desc("value")
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(direction, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "value")
