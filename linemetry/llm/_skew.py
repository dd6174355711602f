"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least one in HOT of all rows, so HOT of them at most, are joined by broadcast.
HOT = 4096


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of `left` with `right`, which has one row for each key and, as `weight`, how many
    rows of `left` the key has (at least; it is read twice, so it should be a stored table).

    Hot keys are broadcast, so their rows stay where they are; all others are shuffled. Rows with
    a null key are left out, as by any inner join."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(HOT) >= F.lit(total)
    hot = right.where(is_hot)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~is_hot), keys)
    return left.join(F.broadcast(hot), keys).unionByName(others)
