"""Row numbers over any number of rows of one key, without a window that holds them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def dealt(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df sorted over all partitions, with _part (the partition, in order) and _place (the row in it, from 0)."""
    placed = df.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    return placed.withColumns({"_part": F.shiftright("_place", _ROW_BITS), "_place": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with `name` (long): each row's place among the rows of its keys by `order`, from 1; without keys, among all rows.

    Rows are dealt by range over keys and order, sorted and written once (when this is called); a row's number is its place in its
    partition, plus the key's rows in the partitions before it: one small row per partition and key. A key that a third of all rows
    have is spread like any other. Rows equal in keys and order are numbered in no defined order. Null keys are a key. Columns named _part, _place or _ahead are not allowed.
    """
    rows = materialize(dealt(df, keys, order), "numbered")
    runs = rows.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    by = (Window.partitionBy(*keys) if keys else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = runs.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.coalesce(F.sum("_rows").over(by), F.lit(0)) - F.col("_first") + 1).alias("_ahead"))
    # Without keys, one row per partition, so its size is bounded by the number of tasks.
    ahead = ahead.hint("shuffle_merge") if keys else F.broadcast(ahead)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ahead, same).withColumn(name, F.col("_ahead") + F.col("_place")).select(*df.columns, name)
