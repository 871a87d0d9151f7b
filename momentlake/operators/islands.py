"""Ordered-sequence helpers that don't put a whole source into one task.

A running value over a source's rows is computed in two levels: a window within time chunks, and a window over one row per chunk,
whose totals are carried in. A source with a third of all rows is thus spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import once

CHUNK_SECONDS = 4096.0


def running_before(df: DataFrame, keys: list[str], time: str, order: list[str], kind: str, value: Column, name: str, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """df with `name`: over the rows of the same keys before this one (by time, then order), the `max`, the `sum`, or the `last` non-null of value.

    The rows are read twice, for the chunks' totals and for the values, so costly input is written first. `last` wants a value that is null or a struct; it keeps the struct of the latest row. Rows with equal (time, order) have no defined order.
    """
    df = once(df).withColumns({"_chunk": F.floor(F.col(time) / chunk), "_value": value})
    place = F.struct(time, *order)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    total = {"max": F.max("_value"), "sum": F.sum("_value"), "last": F.max_by("_value", F.when(F.col("_value").isNotNull(), place))}[kind]
    carried = df.groupBy(*keys, "_chunk").agg(total.alias("_total")).withColumn("_carried", local(F.col("_total")).over(ahead)).drop("_total")
    both = df.withColumn("_local", local(F.col("_value")).over(inside)).join(carried.hint("shuffle_merge"), [*keys, "_chunk"])
    joined = {"max": F.greatest("_local", "_carried"), "sum": F.coalesce("_local", F.lit(0)) + F.coalesce("_carried", F.lit(0)), "last": F.coalesce("_local", "_carried")}[kind]
    return both.withColumn(name, joined).drop("_chunk", "_value", "_local", "_carried")


def with_previous(df: DataFrame, keys: list[str], time: str, order: list[str], columns: list[str], name: str = "prev", chunk: float = CHUNK_SECONDS) -> DataFrame:
    """df with a struct of the row before (null for the first)."""
    return running_before(df, keys, time, order, "last", F.struct(*columns), name, chunk)


def with_island(df: DataFrame, keys: list[str], time: str, order: list[str], opens: Column, name: str = "island", chunk: float = CHUNK_SECONDS) -> DataFrame:
    """df with an island's name: the (time, order) of the row that opened it; `opens` must hold for each key's first row."""
    place = F.struct(time, *order)
    before = running_before(df.withColumn("_opens", opens), keys, time, order, "last", F.when(F.col("_opens"), place), "_before", chunk)
    return before.withColumn(name, F.when(F.col("_opens"), place).otherwise(F.col("_before"))).drop("_opens", "_before")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def fold_sorted(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple | list | None], schema: str, finish: Callable[[object], list] | None = None) -> DataFrame:
    """Rows of step(state, row) over each key's rows in order, then of finish(state); state begins with start() at each key's first row.

    step gives a row, a list of rows or None; it sees the values of keys and columns. Keys are dealt by hash and sorted within
    partitions, and rows stream through, so only the state costs memory, and many small keys cost no call each.
    """
    n, wanted = len(keys), [*keys, *columns]
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*wanted)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in parts:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if last is None or row[:n] != last:
                    if last is not None and finish is not None:
                        out += finish(state)
                    last, state = row[:n], start()
                made = step(state, row)
                if made is not None:
                    out += made if isinstance(made, list) else [made]
            yield pd.DataFrame(out, columns=names)
        if last is not None and finish is not None:
            yield pd.DataFrame(finish(state), columns=names)

    return dealt.mapInPandas(run, schema)
