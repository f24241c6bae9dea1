"""Places in an order of all rows, and shares of trailing windows, without a list a row and without one task for all."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import state


def numbered(rows: DataFrame, order: list[str], folder: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the ``order`` of all: sorted by ranges, counted by range, added up over the ranges.

    The sorted rows are written below ``folder``, so that ranges are drawn once.
    """
    path = f"{folder}/lodestream/order-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order))).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(F.broadcast(counts.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def tile(place: Column, n: int, tiles: int) -> Column:
    """Which of ``tiles`` parts a place of ``n`` is in; the first parts have one row more where it doesn't come out even."""
    each, more = divmod(n, tiles)
    long = more * (each + 1)
    return F.when(place <= long, F.ceil(place / (each + 1))).otherwise(more + F.ceil((place - long) / max(1, each))).cast("long")


def trailing_share(rows: DataFrame, value: str, n: int, inclusive: bool, by: str = "symbol", order: str = "bar_s") -> DataFrame:
    """(by, order, share): the share of a trailing window's values that are at most the row's, or less than it.

    ``inclusive`` windows are the last ``n`` rows with the row's own; others the ``n``
    before it. Null values count in no window, and have no share; nor has a row whose window is empty.
    The window is kept sorted from row to row.
    """

    def step(s, at, x):
        held, window = s
        share = None
        if inclusive:
            window.append(x)
            if x is not None:
                insort(held, x)
            if len(window) > n and (old := window.popleft()) is not None:
                held.pop(bisect_left(held, old))
            if x is not None:
                share = bisect_right(held, x) / len(held)
        else:
            if x is not None and held:
                share = bisect_left(held, x) / len(held)
            window.append(x)
            if x is not None:
                insort(held, x)
            if len(window) > n and (old := window.popleft()) is not None:
                held.pop(bisect_left(held, old))
        return s, [(at, share)]

    kind = rows.schema[order].dataType.simpleString()
    return state.scan(rows, [by], [order], [order, value], lambda: ([], deque()), step, f"{order} {kind}, share double")
