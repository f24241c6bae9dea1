"""Joins along time: as-of, nearest, at a horizon, with a cap on age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, most_age: int | None = None, strictly: bool = False) -> DataFrame:
    """Adds ``value`` of the newest ``right`` row of the same key at or before ``at``, and its age.

    Both sides meet in one shuffle by key and one sort: no pair is formed. With
    ``strictly``, a right row at the same time comes too late.
    """
    rank = 2 if strictly else 0
    l = left.withColumns({"_rank": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType), "_at": F.lit(None).cast(right.schema[at].dataType)})  # noqa: E741
    r = right.select(by, at, F.col(value).alias("_value"), F.col(at).alias("_at"), F.lit(rank).alias("_rank"))
    w = W.partitionBy(by).orderBy(at, "_rank").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumns({"_value": F.last("_value", True).over(w), "_at": F.last("_at", True).over(w)}).where("_rank = 1")
    age = F.col(at) - F.col("_at")
    fresh = F.lit(True) if most_age is None else age <= most_age
    return both.withColumns({value: F.when(fresh, F.col("_value")), "age": F.when(fresh, age)}).drop("_rank", "_value", "_at")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str, within: int) -> DataFrame:
    """Adds ``value`` of the right row nearest in time, the earlier of equals, at most ``within`` away, and its time as ``<value>_at``.

    Times are cut into cells of ``within``; right rows go to their own and both neighbouring
    cells, where two running passes find the last before and the first after: no pair is formed.
    """
    cell = F.floor(F.col(at) / within)
    l = left.withColumns({"_cell": cell, "_rank": F.lit(1)})  # noqa: E741
    known = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    r = known.select(by, at, F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("_point"), F.explode(F.array(*[cell + d for d in (-1, 0, 1)])).alias("_cell"), F.lit(0).alias("_rank"))
    run = lambda *order: F.last("_point", True).over(W.partitionBy(by, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_before", run(F.asc(at), "_rank")).withColumn("_after", run(F.desc(at), "_rank")).where("_rank = 1")
    gap = lambda p: F.abs(F.col(at) - F.col(f"{p}.at"))
    near = both.withColumn("_point", F.when(gap("_after") < gap("_before"), F.col("_after")).otherwise(F.coalesce("_before", "_after")))
    close = gap("_point") <= within
    return near.select(*left.columns, F.when(close, F.col("_point.value")).alias(value), F.when(close, F.col("_point.at")).alias(f"{value}_at"))


def at_horizon(rows: DataFrame, by: str, at: str, value: str, ahead: int) -> DataFrame:
    """Adds ``value`` exactly ``ahead`` later; gaps are never stretched."""
    later = rows.select(F.col(by), (F.col(at) - ahead).alias(at), F.col(value).alias(f"{value}_ahead"))
    return rows.join(later, [by, at], "left")


def overlay(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the live ones put over them."""
    other = [c for c in stored.columns if c not in keys]
    return stored.alias("s").join(live.alias("l"), keys, "full").select(*keys, *[F.coalesce(F.col(f"l.{c}"), F.col(f"s.{c}")).alias(c) for c in other])


def carried_back(panel: DataFrame, by: str, at: str, value: str, back: int) -> DataFrame:
    """``value`` at each point of the calendar that all keys share, else the last of ``back`` points before.

    The calendar is counted once; each key's grid is made where the key is, by place in the calendar.
    """
    calendar = panel.select(at).distinct().withColumn("_i", F.row_number().over(W.orderBy(at)))  # a row a date
    n = calendar.count()
    keys = panel.select(by).distinct().where(F.lit(n > 0))
    grid = keys.select(by, F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))).alias("_i")).join(calendar, "_i").drop("_i").join(panel, [by, at], "left")
    w = W.partitionBy(by).orderBy(at).rowsBetween(-back, 0)
    return grid.withColumn(value, F.last(value, True).over(w))
