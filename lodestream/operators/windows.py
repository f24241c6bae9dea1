"""Ordered analytics: each is one window over (symbol, order) and gives null until it has its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def over(order: str = "bar_s", by: str = "symbol"):
    return W.partitionBy(by).orderBy(order)


def rolling(x: Column, n: int, f, order: str = "bar_s", by: str = "symbol") -> Column:
    """``f`` over the last ``n`` rows, null before there are ``n``."""
    w = over(order, by).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, f(x).over(w))


def adjacent_change(x: Column, at: Column, step: int, order: str = "bar_s") -> Column:
    """Change from the previous row only where that row lies exactly one step back."""
    w = over(order)
    return F.when(at - F.lag(at).over(w) == step, x - F.lag(x).over(w))


def z_before(x: Column, n: int, order: str = "bar_s") -> Column:
    """z of the row against the ``n`` rows before it, by their population deviation."""
    w = over(order).rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def same_slot_ratio(x: Column, slot: Column, n: int, least: int, order: str = "bar_s") -> Column:
    """The row over the mean of up to ``n`` earlier rows of its slot, from ``least`` of them on."""
    w = W.partitionBy("symbol", slot).orderBy(order).rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) >= least, x / F.nullif(F.avg(x).over(w), F.lit(0.0)))


def mid_rank(x: str, tie: str, by: list[str]) -> Column:
    """(place - 0.5) / rows within the group."""
    return (F.row_number().over(W.partitionBy(*by).orderBy(x, tie)) - 0.5) / F.count(F.lit(1)).over(W.partitionBy(*by))


def average_rank(x: str, by: list[str]) -> Column:
    """Ties share the mean of their ranks."""
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*by, x)) - 1) / 2


def range_position(x: Column, n: int, order: str = "bar_s") -> Column:
    w = over(order).rowsBetween(-(n - 1), 0)
    low = F.min(x).over(w)
    return (x - low) / F.nullif(F.max(x).over(w) - low, F.lit(0.0))


def donchian(high: Column, low: Column, n: int, order: str = "bar_s") -> tuple[Column, Column]:
    w = over(order).rowsBetween(-n, -1)
    full = F.count(high).over(w) == n
    return F.when(full, F.max(high).over(w)), F.when(full, F.min(low).over(w))


def true_range(order: str = "bar_s") -> Column:
    before = F.lag("close").over(over(order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def streak(holds: Column, order: str = "bar_s") -> Column:
    """How many rows up to and with this one hold in unbroken order."""
    n = F.row_number().over(over(order))
    return n - F.coalesce(F.max(F.when(~F.coalesce(holds, F.lit(False)), n)).over(over(order)), F.lit(0))


def with_streak(rows: DataFrame, holds: Column, name: str, order: str = "bar_s") -> DataFrame:
    """Adds the streak of ``holds``; the row's place is computed first, since windows don't nest."""
    placed = rows.withColumns({"_n": F.row_number().over(over(order)), "_holds": F.coalesce(holds, F.lit(False))})
    broken = F.max(F.when(~F.col("_holds"), F.col("_n"))).over(over(order))
    return placed.withColumn(name, F.col("_n") - F.coalesce(broken, F.lit(0))).drop("_n", "_holds")


def drawdown(x: Column, order: str = "bar_s") -> tuple[Column, Column]:
    """Peak so far minus the value, and that as a share of the peak."""
    peak = F.max(x).over(over(order))
    return peak - x, (peak - x) / F.nullif(peak, F.lit(0.0))


def efficiency(x: Column, n: int, order: str = "bar_s") -> Column:
    """Net over gross travel of the last ``n`` changes; the changes must be in column ``move``."""
    w = over(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count("move").over(w) == n, F.abs(x - F.lag(x, n).over(over(order))) / F.nullif(F.sum("move").over(w), F.lit(0.0)))


def swing_high(x: Column, k: int, order: str = "bar_s") -> Column:
    """Whether the row is the highest of k rows on either side; known k rows later."""
    w = over(order).rowsBetween(-k, k)
    return (F.count(x).over(w) == 2 * k + 1) & (F.max(x).over(w) == x)


def increments(x: Column, order: str) -> Column:
    """What a cumulative counter has grown by; nothing where it was reset."""
    return F.greatest(F.lit(0), x - F.lag(x).over(over(order)))
