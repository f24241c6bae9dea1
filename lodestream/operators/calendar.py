"""Sessions and expiries from tables of days; a day is a number of days since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import DAY_S, OPEN_S


def weekday(day: Column) -> Column:
    """0 is Monday."""
    return (day + 3) % 7


def sessions(days: DataFrame, holidays: DataFrame, specials: DataFrame, open_s: int = OPEN_S, close_s: int = 55_800) -> DataFrame:
    """(day, open_ts, close_ts, kind): weekdays without holidays, and special sessions (day, open_s, close_s)."""
    regular = days.where(weekday(F.col("day")) < 5).join(holidays, "day", "left_anti")
    regular = regular.select("day", F.lit(open_s).alias("open_s"), F.lit(close_s).alias("close_s"), F.lit("regular").alias("kind"))
    extra = specials.join(days, "day").select("day", "open_s", "close_s", F.lit("special").alias("kind"))
    at = lambda c: (F.col("day") * DAY_S + F.col(c)).cast("long")
    return regular.unionByName(extra).select("day", at("open_s").alias("open_ts"), at("close_s").alias("close_ts"), "kind")


def in_session(ticks: DataFrame, sessions_: DataFrame) -> DataFrame:
    """Ticks of an open session with its kind. Sessions have a row a day, so they can be broadcast for any span of years."""
    by_day = ticks.withColumn("day", F.floor(F.col("ts_s") / DAY_S))
    return by_day.join(F.broadcast(sessions_), "day").where("ts_s >= open_ts and ts_s < close_ts")


def with_neighbours(sessions_: DataFrame) -> DataFrame:
    """Regular days with the regular day before and after; special sessions don't count. A row a day, in one window."""
    along = W.orderBy("day")
    return sessions_.where("kind = 'regular'").select("day", F.lag("day").over(along).alias("prev_day"), F.lead("day").over(along).alias("next_day"))


def logical_days(sessions_: DataFrame) -> DataFrame:
    """The day that each session counts as: itself, or for a special one the regular day before it."""
    regular = F.when(F.col("kind") == "regular", F.col("day"))
    return sessions_.select("day", "kind", F.last(regular, ignorenulls=True).over(W.orderBy("day")).alias("logical_day"))


def monthly_expiries(days: DataFrame, sessions_: DataFrame, expiry_weekday: int) -> DataFrame:
    """(month, by_rule, expiry): the last such weekday of each month, and the last regular day up to it."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    month = (F.year(date) * 12 + F.month(date)).alias("month")
    rule = days.where(weekday(F.col("day")) == expiry_weekday).groupBy(month).agg(F.max("day").alias("by_rule"))
    regular = sessions_.where("kind = 'regular'").select(F.col("day").alias("open_day"))
    return rule.join(F.broadcast(regular), F.col("open_day") <= F.col("by_rule")).groupBy("month", "by_rule").agg(F.max("open_day").alias("expiry"))
