"""Bars, buckets and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import DAY_S, OPEN_S


def bucket(ts_s: Column, seconds: int, anchor_s: int = 0) -> Column:
    """Start of the bucket, counted from ``anchor_s`` seconds after midnight."""
    day = F.floor(ts_s / DAY_S) * DAY_S
    if DAY_S % seconds:
        return F.floor((ts_s - anchor_s) / seconds) * seconds + anchor_s
    start = F.floor((ts_s - day - anchor_s) / seconds) * seconds
    return day + anchor_s + start


def bars(ticks: DataFrame, seconds: int, anchor_s: int = 0) -> DataFrame:
    """Open, high, low, close and volume per symbol and bucket; one shuffle, summed partially first."""
    return ticks.groupBy("symbol", bucket(F.col("ts_s"), seconds, anchor_s).alias("bar_s")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"))


def resample(finer: DataFrame, seconds: int, anchor_s: int = 0) -> DataFrame:
    """Coarser bars from finer ones; a short last bar stays. ``parts`` counts the bars merged."""
    return finer.groupBy("symbol", bucket(F.col("bar_s"), seconds, anchor_s).alias("bar_s")).agg(
        F.min_by("open", "bar_s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_s").alias("close"), F.sum("volume").alias("volume"), F.count_distinct("bar_s").alias("parts"))


def complete(resampled: DataFrame, parts: int) -> DataFrame:
    """Only bars all of whose constituents are there."""
    return resampled.where(F.col("parts") == parts)


def cents(price: Column) -> Column:
    """A price of whole cents as a number of them, so that sums are exact in any order."""
    return F.round(price * 100).cast("long")


def exact_mean(total: Column, weight: Column, scale: int = 100) -> Column:
    """``total`` / (``scale`` * ``weight``), whole numbers both, to six digits, halves up; null without weight."""
    t, w = total.cast("decimal(28,0)"), weight.cast("decimal(24,0)")
    return F.when(weight > 0, F.call_function("div", t * F.lit(2_000_000).cast("decimal(7,0)") + w * F.lit(scale), w * F.lit(2 * scale)) / 1e6)


def vwap(ticks: DataFrame, seconds: int = DAY_S) -> DataFrame:
    """Mean price by size of each bucket, from sums in cents."""
    traded = F.sum(cents(F.col("price")) * F.col("size"))
    return ticks.groupBy("symbol", bucket(F.col("ts_s"), seconds).alias("bar_s")).agg(exact_mean(traded, F.sum("size")).alias("vwap"))


def vwap_to_date(bars_: DataFrame) -> DataFrame:
    """Session VWAP so far over typical prices; the close where nothing has traded."""
    day = W.partitionBy("symbol", F.floor(F.col("bar_s") / DAY_S)).orderBy("bar_s")
    thrice = cents(F.col("high")) + cents(F.col("low")) + cents(F.col("close"))
    mean = exact_mean(F.sum(thrice * F.col("volume")).over(day), F.sum("volume").over(day), 300)
    return bars_.withColumn("vwap", F.coalesce(mean, F.round("close", 6)))


def last_per_bucket(rows: DataFrame, seconds: int) -> DataFrame:
    """The last tick of each bucket."""
    return rows.groupBy("symbol", bucket(F.col("ts_s"), seconds).alias("bar_s")).agg(F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq"))


def opening_range(bars_: DataFrame, seconds: int) -> DataFrame:
    """High and low of each session's first ``seconds``, and whether the close ended above, within or below."""
    since = F.col("bar_s") % DAY_S
    day = F.floor(F.col("bar_s") / DAY_S)
    early = since < seconds
    out = bars_.groupBy("symbol", day.alias("day")).agg(
        F.max(F.when(early, F.col("high"))).alias("or_high"), F.min(F.when(early, F.col("low"))).alias("or_low"),
        F.max_by("close", "bar_s").alias("close"))
    return out.withColumn("side", F.when(F.col("close") > F.col("or_high"), "above").when(F.col("close") < F.col("or_low"), "below").when(F.col("or_high").isNotNull(), "within"))


def breadth(flags: DataFrame) -> DataFrame:
    """Per bar how many symbols there are and how many closed above their open."""
    return flags.groupBy("bar_s").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("close") > F.col("open")).alias("rising"))


def print_sizes(ticks: DataFrame, at_least: int = 20) -> DataFrame:
    """Count, volume, notional, exact quantiles and largest size per symbol and day."""
    day = F.floor(F.col("ts_s") / DAY_S).alias("day")
    q = lambda p: F.percentile("size", F.lit(p))
    return ticks.groupBy("symbol", day).agg(
        F.count(F.lit(1)).alias("prints"), F.sum("size").alias("volume"), F.sum(F.col("size") * F.col("price")).alias("notional"),
        q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("size").alias("largest")).where(F.col("prints") >= at_least)


SESSION_OPEN_S = OPEN_S
