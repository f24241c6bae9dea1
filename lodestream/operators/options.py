"""Aggregates over option chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def is_call():
    return F.col("option_type") == "CE"


def put_call_ratio(chain: DataFrame, by: list[str]) -> DataFrame:
    """Interest and turnover of puts over calls; null without calls."""
    side = lambda k, x: F.sum(F.when(F.col("option_type") == k, x))
    turnover = F.col("oi") * F.col("premium")
    return chain.groupBy(*by).agg((side("PE", F.col("oi")) / F.nullif(side("CE", F.col("oi")), F.lit(0.0))).alias("oi_pcr"), (side("PE", turnover) / F.nullif(side("CE", turnover), F.lit(0.0))).alias("turnover_pcr"))


def walls(chain: DataFrame, by: list[str], n: int = 4) -> DataFrame:
    """The ``n`` strikes of most interest on each side, the lower of equals first."""
    w = W.partitionBy(*by, "option_type").orderBy(F.desc("oi"), "strike")
    return chain.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def paired(chain: DataFrame, by: list[str]) -> DataFrame:
    """Strikes priced on both sides, with their straddle."""
    side = lambda k, c: F.max(F.when(F.col("option_type") == k, F.col(c)))
    out = chain.groupBy(*by, "strike").agg(side("CE", "premium").alias("call"), side("PE", "premium").alias("put"), F.max("spot").alias("spot"))
    return out.where("call is not null and put is not null").withColumn("straddle", F.col("call") + F.col("put"))


def at_the_money(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The pair whose strike is nearest the spot, the lower of equals, and its straddle over the spot."""
    place = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    return pairs.groupBy(*by).agg(F.min_by("strike", place).alias("strike"), F.min_by("straddle", place).alias("straddle"), F.max("spot").alias("spot")).withColumn("move", F.col("straddle") / F.col("spot"))


def flip_level(exposure: DataFrame, by: list[str]) -> DataFrame:
    """Where the exposure summed by ascending strike first changes sign, on the line between strikes."""
    w = W.partitionBy(*by).orderBy("strike")
    e = exposure.groupBy(*by, "strike").agg(F.sum("gex").alias("gex")).withColumn("total", F.sum("gex").over(w))
    e = e.withColumns({"before": F.lag("total").over(w), "from": F.lag("strike").over(w)})
    crossed = F.col("before") * F.col("total") < 0
    level = F.col("from") + (F.col("strike") - F.col("from")) * F.col("before") / (F.col("before") - F.col("total"))
    return e.groupBy(*by).agg(F.min_by(level, F.when(crossed, F.col("strike"))).alias("flip"), F.sum("gex").alias("net_gex"))
