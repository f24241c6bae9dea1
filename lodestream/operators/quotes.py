"""Order flow from quotes: votes on the aggressor, the tape behind cumulative totals, absorption, bursts, divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import DAY_S


def along():
    return W.partitionBy("symbol").orderBy("seq")


def votes(quotes: DataFrame, took: float = 0.8, moved: float = 0.2) -> DataFrame:
    """Adds quote_vote, pending_vote and tick_vote: 1 for a buyer who took the offer, -1 for a seller, 0 for neither.

    The quote vote tests the price against the book before it. The pending vote asks which
    resting total fell by ``took`` of the size or more while the other did not fall by
    ``moved`` of it. The tick vote is the sign of the change of price.
    """
    before = lambda c: F.lag(c).over(along())
    fell = lambda c: before(c) - F.col(c)
    size = F.col("size")
    quote = F.when(F.col("price") >= before("ask"), 1).when(F.col("price") <= before("bid"), -1).otherwise(0)
    pending = F.when((fell("ask_total") >= took * size) & (fell("bid_total") < moved * size), 1).when((fell("bid_total") >= took * size) & (fell("ask_total") < moved * size), -1).otherwise(0)
    tick = F.coalesce(F.sign(F.col("price") - before("price")).cast("int"), F.lit(0))
    return quotes.withColumns({"quote_vote": quote, "pending_vote": pending, "tick_vote": tick})


def combined(voted: DataFrame, batched: Column) -> DataFrame:
    """Adds side, method and confidence: the quote's vote, more surely if the resting totals agree; then theirs, the tick's, or the side before. ``batched`` updates count four fifths."""
    q, p, t = F.col("quote_vote"), F.col("pending_vote"), F.col("tick_vote")
    own = F.when(q != 0, q).when(p != 0, p).otherwise(t)
    carried = F.coalesce(F.last(F.when(F.col("own") != 0, F.col("own")), ignorenulls=True).over(along()), F.lit(0))
    method = F.when((q != 0) & (p == q), "quote+pending").when(q != 0, "quote").when(p != 0, "pending").when(t != 0, "tick").when(F.col("side") != 0, "carry").otherwise("none")
    sure = F.when(F.col("method") == "quote+pending", 0.9).when(F.col("method") == "quote", 0.7).when(F.col("method") == "pending", 0.6).when(F.col("method") == "tick", 0.5).when(F.col("method") == "carry", 0.4).otherwise(0.0)
    out = voted.withColumn("own", own).withColumn("side", carried).withColumn("method", method)
    return out.withColumn("confidence", sure * F.when(batched, 0.8).otherwise(1.0)).drop("own")


def tape(totals: DataFrame) -> DataFrame:
    """Trades behind a cumulative ``total`` per symbol and day: its growth, none where it was reset; the first total is the baseline.

    A quote-only update doesn't move ``ref_price``, the price of the trade before.
    """
    day = W.partitionBy("symbol", F.floor(F.col("ts_s") / DAY_S)).orderBy("seq")
    grown = totals.withColumn("traded", F.greatest(F.lit(0), F.col("total") - F.lag("total").over(day)))
    earlier = day.rowsBetween(W.unboundedPreceding, -1)
    return grown.withColumn("ref_price", F.last(F.when(F.col("traded") > 0, F.col("price")), ignorenulls=True).over(earlier))


def absorption(signed: DataFrame, tick: float, n: int = 60, pressure: float = 0.35, most_ticks: int = 4) -> DataFrame:
    """Per print whether the last ``n`` pressed to one side without moving the price."""
    last = along().rowsBetween(-(n - 1), 0)
    out = signed.withColumns({
        "pressure": F.sum(F.col("side") * F.col("size")).over(last) / F.nullif(F.sum("size").over(last), F.lit(0)),
        "span": F.max("price").over(last) - F.min("price").over(last), "held": F.count(F.lit(1)).over(last)})
    return out.withColumn("absorbing", (F.col("held") == n) & (F.abs("pressure") >= pressure) & (F.col("span") <= most_ticks * tick))


def bursts(minutes: DataFrame, times: float = 3.0, one_sided: float = 0.6) -> DataFrame:
    """Buckets (symbol, day, bar_s, volume, delta) with ``times`` the day's upper median of volume and one side's share."""
    place = F.row_number().over(W.partitionBy("symbol", "day").orderBy("volume", "bar_s"))
    of = F.count(F.lit(1)).over(W.partitionBy("symbol", "day"))
    ranked = minutes.withColumns({"place": place, "of": of})
    median = F.max(F.when(F.col("place") == F.floor(F.col("of") / 2) + 1, F.col("volume"))).over(W.partitionBy("symbol", "day"))
    out = ranked.withColumn("median", median)
    return out.where((F.col("volume") >= times * F.col("median")) & (F.abs("delta") >= one_sided * F.col("volume"))).drop("place", "of")
