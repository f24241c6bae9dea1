"""Order flow: sides of prints, imbalance of books, price ladders and their value areas."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _by(order: str):
    return W.partitionBy("symbol").orderBy(order)


def classified(ticks: DataFrame, half_spread: float = 0.05, order: str = "seq") -> DataFrame:
    """Adds side (-1, 0, 1), method and confidence of each print.

    A print at or beyond the quote before it takes the quote's side; else one more than
    a quarter of the half-spread off the middle takes that side; else the sign of the
    price change. A print without evidence of its own takes the last side there was:
    that carry is a window, not a recursion, since it depends on own evidence only.
    """
    w = _by(order)
    mid = F.lag("price").over(w)
    t = ticks.withColumn("mid", mid)
    off = F.col("price") - F.col("mid")
    quote = F.when(off >= half_spread, 1).when(off <= -half_spread, -1)
    middle = F.when(off > half_spread / 4, 1).when(off < -half_spread / 4, -1)
    tick = F.signum(off).cast("int")
    t = t.withColumn("own", F.coalesce(quote, middle, F.nullif(tick, F.lit(0))))
    t = t.withColumn("side", F.coalesce(F.last("own", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    method = F.when(quote.isNotNull(), "quote").when(middle.isNotNull(), "mid").when(F.col("own").isNotNull(), "tick").when(F.col("side") != 0, "carry").otherwise("none")
    return t.withColumn("method", method).withColumn("confidence", F.when(F.col("method") == "quote", 0.9).when(F.col("method") == "mid", 0.7).when(F.col("method") == "tick", 0.6).when(F.col("method") == "carry", 0.4).otherwise(0.0)).drop("mid", "own")


def flow(prints: DataFrame, by: list[Column | str]) -> DataFrame:
    """Volume by side, delta, confidence-weighted delta and the classified share, null without volume."""
    size, side = F.col("size"), F.col("side")
    return prints.groupBy(*by).agg(
        F.sum(F.when(side > 0, size).otherwise(0)).alias("buy"), F.sum(F.when(side < 0, size).otherwise(0)).alias("sell"),
        F.sum(size).alias("volume"), F.sum(side * size).alias("delta"), F.sum(side * size * F.col("confidence")).alias("weighted_delta"),
        (F.sum(F.when(side != 0, size).otherwise(0)) / F.nullif(F.sum(size), F.lit(0))).alias("classified_share"))


def book_imbalance(books: DataFrame, order: str = "seq") -> DataFrame:
    """What each change of the best bid and ask adds to the order-flow imbalance; crossed and empty books are passed over."""
    valid = books.where("bid > 0 and ask > bid")
    w = _by(order)
    pb, pa, pbq, paq = (F.lag(c).over(w) for c in ("bid", "ask", "bid_qty", "ask_qty"))
    bid = F.when(F.col("bid") > pb, F.col("bid_qty")).when(F.col("bid") == pb, F.col("bid_qty") - pbq).otherwise(-pbq)
    ask = F.when(F.col("ask") < pa, F.col("ask_qty")).when(F.col("ask") == pa, F.col("ask_qty") - paq).otherwise(-paq)
    return valid.withColumn("ofi", F.when(pb.isNotNull(), bid - ask))


def with_volume(ladder: DataFrame) -> DataFrame:
    return ladder.withColumn("volume", F.col("buy") + F.col("sell") + F.col("unclassified"))


def value_area(ladder: DataFrame, by: list[str], share: float = 0.7, upward: bool = True) -> DataFrame:
    """Point of control and value area of each profile (level, volume).

    The point of control has most volume; of equals it is nearest the middle, then the
    higher. From there the area grows by the larger neighbour, on a tie ``upward`` or not, until it
    holds ``share`` of the volume. A profile's levels are few: they are one array.
    """
    levels = F.sort_array(F.collect_list(F.struct("level", "volume")))
    p = ladder.groupBy(*by).agg(levels.alias("l"), F.sum("volume").alias("total"), ((F.min("level") + F.max("level")) / 2).alias("mid"))
    best = F.array_max(F.transform("l", lambda x: F.struct(x["volume"].alias("v"), (-F.abs(x["level"] - F.col("mid"))).alias("d"), x["level"].alias("level"))))
    p = p.withColumn("poc", best["level"]).withColumn("at", F.array_position(F.transform("l", lambda x: x["level"]), F.col("poc")).cast("int"))
    volume = lambda i: F.coalesce(F.get(F.col("l"), i - 1)["volume"], F.lit(-1.0))
    start = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), volume(F.col("at")).alias("held"))

    def grow(s: Column, _: Column) -> Column:
        up, down = volume(s["hi"] + 1), F.when(s["lo"] > 1, volume(s["lo"] - 1)).otherwise(-1.0)
        done = (s["held"] >= F.col("total") * share) | ((up < 0) & (down < 0))
        rise = up >= down if upward else up > down
        return F.struct(
            F.when(done | rise, s["lo"]).otherwise(s["lo"] - 1).alias("lo"), F.when(done | ~rise, s["hi"]).otherwise(s["hi"] + 1).alias("hi"),
            F.when(done, s["held"]).when(rise, s["held"] + up).otherwise(s["held"] + down).alias("held"))

    p = p.withColumn("va", F.aggregate(F.sequence(F.lit(1), F.size("l")), start, grow))
    level = lambda i: F.get(F.col("l"), i - 1)["level"]
    return p.select(*by, "poc", level(F.col("va.lo")).alias("val"), level(F.col("va.hi")).alias("vah"), "total")


def diagonal_imbalance(ladder: DataFrame, by: list[str], ratio: float = 3.0, floor: float = 20.0) -> DataFrame:
    """Levels where buying outweighs the selling one level below, or selling the buying one above, by ``ratio``."""
    w = W.partitionBy(*by).orderBy("level")
    below = F.when(F.lag("level").over(w) == F.col("level") - 1, F.lag("sell").over(w)).otherwise(0.0)
    above = F.when(F.lead("level").over(w) == F.col("level") + 1, F.lead("buy").over(w)).otherwise(0.0)
    edge_low, edge_high = F.lag("level").over(w).isNull(), F.lead("level").over(w).isNull()
    return ladder.withColumns({
        "buy_imbalance": F.when(edge_low, None).otherwise((F.col("buy") >= floor) & (F.col("buy") >= ratio * below)),
        "sell_imbalance": F.when(edge_high, None).otherwise((F.col("sell") >= floor) & (F.col("sell") >= ratio * above))})


def stacked(flagged: DataFrame, by: list[str], flag: str, least: int = 3) -> DataFrame:
    """Runs of ``least`` flagged levels or more without a gap."""
    w = W.partitionBy(*by).orderBy("level")
    run = flagged.where(F.col(flag)).withColumn("island", F.col("level") - F.row_number().over(w))
    return run.groupBy(*by, "island").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count(F.lit(1)).alias("levels")).where(F.col("levels") >= least).drop("island")


def low_volume_nodes(ladder: DataFrame, by: list[str], share: float = 0.15) -> DataFrame:
    """Levels less traded than both neighbours and than ``share`` of the busiest."""
    w = W.partitionBy(*by).orderBy("level")
    up, down = F.lead("volume").over(w), F.lag("volume").over(w)
    near = (F.lag("level").over(w) == F.col("level") - 1) & (F.lead("level").over(w) == F.col("level") + 1)
    most = F.max("volume").over(W.partitionBy(*by))
    return ladder.withColumn("node", near & (F.col("volume") < up) & (F.col("volume") < down) & (F.col("volume") <= share * most)).where("node").drop("node")


def large_prints(ticks: DataFrame, seconds: int = 86_400, multiple: float = 2.0, least: int = 30) -> DataFrame:
    """Prints of at least ``multiple`` times the upper median of the sizes of the ``seconds`` before.

    A task holds one symbol's prints of ``seconds`` and, as guests, those of as many before;
    the sizes in the window are kept in order, so a print costs a search and a shift.
    """
    part = F.floor(F.col("ts_s") / seconds)
    rows = ticks.select("symbol", "seq", "ts_s", "size", F.explode(F.array(part, part + 1)).alias("part"), part.alias("own"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_s", kind="stable")
        at, size = pdf["ts_s"].tolist(), pdf["size"].tolist()
        held: list[int] = []
        out, low, high = [None] * len(at), 0, 0
        for i, t in enumerate(at):
            while high < len(at) and at[high] < t:
                insort(held, size[high])
                high += 1
            while low < high and at[low] < t - seconds:
                held.pop(bisect_left(held, size[low]))
                low += 1
            if len(held) >= least and size[i] >= multiple * held[len(held) // 2]:
                out[i] = held[len(held) // 2]
        pdf["median"] = pd.array(out, "Int64")
        return pdf.loc[(pdf["part"] == pdf["own"]) & pdf["median"].notna(), ["symbol", "seq", "ts_s", "size", "median"]]

    kinds = {f.name: f.dataType.simpleString() for f in ticks.schema}
    return rows.groupBy("symbol", "part").applyInPandas(found, f"symbol {kinds['symbol']}, seq {kinds['seq']}, ts_s long, size long, median long")
