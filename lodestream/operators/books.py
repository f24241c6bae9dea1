"""Books of trades: FIFO matching, daily results, equity and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import state


def fifo(fills: DataFrame) -> DataFrame:
    """Exit slices: each sold quantity matched with the earliest unmatched bought one of its symbol.

    Buys and sells are intervals of a running quantity, and a slice is where two overlap.
    Both kinds of interval ends are laid in one order per symbol, and each stretch between
    ends takes the buy and the sell that cover it: a sort, not a join of intervals.
    """
    order = W.partitionBy("symbol", "side").orderBy("seq")
    ends = fills.withColumn("end", F.sum("quantity").over(order))
    buys = ends.where("side = 'BUY'").select("symbol", "end", F.col("price").alias("bought_at"), F.lit(None).cast("double").alias("sold_at"), F.lit(None).cast("date").alias("day"), F.lit(0).alias("kind"))
    sells = ends.where("side = 'SELL'").select("symbol", "end", F.lit(None).cast("double").alias("bought_at"), F.col("price").alias("sold_at"), "day", F.lit(1).alias("kind"))
    w = W.partitionBy("symbol").orderBy("end", "kind")
    after = w.rowsBetween(0, W.unboundedFollowing)
    both = buys.unionByName(sells)
    both = both.withColumns({
        "quantity": F.col("end") - F.coalesce(F.lag("end").over(w), F.lit(0.0)),
        "bought_at": F.first("bought_at", True).over(after), "sold_at": F.first("sold_at", True).over(after), "day": F.first("day", True).over(after)})
    return both.where("quantity > 0 and bought_at is not null and sold_at is not null").select(
        "symbol", "day", "quantity", "bought_at", "sold_at", (F.col("quantity") * (F.col("sold_at") - F.col("bought_at"))).alias("pnl"))


def daily(slices: DataFrame) -> DataFrame:
    return slices.groupBy("day").agg(F.sum("pnl").alias("realised"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"))


def roll_up(days: DataFrame) -> DataFrame:
    """Results of each month, each year and all."""
    return days.rollup(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("realised").alias("realised"), F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.max("realised").alias("best_day"), F.min("realised").alias("worst_day"))


def trade_stats(slices: DataFrame, by: list[str]) -> DataFrame:
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))
    loss = -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return slices.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.sum("pnl").alias("net"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"))


def charges() -> Column:
    """Charges of a fill: 0.1 % on sells, 0.05 % exchange on both sides, 18 % tax on the exchange's part."""
    value = F.col("quantity") * F.col("price")
    exchange = value * 0.0005
    return F.when(F.col("side") == "SELL", value * 0.001).otherwise(0.0) + exchange + exchange * 0.18


def with_charges(fills: DataFrame) -> DataFrame:
    return fills.withColumn("charges", charges())


def position_book(fills: DataFrame, order: list[str]) -> DataFrame:
    """The position of each symbol after each fill (side, quantity, price, fees), and what the fill closed.

    A fill against the position closes at the average price; one through zero begins a new
    position with the rest. Fees count against the result when they are paid; a closed
    slice bears its share of the entry's fees and of its own. The excursion is the
    least and greatest price of the position's fills so far, the closing one included.
    """

    def step(s, *p):
        *at, side, quantity, price, fees = p
        held, average, realised, entry, low, high = s
        signed = quantity if side == "BUY" else -quantity
        after = held + signed
        closed = gross = borne = None
        if held == 0 or (held > 0) == (signed > 0):
            average = price if held == 0 else (average * abs(held) + price * abs(signed)) / abs(after)
            low, high = (price, price) if held == 0 else (min(low, price), max(high, price))
            entry = fees if held == 0 else entry + fees
        else:
            closed = min(abs(held), abs(signed))
            gross = (price - average) * closed * (1 if held > 0 else -1)
            share, own = entry * closed / abs(held), fees * closed / abs(signed)
            borne, realised, entry = share + own, realised + gross, entry - share
            low, high = min(low, price), max(high, price)
        realised -= fees
        row = (*at, after, None if after == 0 else average, realised, closed, gross, borne, low, high)
        if closed is not None and after == 0:
            average, entry, low, high = 0.0, 0.0, None, None
        elif closed is not None and (after > 0) != (held > 0):
            average, entry, low, high = price, fees - own, price, price
            row = (*at, after, average, realised, closed, gross, borne, *row[-2:])
        return (after, average, realised, entry, low, high), [row]

    kinds = ", ".join(f"{c} {fills.schema[c].dataType.simpleString()}" for c in order)
    return state.scan(fills, ["symbol"], order, [*order, "side", "quantity", "price", "fees"], lambda: (0.0, 0.0, 0.0, 0.0, None, None), step,
                      f"{kinds}, held double, average double, realised double, closed double, gross double, fees double, low double, high double")
