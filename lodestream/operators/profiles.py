"""Profiles of a session, their value areas as they develop, and sessions measured against the areas before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import orderflow, state


def area_of(held: dict[int, float], share: float = 0.7, upward: bool = True) -> tuple[int, int, int]:
    """(point of control, low, high) of ``held``, volume by level; rules and ties as in ``orderflow.value_area``."""
    levels = sorted(held)
    volume = [held[x] for x in levels]
    middle = (levels[0] + levels[-1]) / 2
    at = max(range(len(levels)), key=lambda i: (volume[i], -abs(levels[i] - middle), levels[i]))
    low = high = at
    inside, wanted = volume[at], sum(volume) * share
    while inside < wanted and (low > 0 or high < len(levels) - 1):
        up = volume[high + 1] if high + 1 < len(levels) else -1
        down = volume[low - 1] if low else -1
        if up > down or up == down and upward:
            high, inside = high + 1, inside + up
        else:
            low, inside = low - 1, inside + down
    return levels[at], levels[low], levels[high]


def developing(touched: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """The value area after each bracket, by the brackets so far that touched a level; ``touched`` has bracket and level, once each.

    One pass over a session's brackets in order: a bracket adds to the counts of the
    levels it touched, and the area is grown anew from them. A session's levels are few.
    """

    def row(s):
        poc, low, high = area_of(s["held"], share)
        return (s["bracket"], poc, low, high, sum(s["held"].values()))

    def step(s, bracket, level):
        out = []
        if s is None:
            s = {"bracket": bracket, "held": {}}
        elif bracket != s["bracket"]:
            out, s["bracket"] = [row(s)], bracket
        s["held"][level] = s["held"].get(level, 0) + 1
        return s, out

    return state.scan(touched, by, ["bracket", "level"], ["bracket", "level"], lambda: None, step, "bracket long, poc long, val long, vah long, touches long", end=lambda s: [row(s)])


def naked(sessions: DataFrame, order: str, lookback: int = 40, most: int = 12) -> DataFrame:
    """After each session of a symbol, the points of control of earlier ones that no session since has covered.

    ``sessions`` have poc, low and high in price. A pass that holds at most ``lookback``
    levels; of those left the ``most`` newest come out. A session's own level has had no
    chance to be covered and is left out. Returns symbol, order, since, level.
    """

    def step(s, at, n, poc, low, high):
        s = [x for x in s if x[0] > n - lookback and not low <= x[2] <= high]
        out = [(at, since, level) for _, since, level in s[-most:]]
        return [*s, (n, at, poc)], out

    kind = sessions.schema[order].dataType.simpleString()
    numbered = sessions.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(order)))
    return state.scan(numbered, ["symbol"], [order], [order, "_n", "poc", "low", "high"], list, step, f"{order} {kind}, since {kind}, level double")


def typical_bins(bars: DataFrame, by: list[str], bins: int = 30) -> DataFrame:
    """(by, level, volume): volume of bars by the bin of their typical price, in ``bins`` parts of the session's typical prices."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = W.partitionBy(*by)
    b = bars.withColumn("_t", typical).withColumns({"_low": F.min("_t").over(w), "_high": F.max("_t").over(w)})
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(bins - 1), F.floor((F.col("_t") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins))).otherwise(0)
    return b.groupBy(*by, place.cast("long").alias("level")).agg(F.sum("volume").cast("double").alias("volume"))


def against_before(sessions: DataFrame, order: str) -> DataFrame:
    """Each session with ``last_poc``, ``last_val``, ``last_vah``, ``last_close``, ``last_high`` and ``last_low`` of the one before."""
    w = W.partitionBy("symbol").orderBy(order)
    return sessions.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("poc", "val", "vah", "close", "high", "low")})


def place(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "above").when(price < low, "below").when(high.isNotNull(), "in")


def row_size(spread: Column, ladder: tuple[float, ...], rows: int = 30) -> Column:
    """The smallest step of ``ladder`` that covers ``spread`` in ``rows`` rows, else its last."""
    out = None
    for step in ladder:
        out = F.when(spread <= step * rows, step) if out is None else out.when(spread <= step * rows, step)
    return out.otherwise(ladder[-1]).cast("double")


def session_areas(ticks: DataFrame, by: list[str], step: float) -> DataFrame:
    """(by, poc, val, vah in price, open, close, high, low): value area of the volume by level of ``step``, and the session's prices."""
    levels = ticks.groupBy(*by, F.floor(F.col("price") / step).alias("level")).agg(F.sum("size").cast("double").alias("volume"))
    area = orderflow.value_area(levels.where("volume > 0"), by)
    prices = ticks.groupBy(*by).agg(F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"))
    return area.join(prices, by).select(*by, (F.col("poc") * step).alias("poc"), (F.col("val") * step).alias("val"), ((F.col("vah") + 1) * step).alias("vah"), "open", "close", "high", "low")
