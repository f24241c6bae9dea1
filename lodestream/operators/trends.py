"""Trends as passes over sorted bars: units held along a trend, lines through swings, stretches of balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import state

#: Fixed values of the trend rules: ages in bars, fades as shares of the peak, pullbacks in ATRs.
RUNNING, STRONG, FADING, PULL = (3, 10), 0.75, 0.5, (0.25, 1.0)


def trend_units(bars: DataFrame, k: float = 2.0, most: int = 3, order: str = "bar_s") -> DataFrame:
    """Direction and units held after each bar with a positive ATR; ``bars`` have high, low, close, atr and hist.

    A close ``k`` ATRs off the extreme turns the trend, to one unit at the next bar. While
    a trend is running and strong, a close that goes on after a pullback adds a unit at
    the next bar; once it is old and fading, units go down to one. Returns symbol, order,
    direction, units, action (that of this close), age in bars, fade, pullback.
    """

    def step(s, at, high, low, close, atr, hist):
        if s is None:
            s = {"n": 0, "d": 0, "ext": None, "since": 0, "high": high, "low": low, "peak": 0.0, "pulled": False, "units": 0, "next": None, "last": close}
        s["n"] += 1
        if s["next"] == "FLIP":
            s["units"] = 1
        elif s["next"] == "ADD":
            s["units"] = min(most, s["units"] + 1)
        elif s["next"] == "REDUCE":
            s["units"] = min(1, s["units"])
        s["next"], d = None, s["d"]
        if d == 0:
            s["high"], s["low"] = max(s["high"], high), min(s["low"], low)
            turned = 1 if close >= s["low"] + k * atr else -1 if close <= s["high"] - k * atr else 0
        elif d > 0:
            s["ext"] = max(s["ext"], high)
            turned = -1 if close <= s["ext"] - k * atr else 0
        else:
            s["ext"] = min(s["ext"], low)
            turned = 1 if close >= s["ext"] + k * atr else 0
        fade = pullback = None
        if turned:
            s |= {"d": turned, "ext": high if turned > 0 else low, "since": s["n"], "peak": 0.0, "pulled": False, "next": "FLIP"}
        elif d:
            strength = d * hist / atr
            s["peak"] = max(s["peak"], strength)
            fade = strength / s["peak"] if s["peak"] > 0 else 0.0
            age = s["n"] - s["since"]
            pullback = d * (s["ext"] - close) / atr
            s["pulled"] = s["pulled"] or PULL[0] <= pullback <= PULL[1]
            resumed = s["pulled"] and pullback < PULL[0] and d * (close - s["last"]) > 0
            if age > RUNNING[1] and fade < FADING and s["units"] > 1:
                s["next"] = "REDUCE"
            elif RUNNING[0] <= age <= RUNNING[1] and fade >= STRONG and resumed and 0 < s["units"] < most:
                s["next"], s["pulled"] = "ADD", False
        s["last"] = close
        return s, [(at, s["d"], s["units"], s["next"], s["n"] - s["since"] if s["d"] else None, fade, pullback)]

    kind = bars.schema[order].dataType.simpleString()
    return state.scan(bars.where("atr > 0"), ["symbol"], [order], [order, "high", "low", "close", "atr", "hist"], lambda: None, step,
                      f"{order} {kind}, direction int, units int, action string, age int, fade double, pullback double")


def trendlines(bars: DataFrame, k: int = 3, order: str = "bar_s") -> DataFrame:
    """Events along lines through the last two confirmed swings, falling highs and rising lows; ``bars`` have atr.

    A swing is the extreme of the ``k`` bars on both sides, known ``k`` bars later. A close
    beyond the line by a tenth of an ATR, from the other side, breaks it; any other close
    beyond it ends it without an event; a bar that comes within a quarter of an ATR and
    closes back bounces off it. A line that has ended comes back while its two swings are
    the last. Returns symbol, order, event, side, line (its value at the bar).
    """
    w = W.partitionBy("symbol").orderBy(order)
    span = w.rowsBetween(-2 * k, 0)
    whole = F.count(F.lit(1)).over(span) == 2 * k + 1
    swings = bars.withColumns({
        "_n": F.row_number().over(w) - 1,
        "_high": F.when(whole & (F.lag("high", k).over(w) == F.max("high").over(span)), F.lag("high", k).over(w)),
        "_low": F.when(whole & (F.lag("low", k).over(w) == F.min("low").over(span)), F.lag("low", k).over(w)), "_before": F.lag("close").over(w)})

    def step(s, at, n, open_, high, low, close, before, atr, top, bottom):
        if s is None:
            s = {+1: [None, None, None], -1: [None, None, None]}  # the swing before the last, the last, the line
        out = []
        for side, swing in ((+1, top), (-1, bottom)):
            held = s[side]
            # A first bar for the rule is the one after 2 k + 1 bars.
            if n > 2 * k and swing is not None:
                held[0], held[1] = held[1], (n - k, swing)
            if held[0] is not None and side * (held[0][1] - held[1][1]) > 0 and (held[2] is None or held[2][1] != held[1]):
                held[2] = (held[0], held[1])
        if n > 2 * k and atr is not None and atr > 0:
            for side in (+1, -1):
                line = s[side][2]
                if line is None:
                    continue
                (i1, p1), (i2, p2) = line
                slope = (p2 - p1) / (i2 - i1)
                now, last = p2 + slope * (n - i2), p2 + slope * (n - 1 - i2)
                beyond = side * (close - now)
                if beyond > 0.1 * atr and side * (before - last) <= 0:
                    out.append((at, "breakout" if side > 0 else "breakdown", side, now))
                    s[side][2] = None
                elif beyond > 0:
                    s[side][2] = None
                elif beyond < 0 and side * ((high if side > 0 else low) - now) >= -0.25 * atr and side * (close - open_) < 0:
                    out.append((at, "bounce_down" if side > 0 else "bounce_up", -side, now))
        return s, out

    kind = bars.schema[order].dataType.simpleString()
    return state.scan(swings, ["symbol"], [order], [order, "_n", "open", "high", "low", "close", "_before", "atr", "_high", "_low"], lambda: None, step, f"{order} {kind}, event string, side int, line double")


def balance_clusters(bars: DataFrame, by: list[str], least: int = 3, overlap: float = 0.6, height: float = 2.5, order: str = "bar_s") -> DataFrame:
    """Runs of ``least`` bars or more that rotate: each shares ``overlap`` of its range with the run's, which stays within ``height`` medians.

    Runs are taken greedily; one that ends too short gives up its first bar and is tried
    again from the next, so that at most ``least`` bars are ever held.
    """
    median = F.median(F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))).over(W.partitionBy(*by))
    rows = bars.withColumn("_most", height * median).where("_most is not null")

    def closed(s):
        return [(s["first"], s["last"], s["low"], s["high"], s["n"])] if s and s["n"] >= least else []

    def step(s, at, low, high, most):
        out, waiting = [], [(at, low, high)]
        while waiting:
            at_, lo, hi = waiting.pop(0)
            if s is None:
                s = {"first": at_, "last": at_, "low": lo, "high": hi, "n": 1, "bars": [(at_, lo, hi)]}
                continue
            shared = max(0.0, min(s["high"], hi) - max(s["low"], lo))
            low_, high_ = min(s["low"], lo), max(s["high"], hi)
            if (hi - lo <= 0 or shared / (hi - lo) >= overlap) and high_ - low_ <= most:
                s |= {"low": low_, "high": high_, "last": at_, "n": s["n"] + 1}
                if s["n"] < least:
                    s["bars"].append((at_, lo, hi))
            elif s["n"] >= least:
                out += closed(s)
                s, waiting = None, [(at_, lo, hi), *waiting]
            else:
                s, waiting = None, [*s["bars"][1:], (at_, lo, hi), *waiting]
        return s, out

    kind = bars.schema[order].dataType.simpleString()
    return state.scan(rows, by, [order], [order, "low", "high", "_most"], lambda: None, step, f"first {kind}, last {kind}, low double, high double, bars int", end=closed)


def cooled(events: DataFrame, by: list[str], order: str, wait: int) -> DataFrame:
    """Events that come ``wait`` or more after the one before that was let through."""

    def step(s, at):
        return (at, [(at,)]) if s is None or at - s >= wait else (s, [])

    return state.scan(events, by, [order], [order], lambda: None, step, f"{order} {events.schema[order].dataType.simpleString()}")
