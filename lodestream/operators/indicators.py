"""Order-dependent indicators along a series.

Exponential means and their kin are recurrences y' = a * y + b: ``state.affine`` composes
spans of a series and chains their ends, so that one long series spreads over tasks.
What does not compose (Supertrend, trend units) is a pass over the sorted series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import state

DAY_S = 86_400
#: Units of ``order`` that one task composes.
SPAN = 30 * DAY_S


def recurrence(rows: DataFrame, keep: list[str], maps: dict[str, tuple[Column, Column, Column]], order: str = "bar_s", span: int = SPAN, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return state.affine(rows, keep, maps, order, span, by)


def mean_step(x: Column, alpha: float) -> tuple[Column, Column, Column]:
    """The step of an exponential mean that its first value seeds."""
    return F.when(x.isNotNull(), 1 - alpha), alpha * x, x


def ema(rows: DataFrame, n: int, value: str = "close", order: str = "bar_s", span: int = SPAN) -> DataFrame:
    return recurrence(rows, [value], {"ema": mean_step(F.col(value), 2 / (n + 1))}, order, span)


def macd(rows: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, value: str = "close", order: str = "bar_s", span: int = SPAN) -> DataFrame:
    """fast and slow means, macd, its signal, seeded by the first macd, and the histogram."""
    x = F.col(value)
    alphas = {"fast": 2 / (fast + 1), "slow": 2 / (slow + 1), "signal": 2 / (signal + 1)}
    if signal in (fast, slow):
        out = recurrence(rows, [value], {n: mean_step(x, alphas[n]) for n in ("fast", "slow")}, order, span).withColumn("macd", F.col("fast") - F.col("slow"))
        out = recurrence(out, [value, "fast", "slow", "macd"], {"signal": mean_step(F.col("macd"), alphas["signal"])}, order, span)
    else:
        # A mean of a mean is a mix of the two single means (partial fractions), so one pass gives the signal as well.
        out = recurrence(rows, [value], {n: mean_step(x, alpha) for n, alpha in alphas.items()}, order, span)
        g = alphas["signal"]
        twice = {n: (g * (1 - alphas[n]) * F.col(n) - alphas[n] * (1 - g) * F.col("signal")) / (g - alphas[n]) for n in ("fast", "slow")}
        out = out.withColumns({"signal": twice["fast"] - twice["slow"], "macd": F.col("fast") - F.col("slow")})
    return out.withColumn("histogram", F.col("macd") - F.col("signal"))


def wilder_step(x: Column, n: int) -> tuple[Column, Column, Column]:
    """Sums up to the ``n``-th value, then their mean, then Wilder's mean; ``k`` counts the values. Nulls are passed over."""
    k = F.col("k")
    return F.when(x.isNull(), 1.0).when(k < n, 1.0).when(k == n, 1 / n).otherwise((n - 1) / n), F.coalesce(F.when(k < n, x).otherwise(x / n), F.lit(0.0)), F.lit(0.0)


def wilder(rows: DataFrame, n: int, value: str, name: str, order: str = "bar_s", span: int = SPAN) -> DataFrame:
    """Wilder's mean: seeded by the mean of the first ``n`` values, null before; nulls are passed over."""
    points = rows.withColumn("k", F.count(value).over(W.partitionBy("symbol").orderBy(order)))
    out = recurrence(points, [value, "k"], {name: wilder_step(F.col(value), n)}, order, span)
    return out.withColumn(name, F.when(F.col("k") >= n, F.col(name))).drop("k")


def rsi(rows: DataFrame, n: int = 14, value: str = "close", order: str = "bar_s", span: int = SPAN) -> DataFrame:
    """Mean-seeded Wilder RSI; 100 where there was no loss."""
    x = F.col(value)
    w = W.partitionBy("symbol").orderBy(order)
    points = rows.withColumn("_change", x - F.lag(x).over(w)).withColumn("k", F.count("_change").over(w))
    c = F.col("_change")
    gain = F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    loss = F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0)))
    out = recurrence(points, [value, "k"], {"gain": wilder_step(gain, n), "loss": wilder_step(loss, n)}, order, span)
    strength = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return out.withColumn("rsi", F.when(F.col("k") >= n, strength)).drop("k", "gain", "loss")


def kama(rows: DataFrame, fast: int = 2, slow: int = 30, value: str = "close", er: str = "er", order: str = "bar_s", span: int = SPAN) -> DataFrame:
    """Kaufman's mean of ``value``; the efficiency ratio is a column, null until known. The value itself stands in where it is null."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    c, x = F.pow(F.col(er) * (a - b) + b, F.lit(2.0)), F.col(value)
    out = recurrence(rows, [value, er], {"kama": (F.when(c.isNull(), 0.0).otherwise(1 - c), F.coalesce(c, F.lit(1.0)) * x, x)}, order, span)
    return out.withColumn("kama", F.when(F.col(er).isNotNull(), F.col("kama")))


def supertrend(rows: DataFrame, factor: float = 3.0, first: int | None = 1, order: str = "bar_s") -> DataFrame:
    """Bands of ``factor`` ATR about the middle that only tighten; the close crossing one turns the direction.

    The first known point has direction ``first``; with None, down if its close lies under the middle, else up.
    """

    def step(s, at, high, low, close, atr):
        mid = (high + low) / 2
        upper, lower = mid + factor * atr, mid - factor * atr
        if s is None:
            turn = first if first is not None else -1 if close < mid else 1
        else:
            ub, lb, turn, last = s
            upper = upper if upper < ub or last > ub else ub
            lower = lower if lower > lb or last < lb else lb
            if turn < 0 and close > upper:
                turn = 1
            elif turn > 0 and close < lower:
                turn = -1
        return (upper, lower, turn, close), [(at, high, low, close, atr, upper, lower, turn)]

    kind = rows.schema[order].dataType.simpleString()
    return state.scan(rows.where("atr is not null"), ["symbol"], [order], [order, "high", "low", "close", "atr"], lambda: None, step,
                      f"{order} {kind}, high double, low double, close double, atr double, ub double, lb double, dir int")


def pivots(daily: DataFrame) -> DataFrame:
    """Floor pivots of the bar before."""
    p = (F.col("ph") + F.col("pl") + F.col("pc")) / 3
    bc = (F.col("ph") + F.col("pl")) / 2
    return daily.withColumns({"p": p, "r1": 2 * p - F.col("pl"), "s1": 2 * p - F.col("ph"), "r2": p + F.col("ph") - F.col("pl"), "s2": p - (F.col("ph") - F.col("pl")), "bc": bc, "tc": 2 * p - bc})
