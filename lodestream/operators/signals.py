"""Signals: rotation against a benchmark, previews of an open bar, entry rules by name, and a table function of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.functions import udtf

from . import bars as B, indicators as I, windows as R

DAY_S = 86_400


def z_about_100(x: Column, n: int, order: str = "bar_s") -> Column:
    """100 and the z of the last of ``n`` values among them, 100 where they are flat; null before there are ``n``."""
    w = W.partitionBy("symbol").orderBy(order).rowsBetween(-(n - 1), 0)
    sd = F.stddev_pop(x).over(w)
    return F.when(F.count(x).over(w) == n, F.when(sd > 0, 100 + (x - F.avg(x).over(w)) / sd).otherwise(100.0))


def rotation(closes: DataFrame, benchmark: str, smooth: int = 5, window: int = 14, momentum: int = 3, order: str = "bar_s") -> DataFrame:
    """(symbol, order, ratio, momentum, quadrant) of each symbol against ``benchmark``, at the times that both have.

    The ratio is the z of the smoothed relative price, the momentum the smoothed z of its
    changes; both lie about 100. Rows before a window is full are left out.
    """
    bench = closes.where(F.col("symbol") == benchmark).select(order, F.col("close").alias("_b"))
    both = closes.where(F.col("symbol") != benchmark).join(bench, order).where("_b > 0")
    rs = I.ema(both.withColumn("rs", 100 * F.col("close") / F.col("_b")), smooth, "rs", order)
    ratio = rs.withColumn("ratio", z_about_100(F.col("ema"), window, order)).where("ratio is not null").select("symbol", order, "ratio")
    w = W.partitionBy("symbol").orderBy(order)
    change = ratio.withColumn("change", F.col("ratio") - F.lag("ratio").over(w)).where("change is not null")
    z = change.withColumn("z", z_about_100(F.col("change"), window, order)).where("z is not null")
    out = I.ema(z.select("symbol", order, "z"), momentum, "z", order).select("symbol", order, F.col("ema").alias("momentum")).join(ratio, ["symbol", order])
    quadrant = F.when((F.col("ratio") >= 100) & (F.col("momentum") >= 100), "leading").when(F.col("ratio") >= 100, "weakening").when(F.col("momentum") >= 100, "improving").otherwise("lagging")
    return out.select("symbol", order, "ratio", "momentum", quadrant.alias("quadrant"))


def macd_preview(bars: DataFrame, price: Column, fast: int = 12, slow: int = 26, signal: int = 9, order: str = "bar_s") -> DataFrame:
    """What MACD would be if the open bar closed at ``price``, without taking it in, and the price at which it would be zero.

    One step from the state after the bar before; a series' first bar has no state and no row.
    """
    a, b, c = (2 / (n + 1) for n in (fast, slow, signal))
    w = W.partitionBy("symbol").orderBy(order)
    before = I.macd(bars, fast, slow, signal, order=order).select("symbol", order, "fast", "slow", "signal")
    held = bars.join(before, ["symbol", order]).withColumns({f"_{n}": F.lag(n).over(w) for n in ("fast", "slow", "signal")}).where("_fast is not null")
    f, s = F.col("_fast") + a * (price - F.col("_fast")), F.col("_slow") + b * (price - F.col("_slow"))
    out = held.withColumns({"preview": f - s, "preview_signal": F.col("_signal") + c * (f - s - F.col("_signal"))})
    zero = (F.col("_slow") * (1 - b) - F.col("_fast") * (1 - a)) / (a - b)
    return out.select("symbol", order, "preview", "preview_signal", (F.col("_fast") - F.col("_slow")).alias("previous"), zero.alias("zero_price"))


def rsi_of_means(bars: DataFrame, n: int = 14, value: str = "close", order: str = "bar_s") -> DataFrame:
    """RSI of exponential means of weight 1 / ``n`` that the first change seeds; 100 where there was no loss."""
    x = F.col(value)
    c = x - F.lag(x).over(W.partitionBy("symbol").orderBy(order))
    moved = bars.withColumn("_c", c).where("_c is not null")
    gain, loss = F.greatest(F.col("_c"), F.lit(0.0)), F.greatest(-F.col("_c"), F.lit(0.0))
    out = I.recurrence(moved, [value], {"gain": I.mean_step(gain, 1 / n), "loss": I.mean_step(loss, 1 / n)}, order)
    return out.withColumn("rsi", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))))


# Entry rules by name: each takes bars and its own parameters and gives (symbol, bar_s) of its entries.

RULES: dict[str, Callable[..., DataFrame]] = {}


def rule(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers an entry rule under its function's name."""
    RULES[f.__name__] = f
    return f


def _session():
    return W.partitionBy("symbol", F.floor(F.col("bar_s") / DAY_S)).orderBy("bar_s")


@rule
def macd_cross(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD rises through zero, after ``slow`` + 1 bars."""
    w = R.over()
    m = I.macd(bars, fast, slow, signal).withColumns({"before": F.lag("macd").over(w), "n": F.row_number().over(w)})
    return m.where((F.col("before") <= 0) & (F.col("macd") > 0) & (F.col("n") > slow + 1)).select("symbol", "bar_s")


@rule
def opening_range_break(bars: DataFrame, seconds: int = 14_400) -> DataFrame:
    """The first close of a session above the high of its first ``seconds``."""
    early = F.col("bar_s") % DAY_S < seconds
    day = F.floor(F.col("bar_s") / DAY_S)
    b = bars.withColumns({"day": day, "top": F.max(F.when(early, F.col("high"))).over(W.partitionBy("symbol", day))})
    return b.where(~early & (F.col("close") > F.col("top"))).groupBy("symbol", "day").agg(F.min("bar_s").alias("bar_s")).select("symbol", "bar_s")


@rule
def vwap_reclaim(bars: DataFrame, confirm: int = 2) -> DataFrame:
    """``confirm`` closes above the session's VWAP after one that was not."""
    b = B.vwap_to_date(bars).withColumn("above", (F.col("close") > F.col("vwap")).cast("int"))
    held = F.min("above").over(_session().rowsBetween(-(confirm - 1), 0))
    return b.withColumns({"held": held, "before": F.lag("above", confirm).over(_session())}).where("held = 1 and before = 0").select("symbol", "bar_s")


@rule
def channel_break(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """A close above the highs of the ``lookback`` bars before."""
    w = R.over().rowsBetween(-lookback, -1)
    return bars.withColumns({"top": F.max("high").over(w), "n": F.count("high").over(w)}).where((F.col("n") == lookback) & (F.col("close") > F.col("top"))).select("symbol", "bar_s")


@rule
def ignition(bars: DataFrame, volume: float = 2.0, reach: float = 1.2, lookback: int = 20) -> DataFrame:
    """A rising bar of ``volume`` times the usual volume and ``reach`` times the ATR."""
    w = R.over().rowsBetween(-lookback, -1)
    tr = bars.withColumn("tr", R.true_range())
    b = tr.withColumns({"usual": F.avg("volume").over(w), "n": F.count("volume").over(w), "atr": R.rolling(F.col("tr"), 14, F.avg)})
    return b.where((F.col("n") == lookback) & (F.col("volume") >= volume * F.col("usual")) & (F.col("close") > F.col("open")) & (F.col("high") - F.col("low") >= reach * F.col("atr"))).select("symbol", "bar_s")


@rule
def pullback(bars: DataFrame, n: int = 2, threshold: float = 10.0, trend: int = 50) -> DataFrame:
    """RSI of ``n`` comes back through ``threshold`` while the close is above its mean of ``trend``, after ``trend`` bars."""
    w = R.over()
    r = I.rsi(bars, n).select("symbol", "bar_s", "close", "rsi")
    r = r.join(I.ema(bars, trend).select("symbol", "bar_s", "ema"), ["symbol", "bar_s"]).withColumns({"before": F.lag("rsi").over(w), "k": F.row_number().over(w)})
    return r.where((F.col("k") > trend) & (F.col("close") > F.col("ema")) & (F.col("before") < threshold) & (F.col("rsi") >= threshold)).select("symbol", "bar_s")


def entries(bars: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """(rule, symbol, bar_s) of the rules that ``wanted`` names with their parameters; a name that is not registered is an error."""
    unknown = sorted(set(wanted) - set(RULES))
    if unknown:
        raise KeyError(f"no such rule: {', '.join(unknown)}")
    out = None
    for name, parameters in wanted.items():
        one = RULES[name](bars, **parameters).select(F.lit(name).alias("rule"), "symbol", "bar_s")
        out = one if out is None else out.unionByName(one)
    return out


class Runs:
    """Runs of rising or falling closes of a partition's rows in order: one row a run of ``least`` moves or more, as it ends."""

    def __init__(self):
        self.run = None

    def eval(self, row, least: int):
        s, at, close = row["symbol"], row["bar_s"], row["close"]
        self.least = least
        if self.run is not None:
            way = (close > self.run[4]) - (close < self.run[4])
            if way and way == self.run[1]:
                self.run = (s, way, self.run[2], at, close, self.run[5] + 1, self.run[6])
                return
            yield from self._ended()
            self.run = (s, way, self.run[3], at, close, 1, self.run[4]) if way else (s, 0, at, at, close, 0, close)
        else:
            self.run = (s, 0, at, at, close, 0, close)

    def _ended(self):
        s, way, first, last, close, n, begun = self.run
        if n >= self.least:
            yield s, first, last, n, close - begun

    def terminate(self):
        if self.run is not None:
            yield from self._ended()


def register_runs(spark: SparkSession, name: str = "price_runs") -> None:
    """``SELECT * FROM price_runs(least => 3, row => TABLE(bars) PARTITION BY symbol ORDER BY bar_s)``."""
    spark.udtf.register(name, udtf(Runs, returnType="symbol string, first long, last long, moves int, change double"))
