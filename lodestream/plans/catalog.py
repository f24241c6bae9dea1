"""Registered queries of the reference operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import pricing
from ..operators import bars as B, books, indicators as I, joins as J, options as O, orderflow as OF, ranks as K, windows as R
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name with the SQL that gives its rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def steady(x, digits: int):
    """``x`` rounded so that a half goes up whichever way its last bit has fallen; in SQL, 1e-9 is added likewise."""
    return F.round(F.col(x) + 1e-9 if isinstance(x, str) else x + 1e-9, digits)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(T.ticks(spark, sf_dir), 3600)


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


TICKS, BARS, CLOSES, LADDER, CHAIN = (f"({T.SQL[k]})" for k in ("ticks", "bars", "closes", "ladder", "chain"))
OVER = "OVER (PARTITION BY symbol ORDER BY bar_s"


def exact(total: str, weight: str, over: str, scale: int = 100) -> str:
    """``bars.exact_mean`` of running sums, in SQL."""
    return f"(CASE WHEN sum({weight}) {over} > 0 THEN (sum({total}) {over} * 2000000::HUGEINT + sum({weight}) {over} * {scale}) // (sum({weight}) {over} * {2 * scale}) END)::BIGINT / 1000000.0::DOUBLE"


# Bars and aggregates (D, A, B).

@query(T.SQL["bars"])
def bars_ohlcv(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"SELECT symbol, ts_s // 86400 * 86400 + 33300 + CAST(floor((ts_s % 86400 - 33300) / 1800.0) AS BIGINT) * 1800 AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size)::BIGINT AS volume FROM {TICKS} GROUP BY 1, 2")
def bars_session_anchored(spark, sf_dir):
    return B.bars(T.ticks(spark, sf_dir), 1800, T.OPEN_S)


@query(f"SELECT symbol, bar_s // 14400 * 14400 AS bar_s, arg_min(open, bar_s) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_s) AS close, sum(volume)::BIGINT AS volume, count(DISTINCT bar_s) AS parts FROM {BARS} GROUP BY 1, 2")
def bars_resampled(spark, sf_dir):
    return B.resample(hourly(spark, sf_dir), 14_400)


@query(f"SELECT symbol, bar_s // 14400 * 14400 AS bar_s, arg_min(open, bar_s) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_s) AS close, sum(volume)::BIGINT AS volume, count(DISTINCT bar_s) AS parts FROM {BARS} GROUP BY 1, 2 HAVING count(DISTINCT bar_s) = 4")
def bars_complete_only(spark, sf_dir):
    return B.complete(B.resample(hourly(spark, sf_dir), 14_400), 4)


@query(f"SELECT symbol, ts_s // 86400 * 86400 AS bar_s, {exact('round(price * 100)::BIGINT * size', 'size', '')} AS vwap FROM {TICKS} GROUP BY 1, 2")
def vwap_daily(spark, sf_dir):
    return B.vwap(T.ticks(spark, sf_dir))


@query(f"SELECT symbol, bar_s, coalesce({exact('(round(high * 100)::BIGINT + round(low * 100)::BIGINT + round(close * 100)::BIGINT) * volume', 'volume', 'OVER w', 300)}, round(close, 6)) AS vwap FROM {BARS} WINDOW w AS (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s)")
def vwap_to_date(spark, sf_dir):
    return B.vwap_to_date(hourly(spark, sf_dir)).select("symbol", "bar_s", "vwap")


@query(f"SELECT symbol, ts_s // 900 * 900 AS bar_s, arg_max(price, seq) AS price, max(seq) AS seq FROM {TICKS} GROUP BY 1, 2")
def last_per_bucket(spark, sf_dir):
    return B.last_per_bucket(T.ticks(spark, sf_dir), 900)


@query(f"SELECT *, CASE WHEN close > or_high THEN 'above' WHEN close < or_low THEN 'below' WHEN or_high IS NOT NULL THEN 'within' END AS side FROM (SELECT symbol, bar_s // 86400 AS day, max(CASE WHEN bar_s % 86400 < 14400 THEN high END) AS or_high, min(CASE WHEN bar_s % 86400 < 14400 THEN low END) AS or_low, arg_max(close, bar_s) AS close FROM {BARS} GROUP BY 1, 2)")
def opening_range(spark, sf_dir):
    return B.opening_range(hourly(spark, sf_dir), 14_400)


@query(f"SELECT bar_s, count(*) AS eligible, count(*) FILTER (WHERE close > open) AS rising FROM {BARS} GROUP BY 1")
def breadth(spark, sf_dir):
    return B.breadth(hourly(spark, sf_dir))


@query(f"SELECT symbol, ts_s // 86400 AS day, count(*) AS prints, sum(size)::BIGINT AS volume, round(sum(size * price), 4) AS notional, quantile_cont(size, 0.5) AS p50, round(quantile_cont(size, 0.9), 6) AS p90, round(quantile_cont(size, 0.99), 6) AS p99, max(size) AS largest FROM {TICKS} GROUP BY 1, 2 HAVING count(*) >= 20")
def print_sizes(spark, sf_dir):
    return B.print_sizes(T.ticks(spark, sf_dir)).withColumns(r6("p90", "p99") | {"notional": F.round("notional", 4)})


@query(f"SELECT symbol, bar_s, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_s DESC) AS n FROM {BARS}) WHERE n <= 20")
def tail_scan(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy(F.desc("bar_s"))
    return hourly(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 20").drop("n")


@query(f"SELECT symbol, bar_s FROM {BARS} WHERE high >= greatest(open, close) AND low <= least(open, close) AND low > 0 AND volume > 100")
def sane_bars(spark, sf_dir):
    return hourly(spark, sf_dir).where("high >= greatest(open, close) and low <= least(open, close) and low > 0 and volume > 100").select("symbol", "bar_s")


@query(f"SELECT bar_s, first(CASE WHEN symbol = 'click' THEN close END ORDER BY symbol) FILTER (WHERE symbol = 'click') AS click, max(CASE WHEN symbol = 'view' THEN close END) AS view, max(CASE WHEN symbol = 'error' THEN close END) AS error FROM {BARS} GROUP BY 1")
def closes_pivot(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("bar_s").pivot("symbol", ["click", "view", "error"]).agg(F.max("close"))


@query(f"SELECT bar_s // 86400 AS day, list_slice(list(symbol ORDER BY volume DESC, symbol), 1, 3) AS leaders FROM (SELECT symbol, bar_s // 86400 * 86400 AS bar_s, sum(volume) AS volume FROM {BARS} GROUP BY 1, 2) GROUP BY 1")
def volume_leaders(spark, sf_dir):
    d = B.resample(hourly(spark, sf_dir), T.DAY_S)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("volume")).alias("v"), "symbol")))
    return d.groupBy(F.floor(F.col("bar_s") / T.DAY_S).alias("day")).agg(F.slice(F.transform(ordered, lambda s: s["symbol"]), 1, 3).alias("leaders"))


@query("SELECT event_type AS symbol, user_id % 10 AS shard, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), (event_type, user_id % 10), ())")
def grouping_sets(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 10).alias("shard"), "value")
    return e.cube("symbol", "shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


# Windows (E).

@query(f"SELECT symbol, bar_s, round(CASE WHEN bar_s - lag(bar_s) {OVER}) = 3600 THEN close - lag(close) {OVER}) END, 6) AS change FROM {BARS}")
def adjacent_change(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(R.adjacent_change(F.col("close"), F.col("bar_s"), 3600), 6).alias("change"))


@query(f"SELECT symbol, bar_s, round(CASE WHEN count(*) {OVER} ROWS 19 PRECEDING) = 20 THEN avg(close) {OVER} ROWS 19 PRECEDING) END, 6) AS mean, round(CASE WHEN count(*) {OVER} ROWS 19 PRECEDING) = 20 THEN stddev_pop(close) {OVER} ROWS 19 PRECEDING) END, 6) AS deviation FROM {BARS}")
def rolling_stats(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(R.rolling(F.col("close"), 20, F.avg), 6).alias("mean"), F.round(R.rolling(F.col("close"), 20, F.stddev_pop), 6).alias("deviation"))


@query(f"SELECT symbol, bar_s, round(mean + 2 * sd, 6) AS upper, round(mean - 2 * sd, 6) AS lower, round(4 * sd / mean, 6) AS width FROM (SELECT symbol, bar_s, CASE WHEN count(*) {OVER} ROWS 19 PRECEDING) = 20 THEN avg(close) {OVER} ROWS 19 PRECEDING) END AS mean, stddev_pop(close) {OVER} ROWS 19 PRECEDING) AS sd FROM {BARS})")
def bollinger(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "bar_s", R.rolling(F.col("close"), 20, F.avg).alias("m"), R.rolling(F.col("close"), 20, F.stddev_pop).alias("sd"))
    return b.select("symbol", "bar_s", F.round(F.col("m") + 2 * F.col("sd"), 6).alias("upper"), F.round(F.col("m") - 2 * F.col("sd"), 6).alias("lower"), F.round(4 * F.col("sd") / F.col("m"), 6).alias("width"))


@query(f"SELECT symbol, bar_s, round(CASE WHEN count(*) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN (ln(1 + volume) - avg(ln(1 + volume)) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) / nullif(stddev_pop(ln(1 + volume)) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) END, 5) AS z FROM {BARS}")
def z_excluding_current(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(R.z_before(F.log1p("volume"), 20), 5).alias("z"))


@query(f"SELECT symbol, bar_s, round(CASE WHEN count(*) OVER w >= 5 THEN volume / nullif(avg(volume) OVER w, 0) END, 6) AS ratio FROM {BARS} WINDOW w AS (PARTITION BY symbol, bar_s % 86400 ORDER BY bar_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def same_slot_ratio(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(R.same_slot_ratio(F.col("volume"), F.col("bar_s") % T.DAY_S, 20, 5), 6).alias("ratio"))


@query(f"WITH b AS (SELECT *, row_number() {OVER}) AS n FROM {BARS}) SELECT b.symbol, b.bar_s, round(avg(CASE WHEN h.close <= b.close THEN 1.0 ELSE 0.0 END), 6) AS share FROM b JOIN b h ON h.symbol = b.symbol AND h.n BETWEEN b.n - 59 AND b.n GROUP BY 1, 2")
def percentile_inclusive(spark, sf_dir):
    return K.trailing_share(hourly(spark, sf_dir), "close", 60, True).withColumns(r6("share"))


@query(f"WITH b AS (SELECT *, row_number() {OVER}) AS n FROM {BARS}) SELECT b.symbol, b.bar_s, round(avg(CASE WHEN h.close < b.close THEN 1.0 WHEN h.close IS NOT NULL THEN 0.0 END), 6) AS share FROM b LEFT JOIN b h ON h.symbol = b.symbol AND h.n BETWEEN b.n - 60 AND b.n - 1 GROUP BY 1, 2")
def percentile_strict(spark, sf_dir):
    return K.trailing_share(hourly(spark, sf_dir), "close", 60, False).withColumns(r6("share"))


@query(f"SELECT symbol, bar_s, round((row_number() OVER (PARTITION BY bar_s // 86400 ORDER BY volume, symbol, bar_s) - 0.5) / count(*) OVER (PARTITION BY bar_s // 86400), 6) AS mid_rank, rank() OVER (PARTITION BY bar_s // 86400 ORDER BY volume) + (count(*) OVER (PARTITION BY bar_s // 86400, volume) - 1) / 2.0 AS average_rank FROM {BARS}")
def ranks(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("day", F.floor(F.col("bar_s") / T.DAY_S))
    place = (F.row_number().over(W.partitionBy("day").orderBy("volume", "symbol", "bar_s")) - 0.5) / F.count(F.lit(1)).over(W.partitionBy("day"))
    return b.select("symbol", "bar_s", F.round(place, 6).alias("mid_rank"), R.average_rank("volume", ["day"]).alias("average_rank"))


@query(f"SELECT symbol, bar_s, round((close - min(close) {OVER} ROWS 19 PRECEDING)) / nullif(max(close) {OVER} ROWS 19 PRECEDING) - min(close) {OVER} ROWS 19 PRECEDING), 0), 6) AS place FROM {BARS}")
def range_position(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(R.range_position(F.col("close"), 20), 6).alias("place"))


@query(f"SELECT symbol, bar_s, CASE WHEN count(*) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN max(high) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS upper, CASE WHEN count(*) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN min(low) {OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS lower FROM {BARS}")
def donchian(spark, sf_dir):
    up, low = R.donchian(F.col("high"), F.col("low"), 20)
    return hourly(spark, sf_dir).select("symbol", "bar_s", up.alias("upper"), low.alias("lower"))


_TR = f"SELECT *, greatest(high - low, abs(high - lag(close) {OVER})), abs(low - lag(close) {OVER}))) AS tr FROM {BARS}"


@query(f"SELECT symbol, bar_s, round(tr, 6) AS tr, round(CASE WHEN count(tr) {OVER} ROWS 13 PRECEDING) = 14 THEN avg(tr) {OVER} ROWS 13 PRECEDING) END, 6) AS atr FROM ({_TR})")
def atr_simple(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("tr", R.true_range())
    return b.select("symbol", "bar_s", F.round("tr", 6).alias("tr"), F.round(R.rolling(F.col("tr"), 14, F.avg), 6).alias("atr"))


@query(f"WITH b AS (SELECT symbol, bar_s, close > open AS up, row_number() {OVER}) AS n FROM {BARS}) SELECT symbol, bar_s, n - coalesce(max(CASE WHEN NOT up THEN n END) {OVER}), 0) AS streak FROM b")
def streaks(spark, sf_dir):
    return R.with_streak(hourly(spark, sf_dir), F.col("close") > F.col("open"), "streak").select("symbol", "bar_s", F.col("streak").cast("long").alias("streak"))


@query(f"SELECT symbol, bar_s, round(max(close) {OVER}) - close, 6) AS down, round((max(close) {OVER}) - close) / max(close) {OVER}), 6) AS share FROM {BARS}")
def drawdown(spark, sf_dir):
    down, share = R.drawdown(F.col("close"))
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(down, 6).alias("down"), F.round(share, 6).alias("share"))


@query(f"SELECT symbol, month, " + ", ".join(f"round(close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY month) - 1, 6) AS r{n}" for n in (1, 5, 20, 60)) + f" FROM {CLOSES}")
def return_ladder(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("month")
    return T.closes(spark, sf_dir).select("symbol", "month", *[F.round(F.col("close") / F.lag("close", n).over(w) - 1, 6).alias(f"r{n}") for n in (1, 5, 20, 60)])


@query(f"SELECT symbol, bar_s, close FROM (SELECT symbol, bar_s, close, count(*) {OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n, max(close) {OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM {BARS}) WHERE n = 7 AND m = close")
def swing_highs(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("swing", R.swing_high(F.col("close"), 3)).where("swing").select("symbol", "bar_s", "close")


@query(f"SELECT symbol, bar_s, round(regr_slope(close, n) {OVER} ROWS 19 PRECEDING), 5) AS slope, round(regr_r2(close, n) {OVER} ROWS 19 PRECEDING), 5) AS r2 FROM (SELECT symbol, bar_s, close, row_number() {OVER}) AS n FROM {BARS}) QUALIFY n >= 20")
def rolling_regression(spark, sf_dir):
    w = R.over()
    b = hourly(spark, sf_dir).withColumn("n", F.row_number().over(w)).withColumns({
        "slope": F.round(F.regr_slope("close", "n").over(w.rowsBetween(-19, 0)), 5), "r2": F.round(F.regr_r2("close", "n").over(w.rowsBetween(-19, 0)), 5)})
    return b.where("n >= 20").select("symbol", "bar_s", "slope", "r2")


@query(f"WITH m AS (SELECT symbol, bar_s, close, abs(close - lag(close) {OVER})) AS move FROM {BARS}) SELECT symbol, bar_s, round(CASE WHEN count(move) {OVER} ROWS 9 PRECEDING) = 10 THEN abs(close - lag(close, 10) {OVER})) / nullif(sum(move) {OVER} ROWS 9 PRECEDING), 0) END, 6) AS er FROM m")
def efficiency_ratio(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("move", F.abs(F.col("close") - F.lag("close").over(R.over())))
    return b.select("symbol", "bar_s", F.round(R.efficiency(F.col("close"), 10), 6).alias("er"))


@query(f"SELECT symbol, bar_s, bar_s - before AS gap_s FROM (SELECT symbol, bar_s, lag(bar_s) {OVER}) AS before FROM {BARS}) WHERE bar_s - before >= 7200")
def feed_gaps(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("gap_s", F.col("bar_s") - F.lag("bar_s").over(R.over()))
    return b.where("gap_s >= 7200").select("symbol", "bar_s", "gap_s")


@query(f"SELECT symbol, round(stddev_samp(r) * sqrt(count(r)), 6) AS volatility, count(r) AS n FROM (SELECT symbol, ln(close / lag(close) {OVER})) AS r FROM {BARS}) GROUP BY 1")
def realised_volatility(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("r", F.log(F.col("close") / F.lag("close").over(R.over())))
    return b.groupBy("symbol").agg(F.round(F.stddev_samp("r") * F.sqrt(F.count("r")), 6).alias("volatility"), F.count("r").alias("n"))


@query(f"WITH r AS (SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM {CLOSES}), m AS (SELECT month, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY 1) SELECT month, round(100 * exp(sum(ln(1 + r)) OVER (ORDER BY month)), 4) AS level FROM m")
def equal_weight_index(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("month")
    m = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r is not null").groupBy("month").agg(F.avg("r").alias("r"))
    # One row a month remains here.
    return m.select("month", F.round(100 * F.exp(F.sum(F.log(1 + F.col("r"))).over(W.orderBy("month"))), 4).alias("level"))


@query(f"WITH r AS (SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM {CLOSES}) SELECT a.symbol AS first, b.symbol AS second, round(corr(a.r, b.r), 6) AS correlation, count(*) AS n FROM r a JOIN r b ON a.month = b.month AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15")
def correlations(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("month")
    r = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r is not null")
    a, b = r.select("month", F.col("symbol").alias("first"), F.col("r").alias("x")), r.select("month", F.col("symbol").alias("second"), F.col("r").alias("y"))
    return a.join(b, "month").where("first < second").groupBy("first", "second").agg(F.round(F.corr("x", "y"), 6).alias("correlation"), F.count(F.lit(1)).alias("n")).where("n >= 15")


# Joins (C).

@query(f"WITH b AS {BARS}, t AS (SELECT symbol, seq, ts_s FROM {TICKS}) SELECT t.symbol, t.seq, CASE WHEN t.ts_s - b.bar_s <= 10800 THEN b.close END AS close FROM t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.ts_s > b.bar_s")
def asof_capped(spark, sf_dir):
    t = T.ticks(spark, sf_dir).select("symbol", "seq", F.col("ts_s").alias("at"))
    return J.asof(t, hourly(spark, sf_dir).select("symbol", F.col("bar_s").alias("at"), "close"), "symbol", "at", "close", most_age=10_800, strictly=True).select("symbol", "seq", "close")


@query(f"WITH b AS {BARS} SELECT b.symbol, b.bar_s, round(h.close / b.close - 1, 6) AS forward FROM b LEFT JOIN b h ON h.symbol = b.symbol AND h.bar_s = b.bar_s + 7200")
def horizon_return(spark, sf_dir):
    b = J.at_horizon(hourly(spark, sf_dir).select("symbol", "bar_s", "close"), "symbol", "bar_s", "close", 7_200)
    return b.select("symbol", "bar_s", F.round(F.col("close_ahead") / F.col("close") - 1, 6).alias("forward"))


@query(f"WITH p AS (SELECT seq, ts_s FROM {TICKS} WHERE symbol = 'purchase'), v AS (SELECT ts_s, price FROM {TICKS} WHERE symbol = 'view') SELECT p.seq, arg_min(v.price, abs(v.ts_s - p.ts_s) * 10000000000 + v.ts_s) AS price FROM p LEFT JOIN v ON abs(v.ts_s - p.ts_s) <= 3600 GROUP BY 1")
def nearest_in_time(spark, sf_dir):
    t = T.ticks(spark, sf_dir)
    p = t.where("symbol = 'purchase'").select("seq", "ts_s", F.lit(1).alias("k"))
    # Of views in one second the first counts, and one without a price is none, as in SQL's arg_min.
    v = t.where("symbol = 'view' and price is not null").groupBy("ts_s").agg(F.min_by("price", "seq").alias("price")).withColumn("k", F.lit(1))
    near = J.nearest(p, v, "k", "ts_s", "price", 3_600)
    # A seq that several purchases have gets one row, as in SQL.
    return near.groupBy("seq").agg(F.min_by("price", F.abs(F.col("price_at") - F.col("ts_s")) * 10**10 + F.col("price_at")).alias("price"))


@query(f"WITH d AS (SELECT DISTINCT bar_s // 86400 AS day FROM {BARS} WHERE symbol = 'click'), e AS (SELECT bar_s // 86400 AS day, count(*) AS n FROM {BARS} WHERE symbol = 'error' AND close > 95 AND bar_s % 86400 < 7200 GROUP BY 1) SELECT day FROM d WHERE day NOT IN (SELECT day FROM e)")
def anti_filter(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("day", F.floor(F.col("bar_s") / T.DAY_S))
    return b.where("symbol = 'click'").select("day").distinct().join(b.where("symbol = 'error' and close > 95 and bar_s % 86400 < 7200").select("day"), "day", "left_anti")


# Indicators (F): folds.

def _recursive(inner: str, first: str, following: str, out: str) -> str:
    return f"WITH RECURSIVE b AS ({inner}), r AS (SELECT {first} FROM b WHERE n = 1 UNION ALL SELECT {following} FROM r JOIN b ON b.symbol = r.symbol AND b.n = r.n + 1) SELECT {out} FROM r"


_NUMBERED = f"SELECT symbol, bar_s, close, row_number() {OVER}) AS n FROM {BARS}"


@query(_recursive(_NUMBERED, "symbol, n, bar_s, close AS fast, close AS slow, 0.0::DOUBLE AS signal", "b.symbol, b.n, b.bar_s, fast + 2.0::DOUBLE / 13 * (close - fast), slow + 2.0::DOUBLE / 27 * (close - slow), signal + 2.0::DOUBLE / 10 * ((fast + 2.0::DOUBLE / 13 * (close - fast)) - (slow + 2.0::DOUBLE / 27 * (close - slow)) - signal)", "symbol, bar_s, round(fast - slow, 6) AS macd, round(signal, 6) AS signal, round(fast - slow - signal, 6) AS histogram"))
def macd(spark, sf_dir):
    return I.macd(hourly(spark, sf_dir)).select("symbol", "bar_s", *[F.round(c, 6).alias(c) for c in ("macd", "signal", "histogram")])


@query("SELECT symbol, bar_s FROM (SELECT symbol, bar_s, macd, lag(macd) OVER (PARTITION BY symbol ORDER BY bar_s) AS before, row_number() OVER (PARTITION BY symbol ORDER BY bar_s) AS n FROM (" + SQL["macd"] + ")) WHERE before <= 0 AND macd > 0 AND n > 26")
def macd_zero_cross(spark, sf_dir):
    m = macd(spark, sf_dir).withColumns({"before": F.lag("macd").over(R.over()), "n": F.row_number().over(R.over())})
    return m.where("before <= 0 and macd > 0 and n > 26").select("symbol", "bar_s")


_CHANGE = f"SELECT symbol, bar_s, close, close - lag(close) {OVER}) AS c, row_number() {OVER}) AS n FROM {BARS}"


@query(_recursive(_CHANGE, "symbol, n, bar_s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l",
    "b.symbol, b.n, b.bar_s, CASE WHEN b.n <= 14 THEN g + greatest(c, 0) WHEN b.n = 15 THEN (g + greatest(c, 0)) / 14 ELSE (g * 13 + greatest(c, 0)) / 14 END, CASE WHEN b.n <= 14 THEN l + greatest(-c, 0) WHEN b.n = 15 THEN (l + greatest(-c, 0)) / 14 ELSE (l * 13 + greatest(-c, 0)) / 14 END",
    "symbol, bar_s, CASE WHEN n > 14 THEN round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) END AS rsi"))
def rsi(spark, sf_dir):
    return I.rsi(hourly(spark, sf_dir)).select("symbol", "bar_s", F.round("rsi", 6).alias("rsi"))


@query(_recursive(f"SELECT symbol, bar_s, tr, row_number() {OVER}) AS n FROM ({_TR})", "symbol, n, bar_s, tr AS t, CAST(NULL AS DOUBLE) AS atr",
    "b.symbol, b.n, b.bar_s, t + tr, CASE WHEN b.n < 14 THEN NULL WHEN b.n = 14 THEN (t + tr) / 14 ELSE (atr * 13 + tr) / 14 END", "symbol, bar_s, round(atr, 6) AS atr"))
def atr_wilder(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("tr", R.true_range())
    return I.wilder(b, 14, "tr", "atr").select("symbol", "bar_s", F.round("atr", 6).alias("atr"))


@query(_recursive(f"SELECT symbol, bar_s, close, er, row_number() {OVER}) AS n FROM (" + f"WITH m AS (SELECT symbol, bar_s, close, abs(close - lag(close) {OVER})) AS move FROM {BARS}) SELECT symbol, bar_s, close, CASE WHEN count(move) {OVER} ROWS 9 PRECEDING) = 10 THEN abs(close - lag(close, 10) {OVER})) / nullif(sum(move) {OVER} ROWS 9 PRECEDING), 0) END AS er FROM m)",
    "symbol, n, bar_s, close AS state, er", "b.symbol, b.n, b.bar_s, CASE WHEN b.er IS NULL THEN close ELSE state + pow(b.er * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) * (close - state) END, b.er", "symbol, bar_s, CASE WHEN er IS NOT NULL THEN round(state, 6) END AS kama"))
def kama(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("move", F.abs(F.col("close") - F.lag("close").over(R.over())))
    b = b.withColumn("er", R.efficiency(F.col("close"), 10))
    return I.kama(b).select("symbol", "bar_s", F.round("kama", 6).alias("kama"))


@query(f"SELECT symbol, bar_s, round((close / lag(close, 12) {OVER}) - 1) * 100, 6) AS roc FROM {BARS}")
def roc(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round((F.col("close") / F.lag("close", 12).over(R.over()) - 1) * 100, 6).alias("roc"))


@query(f"SELECT symbol, bar_s, round((ph + pl + pc) / 3, 6) AS p, round(2 * (ph + pl + pc) / 3 - pl, 6) AS r1, round(2 * (ph + pl + pc) / 3 - ph, 6) AS s1 FROM (SELECT symbol, bar_s, lag(high) {OVER}) AS ph, lag(low) {OVER}) AS pl, lag(close) {OVER}) AS pc FROM (SELECT symbol, bar_s // 86400 * 86400 AS bar_s, max(high) AS high, min(low) AS low, arg_max(close, bar_s) AS close FROM {BARS} GROUP BY 1, 2))")
def floor_pivots(spark, sf_dir):
    d = B.resample(hourly(spark, sf_dir), T.DAY_S)
    d = d.withColumns({k: F.lag(c).over(R.over()) for k, c in (("ph", "high"), ("pl", "low"), ("pc", "close"))})
    return I.pivots(d).select("symbol", "bar_s", *[F.round(c, 6).alias(c) for c in ("p", "r1", "s1")])


# Order flow (G, H).

_SIDES = f"""SELECT *, CASE WHEN abs(off) >= 0.05 THEN 'quote' WHEN abs(off) > 0.0125 THEN 'mid' WHEN off != 0 THEN 'tick' WHEN side != 0 THEN 'carry' ELSE 'none' END AS method FROM (
    SELECT symbol, seq, ts_s, price, size, off, coalesce(last_value(nullif(sign(off), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq), 0)::INTEGER AS side FROM (
    SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS off FROM {TICKS}))"""
_SIDES = f"SELECT *, CASE method WHEN 'quote' THEN 0.9 WHEN 'mid' THEN 0.7 WHEN 'tick' THEN 0.6 WHEN 'carry' THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence FROM ({_SIDES})"


@query(f"SELECT symbol, seq, side, method, confidence FROM ({_SIDES})")
def aggressor_side(spark, sf_dir):
    return OF.classified(T.ticks(spark, sf_dir)).select("symbol", "seq", "side", "method", "confidence")


@query(f"SELECT symbol, ts_s // 3600 * 3600 AS bar_s, sum(CASE WHEN side > 0 THEN size ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN side < 0 THEN size ELSE 0 END)::BIGINT AS sell, sum(size)::BIGINT AS volume, sum(side * size)::BIGINT AS delta, round(sum(side * size * confidence), 6) AS weighted_delta, round(sum(CASE WHEN side != 0 THEN size ELSE 0 END) / nullif(sum(size), 0), 6) AS classified_share FROM ({_SIDES}) GROUP BY 1, 2")
def minute_flow(spark, sf_dir):
    return OF.flow(OF.classified(T.ticks(spark, sf_dir)), ["symbol", B.bucket(F.col("ts_s"), 3600).alias("bar_s")]).withColumns(r6("weighted_delta", "classified_share"))


@query(f"SELECT symbol, seq, sum(side * size) OVER (PARTITION BY symbol, ts_s // 86400 ORDER BY seq)::BIGINT AS cvd FROM ({_SIDES})")
def cumulative_delta(spark, sf_dir):
    w = W.partitionBy("symbol", F.floor(F.col("ts_s") / T.DAY_S)).orderBy("seq")
    return OF.classified(T.ticks(spark, sf_dir)).select("symbol", "seq", F.sum(F.col("side") * F.col("size")).over(w).alias("cvd"))


_BOOK = f"SELECT symbol, seq, lag(price) OVER (PARTITION BY symbol ORDER BY seq) - 0.05 AS bid, lag(price) OVER (PARTITION BY symbol ORDER BY seq) + 0.05 AS ask, size AS bid_qty, 99 - size AS ask_qty FROM {TICKS}"


@query(f"SELECT symbol, seq, (CASE WHEN bid > pb THEN bid_qty WHEN bid = pb THEN bid_qty - pbq ELSE -pbq END) - (CASE WHEN ask < pa THEN ask_qty WHEN ask = pa THEN ask_qty - paq ELSE -paq END) AS ofi FROM (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_qty) OVER w AS pbq, lag(ask_qty) OVER w AS paq FROM ({_BOOK}) WHERE bid > 0 AND ask > bid WINDOW w AS (PARTITION BY symbol ORDER BY seq)) WHERE pb IS NOT NULL")
def order_flow_imbalance(spark, sf_dir):
    mid = F.lag("price").over(W.partitionBy("symbol").orderBy("seq"))
    books_ = T.ticks(spark, sf_dir).select("symbol", "seq", (mid - 0.05).alias("bid"), (mid + 0.05).alias("ask"), F.col("size").alias("bid_qty"), (99 - F.col("size")).alias("ask_qty"))
    return OF.book_imbalance(books_).where("ofi is not null").select("symbol", "seq", "ofi")


@query(T.SQL["ladder"])
def price_ladder(spark, sf_dir):
    return T.ladder(spark, sf_dir)


@query(f"SELECT symbol, arg_max(level, struct_pack(v := volume, d := -abs(level - mid), l := level)) AS poc, sum(volume) AS total FROM (SELECT symbol, level, buy + sell + unclassified AS volume, (min(level) OVER (PARTITION BY symbol) + max(level) OVER (PARTITION BY symbol)) / 2.0 AS mid FROM {LADDER}) GROUP BY 1")
def point_of_control(spark, sf_dir):
    return OF.value_area(OF.with_volume(T.ladder(spark, sf_dir)), ["symbol"]).select("symbol", "poc", "total")


_IMB = f"SELECT *, CASE WHEN lag(level) OVER w IS NOT NULL THEN buy >= 20 AND buy >= 1.5 * CASE WHEN lag(level) OVER w = level - 1 THEN lag(sell) OVER w ELSE 0 END END AS buy_imbalance FROM {LADDER} WINDOW w AS (PARTITION BY symbol ORDER BY level)"


@query(f"SELECT symbol, level, buy_imbalance FROM ({_IMB})")
def diagonal_imbalance(spark, sf_dir):
    return OF.diagonal_imbalance(T.ladder(spark, sf_dir), ["symbol"], ratio=1.5).select("symbol", "level", "buy_imbalance")


@query(f"SELECT symbol, min(level) AS low, max(level) AS high, count(*) AS levels FROM (SELECT symbol, level, level - row_number() OVER (PARTITION BY symbol ORDER BY level) AS island FROM ({_IMB}) WHERE buy_imbalance) GROUP BY symbol, island HAVING count(*) >= 2")
def stacked_imbalance(spark, sf_dir):
    return OF.stacked(OF.diagonal_imbalance(T.ladder(spark, sf_dir), ["symbol"], ratio=1.5), ["symbol"], "buy_imbalance", 2)


@query(f"SELECT symbol, level, volume FROM (SELECT symbol, level, volume, lag(volume) OVER w AS d, lead(volume) OVER w AS u, lag(level) OVER w AS dl, lead(level) OVER w AS ul, max(volume) OVER (PARTITION BY symbol) AS most FROM (SELECT *, buy + sell + unclassified AS volume FROM {LADDER}) WINDOW w AS (PARTITION BY symbol ORDER BY level)) WHERE dl = level - 1 AND ul = level + 1 AND volume < d AND volume < u AND volume <= 0.8 * most")
def low_volume_nodes(spark, sf_dir):
    return OF.low_volume_nodes(OF.with_volume(T.ladder(spark, sf_dir)), ["symbol"], 0.8).select("symbol", "level", "volume")


# Options (I).

@query(f"SELECT underlying, month, round(sum(CASE WHEN option_type = 'PE' THEN oi END) / nullif(sum(CASE WHEN option_type = 'CE' THEN oi END), 0), 6) AS oi_pcr, round(sum(CASE WHEN option_type = 'PE' THEN oi * premium END) / nullif(sum(CASE WHEN option_type = 'CE' THEN oi * premium END), 0), 6) AS turnover_pcr FROM {CHAIN} GROUP BY 1, 2")
def put_call_ratio(spark, sf_dir):
    return O.put_call_ratio(T.chain(spark, sf_dir), ["underlying", "month"]).withColumns(r6("oi_pcr", "turnover_pcr"))


@query(f"SELECT underlying, month, option_type, strike, oi, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY underlying, month, option_type ORDER BY oi DESC, strike) AS n FROM {CHAIN}) WHERE n <= 4")
def interest_walls(spark, sf_dir):
    return O.walls(T.chain(spark, sf_dir), ["underlying", "month"]).select("underlying", "month", "option_type", "strike", "oi", F.col("place").cast("long").alias("place"))


_PAIRS = f"SELECT underlying, month, strike, max(CASE WHEN option_type = 'CE' THEN premium END) AS call, max(CASE WHEN option_type = 'PE' THEN premium END) AS put, max(spot) AS spot FROM {CHAIN} GROUP BY 1, 2, 3"


@query(f"SELECT underlying, month, strike, round(straddle, 8) AS straddle, round(straddle / spot, 8) AS move FROM (SELECT *, call + put AS straddle, row_number() OVER (PARTITION BY underlying, month ORDER BY abs(strike - spot), strike) AS n FROM ({_PAIRS}) WHERE call IS NOT NULL AND put IS NOT NULL) WHERE n = 1")
def atm_straddle(spark, sf_dir):
    p = O.paired(T.chain(spark, sf_dir), ["underlying", "month"])
    return O.at_the_money(p, ["underlying", "month"]).select("underlying", "month", "strike", F.round("straddle", 8).alias("straddle"), F.round("move", 8).alias("move"))


def _priced(spark, sf_dir) -> DataFrame:
    """The chain with a modelled premium at a known volatility, a month before expiry."""
    sigma, t, r = 0.1 + (F.col("month") % 7) / 20, F.lit(30 / 365), F.lit(0.0)
    c = T.chain(spark, sf_dir).withColumns({"sigma": sigma, "t": t, "r": r})
    return c.withColumn("model", pricing.black_scholes(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.col("r"), F.col("sigma")))


@query(f"SELECT underlying, month, strike, option_type, round(0.1 + (month % 7) / 20, 4) AS iv FROM {CHAIN}")
def implied_volatility(spark, sf_dir):
    """Solving for the volatility gives back the one the premium was modelled with."""
    c = _priced(spark, sf_dir)
    iv = pricing.implied_volatility(O.is_call(), F.col("model"), F.col("spot"), F.col("strike"), F.col("t"), F.col("r"))
    return c.select("underlying", "month", "strike", "option_type", F.round(iv, 4).alias("iv"))


@query()
def option_greeks(spark, sf_dir):
    g = pricing.greeks(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.col("r"), F.col("sigma"))
    return _priced(spark, sf_dir).select("underlying", "month", "strike", "option_type", *[F.round(v, 8).alias(k) for k, v in g.items()])


@query()
def gamma_flip(spark, sf_dir):
    c = _priced(spark, sf_dir)
    g = pricing.greeks(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.col("r"), F.col("sigma"))["gamma"]
    e = c.withColumn("gex", pricing.gamma_exposure(O.is_call(), g, F.col("oi"), F.col("spot")))
    return O.flip_level(e, ["underlying", "month"]).withColumns(r6("flip") | {"net_gex": F.round("net_gex", 4)})


# Books (K).

_SEQ = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
_FILLS = f"SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity::DOUBLE AS quantity, l_extendedprice / l_quantity AS price, sum(l_quantity::DOUBLE) OVER (PARTITION BY l_partkey, l_returnflag = 'A' ORDER BY {_SEQ}) AS e FROM lineitem"
_FIFO = f"WITH f AS ({_FILLS}), e AS (SELECT symbol, e, CASE WHEN side = 'BUY' THEN price END AS bought_at, CASE WHEN side = 'SELL' THEN price END AS sold_at, CASE WHEN side = 'SELL' THEN day END AS day, side = 'SELL' AS kind FROM f), s AS (SELECT symbol, e - coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY e, kind), 0) AS quantity, first_value(bought_at IGNORE NULLS) OVER w AS bought_at, first_value(sold_at IGNORE NULLS) OVER w AS sold_at, first_value(day IGNORE NULLS) OVER w AS day FROM e WINDOW w AS (PARTITION BY symbol ORDER BY e, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT * FROM s WHERE quantity > 0 AND bought_at IS NOT NULL AND sold_at IS NOT NULL"


@query(f"SELECT symbol, day, quantity, bought_at, sold_at, quantity * (sold_at - bought_at) AS pnl FROM ({_FIFO})")
def fifo_slices(spark, sf_dir):
    return books.fifo(T.fills(spark, sf_dir))


@query(f"SELECT day, round(sum(quantity * (sold_at - bought_at)), 7) AS realised, count(*) AS trades, count(*) FILTER (WHERE sold_at > bought_at) AS wins FROM ({_FIFO}) GROUP BY 1")
def daily_book(spark, sf_dir):
    return books.daily(books.fifo(T.fills(spark, sf_dir))).withColumn("realised", F.round("realised", 7))


@query(f"SELECT year(day) AS year, month(day) AS month, round(sum(realised), 7) AS realised, sum(trades)::BIGINT AS trades, sum(wins)::BIGINT AS wins FROM (SELECT day, sum(quantity * (sold_at - bought_at)) AS realised, count(*) AS trades, count(*) FILTER (WHERE sold_at > bought_at) AS wins FROM ({_FIFO}) GROUP BY 1) GROUP BY ROLLUP (1, 2)".replace("ROLLUP (1, 2)", "ROLLUP (year(day), month(day))"))
def calendar_roll_up(spark, sf_dir):
    out = books.roll_up(books.daily(books.fifo(T.fills(spark, sf_dir))))
    return out.select("year", "month", F.round("realised", 7).alias("realised"), "trades", "wins")


@query("SELECT CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS side, count(*) AS fills, round(sum(l_extendedprice * (CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 0.001 END + 0.00059)), 2) AS charges FROM lineitem GROUP BY 1")
def statutory_charges(spark, sf_dir):
    return books.with_charges(T.fills(spark, sf_dir)).groupBy("side").agg(F.count(F.lit(1)).alias("fills"), F.round(F.sum("charges"), 2).alias("charges"))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with MACD and its zero crossings."""
    b = hourly(spark, sf_dir)
    m = I.macd(b)
    crossed = (F.lag("macd").over(R.over()) <= 0) & (F.col("macd") > 0)
    return b.join(m.withColumn("crossed", F.coalesce(crossed, F.lit(False))).select("symbol", "bar_s", "macd", "signal", "histogram", "crossed"), ["symbol", "bar_s"])
