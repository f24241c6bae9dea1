"""Registered queries of session profiles, outcomes, robust statistics, positions in options, archives and exports."""

from __future__ import annotations

import uuid


from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import bars as B, indicators as I, joins as J, windows as R
from ..sources import tables as T
from .catalog import _recursive, BARS, CHAIN, CLOSES, OVER, TICKS, hourly, query
from .more import folder

LEVEL, BRACKET_S = 5, 1_800


def _day():
    return F.floor(F.col("ts_s") / T.DAY_S)


# Session profiles (G).

def presence(ticks: DataFrame) -> DataFrame:
    """symbol, day, level, tpo, volume: in how many half-hour brackets a level traded, and how much."""
    bracket = F.floor(F.col("ts_s") % T.DAY_S / BRACKET_S)
    return ticks.groupBy("symbol", _day().alias("day"), F.floor(F.col("price") / LEVEL).alias("level")).agg(
        F.count_distinct(bracket).alias("tpo"), F.min(bracket).alias("first_bracket"), F.max(bracket).alias("last_bracket"), F.sum("size").alias("volume"))


_TPO = f"SELECT symbol, ts_s // 86400 AS day, CAST(floor(price / 5) AS BIGINT) AS level, count(DISTINCT ts_s % 86400 // 1800) AS tpo, min(ts_s % 86400 // 1800) AS first_bracket, max(ts_s % 86400 // 1800) AS last_bracket, sum(size)::BIGINT AS volume FROM {TICKS} GROUP BY 1, 2, 3"


@query(_TPO)
def tpo_profile(spark, sf_dir):
    return presence(T.ticks(spark, sf_dir))


@query(f"SELECT symbol, day, sum(volume)::BIGINT AS volume, arg_max(level, volume * 1000000 - level) AS vpoc, arg_max(level, tpo * 1000000 - level) AS tpoc FROM ({_TPO}) GROUP BY 1, 2")
def volume_poc(spark, sf_dir):
    """The level of most volume and of most brackets; the lower one wins a tie."""
    p = presence(T.ticks(spark, sf_dir))
    most = lambda c: F.max_by("level", F.struct(c, -F.col("level")))
    return p.groupBy("symbol", "day").agg(F.sum("volume").alias("volume"), most("volume").alias("vpoc"), most("tpo").alias("tpoc"))


@query(f"SELECT symbol, day, max(level) AS high, arg_max(tpo, level) >= 2 AS poor_high, min(level) AS low, arg_min(tpo, level) >= 2 AS poor_low, count(*) FILTER (WHERE tpo = 1) AS single_prints FROM ({_TPO}) GROUP BY 1, 2")
def poor_extremes(spark, sf_dir):
    return presence(T.ticks(spark, sf_dir)).groupBy("symbol", "day").agg(
        F.max("level").alias("high"), (F.max_by("tpo", "level") >= 2).alias("poor_high"), F.min("level").alias("low"),
        (F.min_by("tpo", "level") >= 2).alias("poor_low"), F.count_if(F.col("tpo") == 1).alias("single_prints"))


@query(f"SELECT (day + 3) // 7 AS week, symbol, level, sum(volume)::BIGINT AS volume, sum(tpo)::BIGINT AS tpo FROM ({_TPO}) GROUP BY 1, 2, 3")
def weekly_profile(spark, sf_dir):
    """Ladders of the days of a week (from Monday on), merged."""
    week = F.floor((F.col("day") + 3) / 7)
    return presence(T.ticks(spark, sf_dir)).groupBy(week.alias("week"), "symbol", "level").agg(F.sum("volume").alias("volume"), F.sum("tpo").alias("tpo"))


@query(f"SELECT symbol, day, round((high - ib_high) / nullif(ib_high - ib_low, 0), 6) AS up, round((ib_low - low) / nullif(ib_high - ib_low, 0), 6) AS down, CASE WHEN ib_high IS NULL OR ib_high = ib_low THEN NULL WHEN high > ib_high AND low < ib_low THEN 'neutral' WHEN high = ib_high AND low = ib_low THEN 'normal' WHEN greatest(high - ib_high, ib_low - low) >= ib_high - ib_low THEN 'trend' ELSE 'variation' END AS day_type FROM (SELECT symbol, bar_s // 86400 AS day, max(high) AS high, min(low) AS low, max(CASE WHEN bar_s % 86400 < 14400 THEN high END) AS ib_high, min(CASE WHEN bar_s % 86400 < 14400 THEN low END) AS ib_low FROM {BARS} GROUP BY 1, 2)")
def day_types(spark, sf_dir):
    """How far a day went beyond the range of its first four hours, in widths of that range."""
    early = F.col("bar_s") % T.DAY_S < 14_400
    d = hourly(spark, sf_dir).groupBy("symbol", F.floor(F.col("bar_s") / T.DAY_S).alias("day")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.when(early, F.col("high"))).alias("ib_high"), F.min(F.when(early, F.col("low"))).alias("ib_low"))
    width, up, down = F.col("ib_high") - F.col("ib_low"), F.col("high") - F.col("ib_high"), F.col("ib_low") - F.col("low")
    kind = (F.when(F.col("ib_high").isNull() | (width == 0), None).when((up > 0) & (down > 0), "neutral").when((up == 0) & (down == 0), "normal")
            .when(F.greatest(up, down) >= width, "trend").otherwise("variation"))
    share = lambda x: F.round(x / F.nullif(width, F.lit(0.0)), 6)
    return d.select("symbol", "day", share(up).alias("up"), share(down).alias("down"), kind.alias("day_type"))


# Rotation and robust statistics (E).

_EMAS = _recursive(f"SELECT symbol, bar_s, close, row_number() {OVER}) AS n FROM {BARS}", "symbol, n, bar_s, close, close AS fast, close AS slow",
    "b.symbol, b.n, b.bar_s, b.close, fast + 2.0::DOUBLE / 6 * (b.close - fast), slow + 2.0::DOUBLE / 21 * (b.close - slow)", "symbol, bar_s, close, fast, slow")


@query(f"WITH m AS (SELECT *, abs(close - lag(close) {OVER})) AS move, lag(fast, 3) {OVER}) AS before FROM ({_EMAS})), s AS (SELECT *, CASE WHEN count(move) {OVER} ROWS 19 PRECEDING) = 20 THEN nullif(avg(move) {OVER} ROWS 19 PRECEDING), 0) END AS scale FROM m) SELECT symbol, bar_s, round((fast - slow) / scale, 5) AS x, round((fast - before) / 3 / scale, 5) AS y FROM s WHERE scale IS NOT NULL")
def trend_rotation(spark, sf_dir):
    """Distance of two exponential means and slope of the faster one, in mean absolute moves."""
    e = I.recurrence(hourly(spark, sf_dir), ["close"], {"fast": I.mean_step(F.col("close"), 2 / 6), "slow": I.mean_step(F.col("close"), 2 / 21)})
    e = e.withColumn("move", F.abs(F.col("close") - F.lag("close").over(R.over())))
    e = e.withColumns({"before": F.lag("fast", 3).over(R.over()), "scale": F.nullif(R.rolling(F.col("move"), 20, F.avg), F.lit(0.0))}).where("scale is not null")
    return e.select("symbol", "bar_s", F.round((F.col("fast") - F.col("slow")) / F.col("scale"), 5).alias("x"), F.round((F.col("fast") - F.col("before")) / 3 / F.col("scale"), 5).alias("y"))


HAC_LAGS = 4


@query(f"WITH r AS (SELECT symbol, month, close / lag(close) OVER w - 1 AS r FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY month)), e AS (SELECT symbol, month, r, r - avg(r) OVER (PARTITION BY symbol) AS e FROM r WHERE r IS NOT NULL), l AS (SELECT symbol, r, e, " + ", ".join(f"e * lag(e, {j}) OVER (PARTITION BY symbol ORDER BY month) AS c{j}" for j in range(1, HAC_LAGS + 1)) + " FROM e) SELECT symbol, count(*) AS n, round(avg(r) / sqrt((sum(e * e)" + "".join(f" + {2 * (1 - j / (HAC_LAGS + 1))!r} * sum(c{j})" for j in range(1, HAC_LAGS + 1)) + ") / count(*) / count(*)), 5) AS t FROM l GROUP BY 1")
def robust_mean_t(spark, sf_dir):
    """t of the mean return with a variance that Bartlett weights over four lags make robust to autocorrelation."""
    w = W.partitionBy("symbol").orderBy("month")
    r = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r is not null")
    r = r.withColumn("e", F.col("r") - F.avg("r").over(W.partitionBy("symbol")))
    r = r.withColumns({f"c{j}": F.col("e") * F.lag("e", j).over(w) for j in range(1, HAC_LAGS + 1)})
    n = F.count(F.lit(1))
    variance = F.sum(F.col("e") * F.col("e"))
    for j in range(1, HAC_LAGS + 1):
        variance = variance + 2 * (1 - j / (HAC_LAGS + 1)) * F.sum(f"c{j}")
    return r.groupBy("symbol").agg(n.alias("n"), F.round(F.avg("r") / F.sqrt(variance / n / n), 5).alias("t"))


# Outcomes (H).

@query(f"WITH t AS (SELECT symbol, seq, ts_s, price, size FROM {TICKS}), p AS (SELECT symbol, ts_s, arg_max(price, seq) AS later FROM t GROUP BY 1, 2), a AS (SELECT symbol, seq, price, ts_s, h AS minutes, ts_s + h * 60 AS at FROM t CROSS JOIN (SELECT unnest([15, 30, 60])::BIGINT AS h) WHERE size >= 95) SELECT a.symbol, a.seq, a.minutes, CASE WHEN a.at // 86400 = a.ts_s // 86400 AND a.at - p.ts_s <= 1200 THEN round(p.later - a.price, 6) END AS points FROM a ASOF LEFT JOIN p ON a.symbol = p.symbol AND a.at >= p.ts_s")
def alert_outcomes(spark, sf_dir):
    """For each large print, the newest price 15, 30 and 60 minutes on, if it is fresh and of the same day."""
    t = T.ticks(spark, sf_dir)
    a = t.where("size >= 95").select("symbol", "seq", "price", "ts_s", F.explode(F.array(*[F.lit(h).cast("long") for h in (15, 30, 60)])).alias("minutes"))
    a = a.withColumn("at", F.col("ts_s") + F.col("minutes") * 60)
    p = t.groupBy("symbol", F.col("ts_s").alias("at")).agg(F.max_by("price", "seq").alias("later"))
    same_day = F.floor(F.col("at") / T.DAY_S) == _day()
    out = J.asof(a, p, "symbol", "at", "later", most_age=1_200)
    return out.select("symbol", "seq", "minutes", F.when(same_day, F.round(F.col("later") - F.col("price"), 6)).alias("points"))


@query(f"WITH y AS (SELECT least(volume // 100, 5) AS bin, CASE WHEN lead(close) {OVER}) > close THEN 1.0 WHEN lead(close) {OVER}) IS NOT NULL THEN 0.0 END AS y FROM {BARS}), b AS (SELECT *, (sum(y) OVER (PARTITION BY bin) + 1) / (count(*) OVER (PARTITION BY bin) + 2) AS p FROM y WHERE y IS NOT NULL) SELECT bin, count(*) AS n, round(max(p), 6) AS p, round(ln(max(p) / (1 - max(p))), 6) AS log_odds, round(avg(pow(p - y, 2)), 6) AS brier FROM b GROUP BY 1")
def calibration_bins(spark, sf_dir):
    """Share of rises after bars of each volume class, with a uniform prior, as log odds, and its Brier score."""
    ahead = F.lead("close").over(R.over())
    y = hourly(spark, sf_dir).select(F.least(F.floor(F.col("volume") / 100), F.lit(5).cast("long")).alias("bin"), F.when(ahead > F.col("close"), 1.0).when(ahead.isNotNull(), 0.0).alias("y")).where("y is not null")
    # The sums of a bin give the score: sum (p - y)^2 = n p^2 - 2 p k + k for k rises.
    b = y.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).withColumn("p", (F.col("k") + 1) / (F.col("n") + 2))
    brier = F.col("p") * F.col("p") + (1 - 2 * F.col("p")) * F.col("k") / F.col("n")
    return b.select("bin", "n", F.round("p", 6).alias("p"), F.round(F.log(F.col("p") / (1 - F.col("p"))), 6).alias("log_odds"), F.round(brier, 6).alias("brier"))


# Options (I).

def _contract():
    return W.partitionBy("underlying", "option_type", "strike").orderBy("month")


@query(f"SELECT underlying, option_type, strike, month, CASE WHEN m != month - 1 OR m IS NULL THEN 'new' WHEN oi > o AND premium > p THEN 'long build-up' WHEN oi > o THEN 'short build-up' WHEN premium > p THEN 'short covering' ELSE 'long unwinding' END AS state FROM (SELECT *, lag(month) OVER w AS m, lag(oi) OVER w AS o, lag(premium) OVER w AS p FROM {CHAIN} WINDOW w AS (PARTITION BY underlying, option_type, strike ORDER BY month))")
def interest_state(spark, sf_dir):
    """Open interest against price, only where the month before has the contract."""
    before = lambda c: F.lag(c).over(_contract())
    c = T.chain(spark, sf_dir).withColumns({"m": before("month"), "o": before("oi"), "p": before("premium")})
    up, dearer = F.col("oi") > F.col("o"), F.col("premium") > F.col("p")
    state = (F.when(F.col("m").isNull() | (F.col("m") != F.col("month") - 1), "new").when(up & dearer, "long build-up").when(up, "short build-up")
             .when(dearer, "short covering").otherwise("long unwinding"))
    return c.select("underlying", "option_type", "strike", "month", state.alias("state"))


@query(f"WITH a AS (SELECT *, greatest(oi - coalesce(lag(oi) OVER w, 0), 0) AS added FROM {CHAIN} WINDOW w AS (PARTITION BY underlying, option_type, strike ORDER BY month)) SELECT underlying, option_type, strike, month, round(sum(added * premium) OVER w - sum(added) OVER w * premium, 8) AS result FROM a WINDOW w AS (PARTITION BY underlying, option_type, strike ORDER BY month)")
def writers_result(spark, sf_dir):
    """What those who wrote the interest as it was added have gained at the premium of now."""
    added = F.greatest(F.col("oi") - F.coalesce(F.lag("oi").over(_contract()), F.lit(0.0)), F.lit(0.0))
    c = T.chain(spark, sf_dir).withColumn("added", added)
    result = F.sum(F.col("added") * F.col("premium")).over(_contract()) - F.sum("added").over(_contract()) * F.col("premium")
    return c.select("underlying", "option_type", "strike", "month", F.round(result, 8).alias("result"))


# Rules, archive and export (A, B).

#: Lot sizes by the day from which they hold.
REGIMES = [("1900-01-01", 25), ("1997-01-01", 50), ("2000-07-01", 75)]


@query("SELECT o_orderkey, lot FROM orders JOIN (SELECT CAST(d AS DATE) AS since, lot, lead(CAST(d AS DATE)) OVER (ORDER BY d) AS until FROM (VALUES " + ", ".join(f"('{d}', {lot})" for d, lot in REGIMES) + ") v(d, lot)) r ON CAST(o_orderdate AS DATE) >= since AND (until IS NULL OR CAST(o_orderdate AS DATE) < until)")
def rule_regimes(spark, sf_dir):
    """The lot size in force on each order's day; the handful of regimes becomes one expression."""
    day, lot = F.to_date("o_orderdate"), F.lit(None).cast("int")
    for since, size in REGIMES:
        lot = F.when(day >= F.lit(since).cast("date"), size).otherwise(lot)
    return T.table(spark, sf_dir, "orders").select("o_orderkey", lot.alias("lot"))


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_export(spark, sf_dir):
    """Customers as CSV with a header, read back by their schema."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = f"{folder(spark)}/lodestream/export-{uuid.uuid4().hex}"
    c.write.option("header", True).csv(path)
    return spark.read.schema(c.schema).option("header", True).csv(path)


@query(f"SELECT symbol, count(*) AS received, coalesce(sum(greatest(gap - 1, 0)), 0)::BIGINT AS lost, count(*) FILTER (WHERE gap <= 0) AS restarts FROM (SELECT symbol, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY ts_s, seq) AS gap FROM {TICKS}) GROUP BY 1")
def bus_losses(spark, sf_dir):
    """Messages of each stream that never came, by the gaps of their numbers; a number that falls is a restart."""
    gap = F.col("seq") - F.lag("seq").over(W.partitionBy("symbol").orderBy("ts_s", "seq"))
    return T.ticks(spark, sf_dir).select("symbol", gap.alias("gap")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("received"), F.coalesce(F.sum(F.greatest(F.col("gap") - 1, F.lit(0))), F.lit(0)).cast("long").alias("lost"), F.count_if(F.col("gap") <= 0).alias("restarts"))


@query(f"SELECT symbol, bar_s, round(close * (1 + 0.2 * sqrt(ahead / 365.0)), 6) AS upper, round(close * (1 - 0.2 * sqrt(ahead / 365.0)), 6) AS lower, ahead FROM (SELECT symbol, bar_s // 86400 * 86400 AS bar_s, arg_max(close, bar_s) AS close FROM {BARS} GROUP BY 1, 2) CROSS JOIN (SELECT unnest([1, 7, 30])::BIGINT AS ahead)")
def expected_move(spark, sf_dir):
    """The band of one deviation, at a volatility of a fifth a year, some days ahead of each day's close."""
    d = B.resample(hourly(spark, sf_dir), T.DAY_S).select("symbol", "bar_s", "close", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 7, 30)])).alias("ahead"))
    spread = 0.2 * F.sqrt(F.col("ahead") / 365.0)
    return d.select("symbol", "bar_s", F.round(F.col("close") * (1 + spread), 6).alias("upper"), F.round(F.col("close") * (1 - spread), 6).alias("lower"), "ahead")
