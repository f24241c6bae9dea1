"""Registered queries: calendars and contracts, joins along time, ordered analytics, order flow on quotes."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import bars as B, calendar as C, quotes as Q, windows as R
from ..sources import tables as T
from .catalog import BARS, CHAIN, CLOSES, LADDER, TICKS, exact, hourly, query

QUOTES = f"({T.SQL['quotes']})"
DAYS = f"SELECT unnest(range(lo, hi + 1)) AS day FROM (SELECT min(ts_s) // 86400 AS lo, max(ts_s) // 86400 AS hi FROM {TICKS})"
SESSIONS = f"SELECT day, day * 86400 + 33300 AS open_ts, day * 86400 + 55800 AS close_ts, 'regular' AS kind FROM ({DAYS}) WHERE (day + 3) % 7 < 5 AND day % 17 != 3 UNION ALL SELECT day, day * 86400 + 64800, day * 86400 + 68400, 'special' FROM ({DAYS}) WHERE (day + 3) % 7 = 5 AND day % 4 = 0"


def days(spark, sf_dir):
    span = T.ticks(spark, sf_dir).select(F.floor(F.col("ts_s") / T.DAY_S).alias("day")).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias("day"))


def sessions(spark, sf_dir):
    """The sessions of the tables' days: every 17th day is a holiday, every fourth Saturday has an evening session."""
    d = days(spark, sf_dir)
    specials = d.where(((F.col("day") + 3) % 7 == 5) & (F.col("day") % 4 == 0)).select("day", F.lit(64_800).alias("open_s"), F.lit(68_400).alias("close_s"))
    return C.sessions(d, d.where("day % 17 = 3"), specials)


# Calendars, contracts, predicates (A, B).

@query(f"WITH s AS ({SESSIONS}) SELECT t.symbol, t.seq, s.kind FROM {TICKS} t JOIN s ON t.ts_s // 86400 = s.day WHERE t.ts_s >= open_ts AND t.ts_s < close_ts")
def session_ticks(spark, sf_dir):
    return C.in_session(T.ticks(spark, sf_dir), sessions(spark, sf_dir)).select("symbol", "seq", "kind")


@query(f"SELECT day, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day FROM ({SESSIONS}) WHERE kind = 'regular'")
def trading_days(spark, sf_dir):
    return C.with_neighbours(sessions(spark, sf_dir))


@query(f"SELECT day, kind, max(CASE WHEN kind = 'regular' THEN day END) OVER (ORDER BY day) AS logical_day FROM ({SESSIONS})")
def logical_days(spark, sf_dir):
    return C.logical_days(sessions(spark, sf_dir))


_EXPIRIES = f"SELECT month, by_rule, max(s.day) AS expiry FROM (SELECT year(DATE '1970-01-01' + day::INTEGER) * 12 + month(DATE '1970-01-01' + day::INTEGER) AS month, max(day) AS by_rule FROM ({DAYS}) WHERE (day + 3) % 7 = 1 GROUP BY 1) r JOIN ({SESSIONS}) s ON s.kind = 'regular' AND s.day <= r.by_rule GROUP BY 1, 2"


@query(_EXPIRIES)
def monthly_expiries(spark, sf_dir):
    return C.monthly_expiries(days(spark, sf_dir), sessions(spark, sf_dir), 1)


@query(f"WITH e AS ({_EXPIRIES}) SELECT d.day, count(*) AS live, min(e.expiry) AS front FROM ({DAYS}) d JOIN e ON e.expiry >= d.day GROUP BY 1")
def live_contracts(spark, sf_dir):
    e = C.monthly_expiries(days(spark, sf_dir), sessions(spark, sf_dir), 1)
    return days(spark, sf_dir).join(F.broadcast(e), F.col("expiry") >= F.col("day")).groupBy("day").agg(F.count(F.lit(1)).alias("live"), F.min("expiry").alias("front"))


_NAMES = f"SELECT DISTINCT upper(replace(underlying, '#', '')) || lpad(((month - 1) // 12 % 100)::VARCHAR, 2, '0') || lpad(((month - 1) % 12 + 1)::VARCHAR, 2, '0') || strike::BIGINT::VARCHAR || option_type AS name FROM {CHAIN}"


@query(f"SELECT name, regexp_extract(name, '^([A-Z]+[0-9]{{2}})([0-9]{{2}})([0-9]{{2}})([0-9]+)(CE|PE)$', 1) AS root, regexp_extract(name, '([0-9]{{2}})([0-9]{{2}})([0-9]+)(CE|PE)$', 0) != '' AS parsed, 2000 + CAST(substr(name, length(regexp_extract(name, '^[A-Z]+[0-9]{{2}}')) + 1, 2) AS INTEGER) AS year, CAST(substr(name, length(regexp_extract(name, '^[A-Z]+[0-9]{{2}}')) + 3, 2) AS INTEGER) AS month, right(name, 2) AS side FROM ({_NAMES})")
def option_symbols(spark, sf_dir):
    """Root, expiry month and side out of a contract's name."""
    c = T.chain(spark, sf_dir)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    name = F.concat(F.upper(F.replace("underlying", F.lit("#"), F.lit(""))), two(F.floor((F.col("month") - 1) / 12) % 100), two((F.col("month") - 1) % 12 + 1), F.col("strike").cast("long").cast("string"), F.col("option_type"))
    shape = r"^([A-Z]+[0-9]{2})([0-9]{2})([0-9]{2})([0-9]+)(CE|PE)$"
    part = lambda i: F.regexp_extract("name", shape, i)
    return c.select(name.alias("name")).distinct().select("name", part(1).alias("root"), (part(0) != "").alias("parsed"), (2000 + part(2).cast("int")).alias("year"), part(3).cast("int").alias("month"), part(5).alias("side"))


@query(f"SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE received_s - ts_s <= 120) AS trades, sum(size) FILTER (WHERE received_s - ts_s <= 120)::BIGINT AS volume, max(seq) AS last_seq FROM {QUOTES} GROUP BY 1")
def stale_prints(spark, sf_dir):
    """A print received over two minutes late sets a price but is no trade."""
    fresh = F.col("received_s") - F.col("ts_s") <= 120
    return T.quotes(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(fresh).alias("trades"), F.sum(F.when(fresh, F.col("size"))).alias("volume"), F.max("seq").alias("last_seq"))


@query(f"SELECT symbol, bar_s // 86400 AS day, count(*) AS known, max(bar_s) AS newest FROM {BARS} WHERE least(bar_s + 3600, bar_s // 86400 * 86400 + 55800) <= bar_s // 86400 * 86400 + 43200 GROUP BY 1, 2")
def known_by_noon(spark, sf_dir):
    """Bars that had ended, or whose session had, by twelve o'clock of their day."""
    day = F.expr("bar_s div 86400 * 86400")
    return hourly(spark, sf_dir).where(F.least(F.col("bar_s") + 3600, day + 55_800) <= day + 43_200).groupBy("symbol", F.expr("bar_s div 86400").alias("day")).agg(F.count(F.lit(1)).alias("known"), F.max("bar_s").alias("newest"))


@query(f"SELECT symbol, seq, CASE WHEN bid > 0 AND bid <= ask AND ask - bid <= 0.2 * (bid + ask) / 2 THEN round((bid + ask) / 2, 6) WHEN size > 0 THEN price END AS premium FROM {QUOTES}")
def tradable_premium(spark, sf_dir):
    """The middle of a book that is there and narrow, else the last price if anything traded."""
    mid = (F.col("bid") + F.col("ask")) / 2
    narrow = (F.col("bid") > 0) & (F.col("bid") <= F.col("ask")) & (F.col("ask") - F.col("bid") <= 0.2 * mid)
    return T.quotes(spark, sf_dir).select("symbol", "seq", F.when(narrow, F.round(mid, 6)).when(F.col("size") > 0, F.col("price")).alias("premium"))


@query(f"SELECT symbol, count(*) AS n, round(avg(price), 6) AS mean FROM {TICKS} WHERE (NULL IS NULL OR symbol = NULL) AND (50 IS NULL OR price >= 50) GROUP BY 1")
def named_parameters(spark, sf_dir):
    """A read-only view queried with named parameters, of which one may be left out."""
    view = "({ticks})"
    return spark.sql(f"SELECT symbol, count(*) AS n, round(avg(price), 6) AS mean FROM {view[1:-1]} WHERE (:symbol IS NULL OR symbol = :symbol) AND (:least IS NULL OR price >= :least) GROUP BY symbol", args={"symbol": None, "least": 50}, ticks=T.ticks(spark, sf_dir))


@query(f"SELECT symbol, bar_s FROM {BARS} b WHERE EXISTS (SELECT 1 FROM {BARS} o WHERE o.bar_s = b.bar_s AND o.symbol != b.symbol AND o.volume > 2 * b.volume)")
def exists_filter(spark, sf_dir):
    """Bars of which another symbol's at the same time has over twice the volume: the greatest of the time tells."""
    b = hourly(spark, sf_dir).select("symbol", "bar_s", "volume")
    most = b.groupBy("bar_s").agg(F.max("volume").alias("most"))
    return b.join(most, "bar_s").where("most > 2 * volume").select("symbol", "bar_s")


@query(f"SELECT symbol, count(*) FILTER (WHERE close IS DISTINCT FROM before) AS changed, count(*) AS n FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY bar_s) AS before FROM {BARS}) GROUP BY 1")
def distinct_changes(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("before", F.lag("close").over(R.over()))
    return b.groupBy("symbol").agg(F.count_if(~F.col("close").eqNullSafe(F.col("before"))).alias("changed"), F.count(F.lit(1)).alias("n"))


# Joins along time (C).

@query(f"WITH b AS (SELECT symbol, bar_s, close, bar_s // 86400 AS day FROM {BARS}), n AS (SELECT t.symbol, t.bar_s, t.close, max(p.bar_s) AS then_s FROM b t LEFT JOIN b p ON p.symbol = t.symbol AND p.day = t.day AND p.bar_s <= t.bar_s - 7200 AND t.bar_s - p.bar_s <= 14400 GROUP BY 1, 2, 3) SELECT n.symbol, n.bar_s, n.then_s, round(n.close - b.close, 6) AS change FROM n LEFT JOIN b ON b.symbol = n.symbol AND b.bar_s = n.then_s")
def bracketed_pairs(spark, sf_dir):
    """Each bar with the newest one at least two hours older of its day, if that is at most four hours old."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    earlier = W.partitionBy("symbol", "day").orderBy("bar_s").rangeBetween(-14_400, -7_200)
    then = F.max(F.struct("bar_s", "close")).over(earlier)
    return b.select("symbol", "bar_s", then["bar_s"].alias("then_s"), F.round(F.col("close") - then["close"], 6).alias("change"))


@query(f"WITH b AS {BARS}, n AS (SELECT t.symbol, t.bar_s, t.close, min(p.bar_s) AS at_s FROM b t LEFT JOIN b p ON p.symbol = t.symbol AND p.bar_s >= t.bar_s + 5400 AND p.bar_s <= t.bar_s + 86400 GROUP BY 1, 2, 3) SELECT n.symbol, n.bar_s, n.at_s, round(b.close / n.close - 1, 6) AS forward FROM n LEFT JOIN b ON b.symbol = n.symbol AND b.bar_s = n.at_s")
def first_at_or_after(spark, sf_dir):
    """The first bar an hour and a half or more ahead, within a day."""
    ahead = F.min(F.struct("bar_s", "close")).over(R.over().rangeBetween(5_400, 86_400))
    return hourly(spark, sf_dir).select("symbol", "bar_s", ahead["bar_s"].alias("at_s"), F.round(ahead["close"] / F.col("close") - 1, 6).alias("forward"))


@query(f"WITH c AS {CLOSES}, k AS (SELECT month, row_number() OVER (ORDER BY month) AS n FROM c WHERE symbol = '1-URGENT'), e AS (SELECT a.month AS first, b.month AS last FROM k a JOIN k b ON b.n = a.n + 3) SELECT s.symbol, e.first, e.last, round(y.close / x.close - 1, 6) AS change FROM (SELECT DISTINCT symbol FROM c) s CROSS JOIN e LEFT JOIN c x ON x.symbol = s.symbol AND x.month = e.first LEFT JOIN c y ON y.symbol = s.symbol AND y.month = e.last")
def benchmark_aligned(spark, sf_dir):
    """Changes of every series between dates of the benchmark's calendar, three of its dates apart."""
    c = T.closes(spark, sf_dir)
    dates = c.where("symbol = '1-URGENT'").select(F.col("month").alias("first"), F.lead("month", 3).over(W.orderBy("month")).alias("last")).where("last is not null")
    at = lambda n, v: c.select("symbol", F.col("month").alias(n), F.col("close").alias(v))
    ends = c.select("symbol").distinct().join(F.broadcast(dates))  # symbols times benchmark dates: the result's own size
    return ends.join(at("first", "x"), ["symbol", "first"], "left").join(at("last", "y"), ["symbol", "last"], "left").select("symbol", "first", "last", F.round(F.col("y") / F.col("x") - 1, 6).alias("change"))


_LEGS = f"SELECT underlying, month, strike, option_type, oi, row_number() OVER (PARTITION BY underlying, month ORDER BY oi DESC, strike, option_type) AS n FROM {CHAIN}"


@query(f"WITH l AS (SELECT * FROM ({_LEGS}) WHERE n <= 4) SELECT a.underlying, a.month, a.n AS first, b.n AS second, CASE WHEN a.option_type = b.option_type THEN 'vertical' WHEN a.strike = b.strike THEN 'straddle' ELSE 'strangle' END AS structure FROM l a JOIN l b ON a.underlying = b.underlying AND a.month = b.month AND a.n < b.n WHERE b.oi >= 0.5 * a.oi")
def leg_structures(spark, sf_dir):
    """Pairs of the four heaviest legs of a chain whose weights are within a factor of two."""
    heavy = W.partitionBy("underlying", "month").orderBy(F.desc("oi"), "strike", "option_type")
    legs = T.chain(spark, sf_dir).withColumn("n", F.row_number().over(heavy).cast("long")).where("n <= 4").select("underlying", "month", "strike", "option_type", "oi", "n")
    other = legs.select("underlying", "month", *[F.col(c).alias(f"{c}_b") for c in ("strike", "option_type", "oi", "n")])
    kind = F.when(F.col("option_type") == F.col("option_type_b"), "vertical").when(F.col("strike") == F.col("strike_b"), "straddle").otherwise("strangle")
    return legs.join(other, ["underlying", "month"]).where("n < n_b and oi_b >= 0.5 * oi").select("underlying", "month", F.col("n").alias("first"), F.col("n_b").alias("second"), kind.alias("structure"))


@query(f"WITH t AS (SELECT symbol, bar_s // 86400 AS day FROM {BARS} GROUP BY 1, 2 HAVING sum(volume) > 500) SELECT b.symbol, b.bar_s, b.volume FROM {BARS} b JOIN t ON t.symbol = b.symbol AND t.day = b.bar_s // 86400")
def staged_targets(spark, sf_dir):
    """Targets are found first, and only what belongs to them is read on."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    targets = b.groupBy("symbol", "day").agg(F.sum("volume").alias("v")).where("v > 500").select("symbol", "day")
    return b.join(targets, ["symbol", "day"], "left_semi").select("symbol", "bar_s", "volume")


# Ordered analytics (E).

@query(f"SELECT symbol, bar_s, " + ", ".join(f"{exact('round(close * 100)::BIGINT * volume', 'volume', f'OVER (PARTITION BY symbol, {p} ORDER BY bar_s)')} AS {n}" for n, p in (("day_vwap", "bar_s // 86400"), ("week_vwap", "(bar_s // 86400 + 3) // 7"), ("month_vwap", "strftime(make_timestamp(bar_s * 1000000), '%Y-%m')"))) + f" FROM {BARS}")
def anchored_vwap(spark, sf_dir):
    """VWAP since the start of the day, week and month, from sums in cents."""
    anchors = {"day_vwap": F.expr("bar_s div 86400"), "week_vwap": F.expr("(bar_s div 86400 + 3) div 7"), "month_vwap": F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(bar_s div 86400 as int)")), "month")}
    over = lambda a: W.partitionBy("symbol", a).orderBy("bar_s")
    traded = B.cents(F.col("close")) * F.col("volume")
    return hourly(spark, sf_dir).select("symbol", "bar_s", *[B.exact_mean(F.sum(traded).over(over(a)), F.sum("volume").over(over(a))).alias(n) for n, a in anchors.items()])


@query(f"SELECT symbol, bar_s, round(CASE WHEN count(*) OVER w >= 5 THEN CASE WHEN stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0 END END, 5) AS z FROM {BARS} WINDOW w AS (PARTITION BY symbol, bar_s % 86400 ORDER BY bar_s // 86400 RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def slot_z(spark, sf_dir):
    """A bar's volume against its slot on the 20 days before, from five of them on; 0 where those are flat."""
    w = W.partitionBy("symbol", F.col("bar_s") % T.DAY_S).orderBy(F.expr("bar_s div 86400")).rangeBetween(-20, -1)
    sd = F.stddev_samp("volume").over(w)
    z = F.when(sd > 0, (F.col("volume") - F.avg("volume").over(w)) / sd).otherwise(0.0)
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(F.when(F.count(F.lit(1)).over(w) >= 5, z), 5).alias("z"))


@query(f"SELECT symbol, bar_s // 86400 AS day, max(high) FILTER (WHERE bar_s % 86400 < 36000) AS ib_high, min(low) FILTER (WHERE bar_s % 86400 < 36000) AS ib_low, count(*) FILTER (WHERE bar_s % 86400 < 36000) >= 2 AS complete FROM {BARS} WHERE bar_s % 86400 >= 28800 GROUP BY 1, 2")
def initial_balance(spark, sf_dir):
    """High and low of the first two brackets of the session that opens at eight."""
    early = F.col("bar_s") % T.DAY_S < 36_000
    return hourly(spark, sf_dir).where(F.col("bar_s") % T.DAY_S >= 28_800).groupBy("symbol", F.expr("bar_s div 86400").alias("day")).agg(F.max(F.when(early, F.col("high"))).alias("ib_high"), F.min(F.when(early, F.col("low"))).alias("ib_low"), (F.count_if(early) >= 2).alias("complete"))


@query(f"SELECT symbol, bar_s // 86400 AS day, arg_max(close, bar_s) AS close, coalesce(arg_max(close, bar_s) >= max(close) FILTER (WHERE NOT newest), true) AS at_high, round(max(close) - arg_max(close, bar_s), 6) AS below FROM (SELECT *, bar_s = max(bar_s) OVER (PARTITION BY symbol, bar_s // 86400) AS newest FROM {BARS}) GROUP BY 1, 2")
def closing_highs(spark, sf_dir):
    """Whether a day's last close is at or over every close before it, and how far below the best."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    b = b.withColumn("newest", F.col("bar_s") == F.max("bar_s").over(W.partitionBy("symbol", "day")))
    last = F.max_by("close", "bar_s")
    return b.groupBy("symbol", "day").agg(last.alias("close"), F.coalesce(last >= F.max(F.when(~F.col("newest"), F.col("close"))), F.lit(True)).alias("at_high"), F.round(F.max("close") - last, 6).alias("below"))


_DAILY = f"SELECT symbol, bar_s // 86400 AS day, arg_min(open, bar_s) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_s) AS close, sum(volume)::BIGINT AS volume FROM {BARS} GROUP BY 1, 2"


def daily(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("symbol", F.expr("bar_s div 86400").alias("day")).agg(F.min_by("open", "bar_s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_s").alias("close"), F.sum("volume").alias("volume"))


@query(f"WITH d AS (SELECT symbol, day, close, (day + 3) // 7 AS week, row_number() OVER (PARTITION BY symbol, (day + 3) // 7 ORDER BY day) AS n FROM ({_DAILY})), r AS (SELECT symbol, week, arg_max(close, n) / arg_min(close, n) - 1 AS r FROM d WHERE n <= 3 GROUP BY 1, 2 HAVING count(*) = 3) SELECT symbol, week, round(r, 6) AS r, rank() OVER (PARTITION BY week ORDER BY r DESC, symbol) AS place FROM r")
def period_leaders(spark, sf_dir):
    """Symbols by their change over the first three sessions of a week."""
    along = W.partitionBy("symbol", "week").orderBy("day")
    d = daily(spark, sf_dir).withColumn("week", F.expr("(day + 3) div 7")).withColumn("n", F.row_number().over(along)).where("n <= 3")
    r = d.groupBy("symbol", "week").agg((F.max_by("close", "n") / F.min_by("close", "n") - 1).alias("r"), F.count(F.lit(1)).alias("held")).where("held = 3")
    return r.select("symbol", "week", F.round("r", 6).alias("r"), F.rank().over(W.partitionBy("week").orderBy(F.desc("r"), "symbol")).cast("long").alias("place"))


@query(f"SELECT symbol, month, round(close / first_value(close) OVER (PARTITION BY symbol ORDER BY month) - 1, 6) AS since_base FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month) AS n FROM {CLOSES}) QUALIFY (n - 1) % 6 = 0")
def checkpoints(spark, sf_dir):
    """The return since the base, sampled at every sixth month."""
    w = W.partitionBy("symbol").orderBy("month")
    c = T.closes(spark, sf_dir).select("symbol", "month", (F.col("close") / F.first("close").over(w) - 1).alias("r"), F.row_number().over(w).alias("n"))
    return c.where("(n - 1) % 6 = 0").select("symbol", "month", F.round("r", 6).alias("since_base"))


@query(f"WITH r AS (SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM {CLOSES}), l AS (SELECT a.symbol AS first, b.symbol AS second, k.lag, corr(a.r, b.r) AS c, count(*) AS n FROM r a JOIN (SELECT unnest(range(-2, 3)) AS lag) k ON true JOIN r b ON b.month = a.month + k.lag AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 15) SELECT first, second, lag, round(c, 6) AS correlation, n FROM (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY abs(round(c, 9)) DESC, lag) AS k FROM l) WHERE k = 1")
def lead_lag(spark, sf_dir):
    """The lag within two months at which two series move most together."""
    w = W.partitionBy("symbol").orderBy("month")
    r = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r is not null")
    a = r.select(F.col("symbol").alias("first"), F.col("r").alias("x"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("lag"), "month").withColumn("month", F.col("month") + F.col("lag"))
    b = r.select(F.col("symbol").alias("second"), F.col("r").alias("y"), "month")
    both = a.join(b, "month").where("first < second").groupBy("first", "second", "lag").agg(F.corr("x", "y").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 15")
    best = F.row_number().over(W.partitionBy("first", "second").orderBy(F.desc(F.abs(F.round("c", 9))), "lag"))
    return both.withColumn("k", best).where("k = 1").select("first", "second", F.col("lag").cast("long").alias("lag"), F.round("c", 6).alias("correlation"), "n")


@query(f"SELECT symbol, month, round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1, 6) AS m12_1, round(lag(close, 1) OVER w / lag(close, 6) OVER w - 1, 6) AS m6_1, round(close / max(close) OVER (w ROWS 11 PRECEDING), 6) AS of_high, round(-(close / lag(close) OVER w - 1), 6) AS reversal, round((close - min(close) OVER (w ROWS 4 PRECEDING)) / nullif(max(close) OVER (w ROWS 4 PRECEDING) - min(close) OVER (w ROWS 4 PRECEDING), 0), 6) AS channel FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY month)")
def factor_panel(spark, sf_dir):
    """Momentum without the last month, nearness to the year's high, reversal, place in the channel."""
    w = W.partitionBy("symbol").orderBy("month")
    year, five = w.rowsBetween(-11, 0), w.rowsBetween(-4, 0)
    ratio = lambda a, b: F.round(F.lag("close", a).over(w) / F.lag("close", b).over(w) - 1, 6)
    low, high = F.min("close").over(five), F.max("close").over(five)
    return T.closes(spark, sf_dir).select("symbol", "month", ratio(1, 12).alias("m12_1"), ratio(1, 6).alias("m6_1"), F.round(F.col("close") / F.max("close").over(year), 6).alias("of_high"), F.round(-(F.col("close") / F.lag("close").over(w) - 1), 6).alias("reversal"), F.round((F.col("close") - low) / F.nullif(high - low, F.lit(0.0)), 6).alias("channel"))


@query(f"WITH r AS (SELECT symbol, month, close / lag(close) OVER w - 1 AS past, lead(close) OVER w / close - 1 AS ahead FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY month)), t AS (SELECT *, ntile(3) OVER (PARTITION BY month ORDER BY past, symbol) AS third FROM r WHERE past IS NOT NULL AND ahead IS NOT NULL) SELECT month, round(avg(CASE WHEN third = 3 THEN ahead END) - avg(CASE WHEN third = 1 THEN ahead END), 6) AS spread, round(avg(ahead), 6) AS mean FROM t GROUP BY 1")
def top_minus_bottom(spark, sf_dir):
    """The next month's return of the best third of each month less the worst's."""
    w = W.partitionBy("symbol").orderBy("month")
    r = T.closes(spark, sf_dir).select("symbol", "month", (F.col("close") / F.lag("close").over(w) - 1).alias("past"), (F.lead("close").over(w) / F.col("close") - 1).alias("ahead")).where("past is not null and ahead is not null")
    t = r.withColumn("third", F.ntile(3).over(W.partitionBy("month").orderBy("past", "symbol")))
    mean = lambda k: F.avg(F.when(F.col("third") == k, F.col("ahead")))
    return t.groupBy("month").agg(F.round(mean(3) - mean(1), 6).alias("spread"), F.round(F.avg("ahead"), 6).alias("mean"))


_COUNTER = f"SELECT symbol, seq, ts_s // 86400 AS day, CASE WHEN seq % 41 = 0 THEN 0 ELSE sum(size) OVER (PARTITION BY symbol, ts_s // 86400 ORDER BY seq) END::BIGINT AS total FROM {TICKS}"


def counters(spark, sf_dir):
    w = W.partitionBy("symbol", "day").orderBy("seq")
    return T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S)).select("symbol", "seq", "day", F.when(F.col("seq") % 41 == 0, F.lit(0)).otherwise(F.sum("size").over(w)).cast("long").alias("total"))


@query(f"WITH r AS (SELECT *, coalesce(total < lag(total) OVER w, false) AS reset FROM ({_COUNTER}) WINDOW w AS (PARTITION BY symbol, day ORDER BY seq)) SELECT symbol, day, count(*) FILTER (WHERE reset) AS resets, count(*) FILTER (WHERE seq >= first) AS invalid FROM (SELECT *, min(CASE WHEN reset THEN seq END) OVER (PARTITION BY symbol, day) AS first FROM r) GROUP BY 1, 2")
def counter_resets(spark, sf_dir):
    """Falls of a counter that should only grow; from the first of a day on its rows don't count."""
    w = W.partitionBy("symbol", "day").orderBy("seq")
    r = counters(spark, sf_dir).withColumn("reset", F.coalesce(F.col("total") < F.lag("total").over(w), F.lit(False)))
    r = r.withColumn("first", F.min(F.when(F.col("reset"), F.col("seq"))).over(W.partitionBy("symbol", "day")))
    return r.groupBy("symbol", "day").agg(F.count_if("reset").alias("resets"), F.count_if(F.col("seq") >= F.col("first")).alias("invalid"))


@query(f"SELECT symbol, seq, greatest(0, total - lag(total) OVER (PARTITION BY symbol, day ORDER BY seq))::BIGINT AS traded FROM ({_COUNTER})")
def counter_increments(spark, sf_dir):
    w = W.partitionBy("symbol", "day").orderBy("seq")
    return counters(spark, sf_dir).select("symbol", "seq", F.when(F.lag("total").over(w).isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("total") - F.lag("total").over(w))).cast("long").alias("traded"))


# Order flow on quotes (G).

_W = "OVER (PARTITION BY symbol ORDER BY seq)"
_VOTES = f"SELECT *, CASE WHEN price >= lag(ask) {_W} THEN 1 WHEN price <= lag(bid) {_W} THEN -1 ELSE 0 END AS q, CASE WHEN lag(ask_total) {_W} - ask_total >= 0.8 * size AND lag(bid_total) {_W} - bid_total < 0.2 * size THEN 1 WHEN lag(bid_total) {_W} - bid_total >= 0.8 * size AND lag(ask_total) {_W} - ask_total < 0.2 * size THEN -1 ELSE 0 END AS p, coalesce(sign(price - lag(price) {_W}), 0)::INTEGER AS t FROM {QUOTES}"
_COMBINED = f"SELECT *, CASE WHEN q != 0 AND p = q THEN 'quote+pending' WHEN q != 0 THEN 'quote' WHEN p != 0 THEN 'pending' WHEN t != 0 THEN 'tick' WHEN side != 0 THEN 'carry' ELSE 'none' END AS method FROM (SELECT *, coalesce(last_value(nullif(CASE WHEN q != 0 THEN q WHEN p != 0 THEN p ELSE t END, 0) IGNORE NULLS) {_W}, 0)::INTEGER AS side FROM ({_VOTES}))"


@query(f"SELECT symbol, seq, q AS quote_vote, p AS pending_vote, t AS tick_vote FROM ({_VOTES})")
def quote_votes(spark, sf_dir):
    return Q.votes(T.quotes(spark, sf_dir)).select("symbol", "seq", "quote_vote", "pending_vote", "tick_vote")


def combined(spark, sf_dir):
    return Q.combined(Q.votes(T.quotes(spark, sf_dir)), F.col("received_s") - F.col("ts_s") > 60)


@query(f"SELECT symbol, seq, side, method, round(CASE method WHEN 'quote+pending' THEN 0.9 WHEN 'quote' THEN 0.7 WHEN 'pending' THEN 0.6 WHEN 'tick' THEN 0.5 WHEN 'carry' THEN 0.4 ELSE 0 END * CASE WHEN received_s - ts_s > 60 THEN 0.8 ELSE 1 END, 4)::DOUBLE AS confidence FROM ({_COMBINED})")
def combined_votes(spark, sf_dir):
    return combined(spark, sf_dir).select("symbol", "seq", "side", "method", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT symbol, seq, traded, last_value(CASE WHEN traded > 0 THEN price END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref_price FROM (SELECT c.*, t.price, greatest(0, total - lag(total) OVER (PARTITION BY c.symbol, day ORDER BY c.seq))::BIGINT AS traded FROM ({_COUNTER}) c JOIN {TICKS} t ON t.seq = c.seq)".replace("greatest(0, total", "CASE WHEN lag(total) OVER (PARTITION BY c.symbol, day ORDER BY c.seq) IS NULL THEN 0 ELSE greatest(0, total").replace("c.seq))::BIGINT AS traded", "c.seq)) END::BIGINT AS traded"))
def tape_from_totals(spark, sf_dir):
    totals = counters(spark, sf_dir).select("seq", "total").join(T.ticks(spark, sf_dir), "seq")
    return Q.tape(totals).select("symbol", "seq", F.col("traded").cast("long").alias("traded"), "ref_price")


@query(f"SELECT symbol, count(*) AS prints, count(*) FILTER (WHERE n = 60 AND abs(pressure) >= 0.05 AND span <= 95) AS absorbing FROM (SELECT symbol, count(*) OVER w AS n, sum(side * size) OVER w / nullif(sum(size) OVER w, 0) AS pressure, max(price) OVER w - min(price) OVER w AS span FROM ({_COMBINED}) WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 59 PRECEDING)) GROUP BY 1")
def tape_absorption(spark, sf_dir):
    a = Q.absorption(combined(spark, sf_dir), tick=95 / 4, pressure=0.05)
    return a.groupBy("symbol").agg(F.count(F.lit(1)).alias("prints"), F.count_if("absorbing").alias("absorbing"))


_HOURLY_FLOW = f"SELECT symbol, ts_s // 86400 AS day, ts_s // 3600 * 3600 AS bar_s, sum(size)::BIGINT AS volume, sum(side * size)::BIGINT AS delta, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close FROM ({_COMBINED}) GROUP BY 1, 2, 3"


def hourly_flow(spark, sf_dir):
    return combined(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_s") / T.DAY_S).alias("day"), F.expr("ts_s div 3600 * 3600").alias("bar_s")).agg(
        F.sum("size").alias("volume"), F.sum(F.col("side") * F.col("size")).alias("delta"), F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"))


@query(f"SELECT symbol, day, bar_s, volume, median FROM (SELECT *, max(CASE WHEN place = n // 2 + 1 THEN volume END) OVER (PARTITION BY symbol, day) AS median FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY volume, bar_s) AS place, count(*) OVER (PARTITION BY symbol, day) AS n FROM ({_HOURLY_FLOW}))) WHERE volume >= 1.5 * median AND abs(delta) >= 0.3 * volume")
def flow_bursts(spark, sf_dir):
    return Q.bursts(hourly_flow(spark, sf_dir), 1.5, 0.3).select("symbol", "day", "bar_s", "volume", "median")


_LAST = f"SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY bar_s)::BIGINT AS cvd, row_number() OVER (PARTITION BY symbol ORDER BY bar_s DESC) AS back FROM ({_HOURLY_FLOW})"


@query(f"SELECT symbol, max(high) FILTER (WHERE back <= 30) > max(high) FILTER (WHERE back > 30) AND max(cvd) FILTER (WHERE back <= 30) <= max(cvd) FILTER (WHERE back > 30) AS bearish, min(low) FILTER (WHERE back <= 30) < min(low) FILTER (WHERE back > 30) AND min(cvd) FILTER (WHERE back <= 30) >= min(cvd) FILTER (WHERE back > 30) AS bullish, arg_min(cvd, back) AS cvd FROM ({_LAST}) WHERE back <= 60 GROUP BY 1")
def half_window_divergence(spark, sf_dir):
    """Whether the newer half of the last 60 bars made an extreme that cumulative delta did not."""
    along = W.partitionBy("symbol").orderBy("bar_s")
    f = hourly_flow(spark, sf_dir).withColumns({"cvd": F.sum("delta").over(along), "back": F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_s")))}).where("back <= 60")
    of = lambda agg, c, newer: agg(F.when((F.col("back") <= 30) if newer else (F.col("back") > 30), F.col(c)))
    up = (of(F.max, "high", True) > of(F.max, "high", False)) & (of(F.max, "cvd", True) <= of(F.max, "cvd", False))
    down = (of(F.min, "low", True) < of(F.min, "low", False)) & (of(F.min, "cvd", True) >= of(F.min, "cvd", False))
    return f.groupBy("symbol").agg(up.alias("bearish"), down.alias("bullish"), F.min_by("cvd", "back").alias("cvd"))


@query(f"SELECT symbol, bar_s, CASE WHEN high > hi AND cvd < chi THEN 'classic bearish' WHEN low < lo AND cvd > clo THEN 'classic bullish' WHEN high < hi AND cvd > chi THEN 'hidden bearish' WHEN low > lo AND cvd < clo THEN 'hidden bullish' END AS kind FROM (SELECT symbol, bar_s, high, low, cvd, max(high) OVER w AS hi, min(low) OVER w AS lo, max(cvd) OVER w AS chi, min(cvd) OVER w AS clo FROM ({_LAST}) WINDOW w AS (PARTITION BY symbol ORDER BY bar_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE hi IS NOT NULL")
def bar_divergence(spark, sf_dir):
    along = W.partitionBy("symbol").orderBy("bar_s")
    before = along.rowsBetween(-20, -1)
    f = hourly_flow(spark, sf_dir).withColumn("cvd", F.sum("delta").over(along))
    f = f.withColumns({"hi": F.max("high").over(before), "lo": F.min("low").over(before), "chi": F.max("cvd").over(before), "clo": F.min("cvd").over(before)}).where("hi is not null")
    kind = F.when(F.expr("high > hi and cvd < chi"), "classic bearish").when(F.expr("low < lo and cvd > clo"), "classic bullish").when(F.expr("high < hi and cvd > chi"), "hidden bearish").when(F.expr("low > lo and cvd < clo"), "hidden bullish")
    return f.select("symbol", "bar_s", kind.alias("kind"))


@query(f"WITH c AS (SELECT symbol, ts_s // 600 * 600 AS slot, count(*) AS updates, sum(size)::BIGINT AS quantity FROM {TICKS} GROUP BY 1, 2) SELECT symbol, slot, updates, quantity, round((SELECT avg(CASE WHEN h.updates < c.updates THEN 1.0 ELSE 0.0 END) FROM c h WHERE h.symbol = c.symbol AND h.slot < c.slot AND h.slot >= c.slot - 21600), 6) AS speed FROM c")
def tape_speed(spark, sf_dir):
    """Updates in ten minutes, and the share of the six hours before that were slower."""
    c = T.ticks(spark, sf_dir).groupBy("symbol", F.expr("ts_s div 600 * 600").alias("slot")).agg(F.count(F.lit(1)).alias("updates"), F.sum("size").alias("quantity"))
    before = F.collect_list("updates").over(W.partitionBy("symbol").orderBy("slot").rangeBetween(-21_600, -1))  # 36 slots at most
    c = c.withColumn("before", before)
    return c.select("symbol", "slot", "updates", "quantity", F.round(F.when(F.size("before") > 0, F.size(F.filter("before", lambda v: v < F.col("updates"))) / F.size("before")), 6).alias("speed"))


@query(f"SELECT symbol, CAST(sign(level - 40) * floor(abs(level - 40) / 3.0 + 0.5) AS BIGINT) AS row, sum(buy) AS buy, sum(sell) AS sell FROM {LADDER} GROUP BY 1, 2")
def regridded_rows(spark, sf_dir):
    """Levels counted from 40, three to a row, halves rounded away from it on either side."""
    off = F.col("level") - 40
    return T.ladder(spark, sf_dir).groupBy("symbol", (F.sign(off) * F.floor(F.abs(off) / 3 + 0.5)).cast("long").alias("row")).agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


@query(f"SELECT symbol, level, volume, round(pressure, 6) AS pressure FROM (SELECT symbol, level, buy + sell AS volume, (buy - sell) / nullif(buy + sell, 0) AS pressure, quantile_cont(buy + sell, 0.5) OVER (PARTITION BY symbol) AS mid FROM {LADDER}) WHERE volume >= 1.2 * mid AND abs(pressure) >= 0.05")
def row_absorption(spark, sf_dir):
    """Rows of much volume that one side pressed on."""
    r = T.ladder(spark, sf_dir).select("symbol", "level", (F.col("buy") + F.col("sell")).alias("volume"), ((F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0.0))).alias("pressure"))
    mid = r.groupBy("symbol").agg(F.percentile("volume", F.lit(0.5)).alias("mid"))
    return r.join(F.broadcast(mid), "symbol").where("volume >= 1.2 * mid and abs(pressure) >= 0.05").select("symbol", "level", "volume", F.round("pressure", 6).alias("pressure"))


@query(f"SELECT symbol, level, volume, edge FROM (SELECT symbol, level, volume, CASE WHEN n = of_ THEN 'high' WHEN n = 1 THEN 'low' END AS edge, CASE WHEN n = of_ THEN lag(volume) OVER w ELSE lead(volume) OVER w END AS one, CASE WHEN n = of_ THEN lag(volume, 2) OVER w ELSE lead(volume, 2) OVER w END AS two, max(volume) OVER (PARTITION BY symbol) AS most FROM (SELECT symbol, level, buy + sell + unclassified AS volume, row_number() OVER (PARTITION BY symbol ORDER BY level) AS n, count(*) OVER (PARTITION BY symbol) AS of_ FROM {LADDER}) WINDOW w AS (PARTITION BY symbol ORDER BY level)) WHERE edge IS NOT NULL AND volume <= 0.25 * most AND one > volume AND two > volume")
def exhausted_edges(spark, sf_dir):
    """An extreme row of little volume with two larger ones behind it."""
    w = W.partitionBy("symbol").orderBy("level")
    r = T.ladder(spark, sf_dir).select("symbol", "level", (F.col("buy") + F.col("sell") + F.col("unclassified")).alias("volume"))
    r = r.withColumns({"n": F.row_number().over(w), "of": F.count(F.lit(1)).over(W.partitionBy("symbol")), "most": F.max("volume").over(W.partitionBy("symbol"))})
    inner = lambda k: F.when(F.col("n") == F.col("of"), F.lag("volume", k).over(w)).otherwise(F.lead("volume", k).over(w))
    r = r.withColumns({"one": inner(1), "two": inner(2), "edge": F.when(F.col("n") == F.col("of"), "high").when(F.col("n") == 1, "low")})
    return r.where("edge is not null and volume <= 0.25 * most and one > volume and two > volume").select("symbol", "level", "volume", "edge")


@query(f"SELECT symbol, bar_s, round(shares, 6) AS classified, CASE WHEN shares < 0.5 THEN 'suppressed' WHEN quoted >= 0.6 THEN 'high' WHEN quoted >= 0.3 THEN 'medium' ELSE 'low' END AS grade FROM (SELECT symbol, ts_s // 3600 * 3600 AS bar_s, sum(CASE WHEN side != 0 THEN size ELSE 0 END) / nullif(sum(size), 0) AS shares, sum(CASE WHEN method LIKE 'quote%' THEN size ELSE 0 END) / nullif(sum(size), 0) AS quoted FROM ({_COMBINED}) GROUP BY 1, 2)")
def confidence_grades(spark, sf_dir):
    share = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0)) / F.nullif(F.sum("size"), F.lit(0))
    g = combined(spark, sf_dir).groupBy("symbol", F.expr("ts_s div 3600 * 3600").alias("bar_s")).agg(share(F.col("side") != 0).alias("shares"), share(F.col("method").startswith("quote")).alias("quoted"))
    grade = F.when(F.col("shares") < 0.5, "suppressed").when(F.col("quoted") >= 0.6, "high").when(F.col("quoted") >= 0.3, "medium").otherwise("low")
    return g.select("symbol", "bar_s", F.round("shares", 6).alias("classified"), grade.alias("grade"))


@query(f"SELECT symbol, period, round(delta / volume, 6) AS share, CASE WHEN delta >= 0.2 * volume THEN 'buy' WHEN delta <= -0.2 * volume THEN 'sell' ELSE 'none' END AS label, parts = 2 AS complete FROM (SELECT symbol, bar_s // 7200 * 7200 AS period, sum(delta)::BIGINT AS delta, sum(volume)::BIGINT AS volume, count(*) AS parts FROM ({_HOURLY_FLOW}) GROUP BY 1, 2) WHERE volume > 0")
def initiative_periods(spark, sf_dir):
    p = hourly_flow(spark, sf_dir).groupBy("symbol", F.expr("bar_s div 7200 * 7200").alias("period")).agg(F.sum("delta").alias("delta"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("parts")).where("volume > 0")
    label = F.when(F.expr("delta >= 0.2 * volume"), "buy").when(F.expr("delta <= -0.2 * volume"), "sell").otherwise("none")
    return p.select("symbol", "period", F.round(F.col("delta") / F.col("volume"), 6).alias("share"), label.alias("label"), (F.col("parts") == 2).alias("complete"))


@query(f"SELECT symbol, day, CASE WHEN o = lo AND c > o THEN 'drive up' WHEN o = hi AND c < o THEN 'drive down' WHEN c > o AND lo < o AND c >= hi - 0.25 * (hi - lo) THEN 'test-drive up' WHEN c < o AND hi > o AND c <= lo + 0.25 * (hi - lo) THEN 'test-drive down' WHEN abs(c - o) <= 0.25 * (hi - lo) THEN 'auction' ELSE 'rejection' END AS open_type FROM (SELECT symbol, day, arg_min(open, bar_s) AS o, max(high) AS hi, min(low) AS lo, arg_max(close, bar_s) AS c FROM (SELECT *, bar_s // 86400 AS day, row_number() OVER (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s) AS n FROM {BARS}) WHERE n <= 2 GROUP BY 1, 2)")
def open_types(spark, sf_dir):
    """What the first bars of a day did with its opening price."""
    first = F.row_number().over(W.partitionBy("symbol", "day").orderBy("bar_s"))
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400")).withColumn("n", first).where("n <= 2")
    b = b.groupBy("symbol", "day").agg(F.min_by("open", "bar_s").alias("o"), F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "bar_s").alias("c"))
    kind = (F.when(F.expr("o = lo and c > o"), "drive up").when(F.expr("o = hi and c < o"), "drive down").when(F.expr("c > o and lo < o and c >= hi - 0.25 * (hi - lo)"), "test-drive up")
            .when(F.expr("c < o and hi > o and c <= lo + 0.25 * (hi - lo)"), "test-drive down").when(F.expr("abs(c - o) <= 0.25 * (hi - lo)"), "auction").otherwise("rejection"))
    return b.select("symbol", "day", kind.alias("open_type"))


@query(f"SELECT symbol, bar_s, open, high, low, close, round(delta / nullif(volume, 0), 6) AS strength FROM ({_HOURLY_FLOW})")
def delta_candles(spark, sf_dir):
    return hourly_flow(spark, sf_dir).select("symbol", "bar_s", "open", "high", "low", "close", F.round(F.col("delta") / F.nullif(F.col("volume"), F.lit(0)), 6).alias("strength"))
