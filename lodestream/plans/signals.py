"""Registered queries of signals, backfills and quotes around trades."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..operators import signals as S
from ..sources import tables as T
from ..streaming import live
from .catalog import _TR, BARS, TICKS, exact, hourly, query
from .more import folder
from .series import _INDICATED, _N
from .stores import store

BENCHMARK = "view"


def _z(x: str, w: str) -> str:
    return f"CASE WHEN count(*) OVER {w} = 14 THEN CASE WHEN stddev_pop({x}) OVER {w} > 0 THEN 100 + ({x} - avg({x}) OVER {w}) / stddev_pop({x}) OVER {w} ELSE 100 END END"


@query(f"""WITH RECURSIVE b AS (SELECT a.symbol, a.bar_s, 100 * a.close / m.close AS rs, row_number() OVER (PARTITION BY a.symbol ORDER BY a.bar_s) AS n FROM {BARS} a JOIN {BARS} m ON m.bar_s = a.bar_s AND m.symbol = '{BENCHMARK}' WHERE a.symbol <> '{BENCHMARK}' AND m.close > 0),
    e AS (SELECT symbol, n, bar_s, rs AS e FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, b.bar_s, e + 2.0::DOUBLE / 6 * (rs - e) FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1),
    r AS (SELECT symbol, bar_s, {_z('e', 'w')} AS ratio FROM e WINDOW w AS (PARTITION BY symbol ORDER BY bar_s ROWS 13 PRECEDING) QUALIFY ratio IS NOT NULL),
    c AS (SELECT *, ratio - lag(ratio) OVER (PARTITION BY symbol ORDER BY bar_s) AS c FROM r QUALIFY c IS NOT NULL),
    z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_s) AS n FROM (SELECT symbol, bar_s, ratio, {_z('c', 'w')} AS z FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_s ROWS 13 PRECEDING)) WHERE z IS NOT NULL),
    m AS (SELECT symbol, n, bar_s, ratio, z AS momentum FROM z WHERE n = 1 UNION ALL SELECT z.symbol, z.n, z.bar_s, z.ratio, momentum + 0.5::DOUBLE * (z - momentum) FROM m JOIN z ON z.symbol = m.symbol AND z.n = m.n + 1)
    SELECT symbol, bar_s, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum, CASE WHEN ratio >= 100 AND momentum >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN momentum >= 100 THEN 'improving' ELSE 'lagging' END AS quadrant FROM m""")
def relative_rotation(spark, sf_dir):
    """Each symbol's strength against a benchmark and whether it gains, hour by hour."""
    return S.rotation(hourly(spark, sf_dir).select("symbol", "bar_s", "close"), BENCHMARK).withColumns({c: F.round(c, 6) for c in ("ratio", "momentum")})


@query(f"""WITH RECURSIVE {_INDICATED}, p AS (SELECT i.symbol, i.bar_s, b.open, lag(fast) OVER w AS f, lag(slow) OVER w AS s, lag(sig) OVER w AS g FROM i JOIN b ON b.symbol = i.symbol AND b.n = i.n WINDOW w AS (PARTITION BY i.symbol ORDER BY i.n))
    SELECT symbol, bar_s, round(m, 6) AS preview, round(g + 0.2::DOUBLE * (m - g), 6) AS preview_signal, round(f - s, 6) AS previous, round((s * (1 - 2.0::DOUBLE / 27) - f * (1 - 2.0::DOUBLE / 13)) / (2.0::DOUBLE / 13 - 2.0::DOUBLE / 27), 5) AS zero_price
    FROM (SELECT *, f + 2.0::DOUBLE / 13 * (open - f) - (s + 2.0::DOUBLE / 27 * (open - s)) AS m FROM p WHERE f IS NOT NULL)""")
def macd_preview(spark, sf_dir):
    """MACD if each hour closed at its opening price, and the close at which it would be zero."""
    out = S.macd_preview(hourly(spark, sf_dir), F.col("open"))
    return out.select("symbol", "bar_s", *[F.round(c, d).alias(c) for c, d in (("preview", 6), ("preview_signal", 6), ("previous", 6), ("zero_price", 5))])


@query(f"""WITH RECURSIVE c AS (SELECT symbol, bar_s, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_s) AS c FROM {BARS} QUALIFY c IS NOT NULL), b AS (SELECT *, {_N} AS n FROM c),
    r AS (SELECT symbol, n, bar_s, greatest(c, 0)::DOUBLE AS g, greatest(-c, 0)::DOUBLE AS l FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, b.bar_s, g + 1.0::DOUBLE / 14 * (greatest(c, 0) - g), l + 1.0::DOUBLE / 14 * (greatest(-c, 0) - l) FROM r JOIN b ON b.symbol = r.symbol AND b.n = r.n + 1)
    SELECT symbol, bar_s, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM r""")
def rsi_of_means(spark, sf_dir):
    """The form of RSI whose means the first change seeds."""
    return S.rsi_of_means(hourly(spark, sf_dir)).select("symbol", "bar_s", F.round("rsi", 6).alias("rsi"))


_RSI2 = f"""SELECT symbol, n, bar_s, CASE WHEN n > 2 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi, e, close FROM q"""
_VWAP = f"SELECT symbol, bar_s, close > coalesce({exact('(round(high * 100)::BIGINT + round(low * 100)::BIGINT + round(close * 100)::BIGINT) * volume', 'volume', 'OVER w', 300)}, round(close, 6)) AS above FROM {BARS} WINDOW w AS (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s)"


@query(f"""WITH RECURSIVE {_INDICATED}, t AS (SELECT *, b.close - lag(b.close) OVER (PARTITION BY symbol ORDER BY n) AS c FROM b),
    q AS (SELECT symbol, n, bar_s, close, close AS e, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM t WHERE n = 1 UNION ALL SELECT t.symbol, t.n, t.bar_s, t.close, e + 2.0::DOUBLE / 51 * (t.close - e),
        CASE WHEN t.n <= 2 THEN g + greatest(c, 0) WHEN t.n = 3 THEN (g + greatest(c, 0)) / 2 ELSE (g + greatest(c, 0)) / 2 END, CASE WHEN t.n <= 2 THEN l + greatest(-c, 0) WHEN t.n = 3 THEN (l + greatest(-c, 0)) / 2 ELSE (l + greatest(-c, 0)) / 2 END FROM q JOIN t ON t.symbol = q.symbol AND t.n = q.n + 1)
    SELECT 'macd_cross' AS rule, symbol, bar_s FROM (SELECT symbol, n, bar_s, fast - slow AS m, lag(fast - slow) OVER (PARTITION BY symbol ORDER BY n) AS before FROM i) WHERE before <= 0 AND m > 0 AND n > 27
    UNION ALL SELECT 'opening_range_break', symbol, min(bar_s) FROM (SELECT *, max(CASE WHEN bar_s % 86400 < 14400 THEN high END) OVER (PARTITION BY symbol, bar_s // 86400) AS top FROM {BARS}) WHERE bar_s % 86400 >= 14400 AND close > top GROUP BY symbol, bar_s // 86400
    UNION ALL SELECT 'vwap_reclaim', symbol, bar_s FROM (SELECT symbol, bar_s, above AND lag(above) OVER w AS held, lag(above, 2) OVER w AS before FROM ({_VWAP}) WINDOW w AS (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s)) WHERE held AND NOT before
    UNION ALL SELECT 'channel_break', symbol, bar_s FROM (SELECT *, max(high) OVER w AS top, count(*) OVER w AS k FROM {BARS} WINDOW w AS (PARTITION BY symbol ORDER BY bar_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE k = 20 AND close > top
    UNION ALL SELECT 'ignition', symbol, bar_s FROM (SELECT *, avg(volume) OVER w AS usual, count(*) OVER w AS k, avg(tr) OVER a AS atr, count(tr) OVER a AS m FROM ({_TR}) WINDOW w AS (PARTITION BY symbol ORDER BY bar_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY bar_s ROWS 13 PRECEDING)) WHERE k = 20 AND m = 14 AND volume >= 2 * usual AND close > open AND high - low >= 1.2 * atr
    UNION ALL SELECT 'pullback', symbol, bar_s FROM (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY n) AS before FROM ({_RSI2})) WHERE n > 50 AND close > e AND before < 10 AND rsi >= 10""")
def entry_rules(spark, sf_dir):
    """The entries of six rules, each called by its name with its parameters."""
    wanted = {"macd_cross": {}, "opening_range_break": {"seconds": 14_400}, "vwap_reclaim": {"confirm": 2}, "channel_break": {"lookback": 20}, "ignition": {"volume": 2.0, "reach": 1.2}, "pullback": {"threshold": 10.0}}
    return S.entries(hourly(spark, sf_dir), wanted)


@query(f"""WITH m AS (SELECT symbol, bar_s, close, lag(bar_s) OVER v AS from_s, lag(close) OVER v AS before, sign(close - lag(close) OVER v) AS way FROM {BARS} WINDOW v AS (PARTITION BY symbol ORDER BY bar_s)),
    g AS (SELECT *, sum(CASE WHEN way = lag_way AND way <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_s) AS run FROM (SELECT *, lag(way) OVER (PARTITION BY symbol ORDER BY bar_s) AS lag_way FROM m WHERE way IS NOT NULL))
    SELECT symbol, min(from_s) AS first, max(bar_s) AS last, count(*)::INTEGER AS moves, round(arg_max(close, bar_s) - arg_min(before, bar_s), 6) AS change FROM g WHERE way <> 0 GROUP BY symbol, run HAVING count(*) >= 3""")
def price_runs(spark, sf_dir):
    """Runs of three moves one way or more, by a table function over each symbol's hours in order."""
    S.register_runs(spark, "lodestream_price_runs")
    hourly(spark, sf_dir).select("symbol", "bar_s", "close").createOrReplaceTempView("lodestream_closes")
    out = spark.sql("SELECT * FROM lodestream_price_runs(least => 3, row => TABLE(SELECT symbol, bar_s, close FROM lodestream_closes) PARTITION BY symbol ORDER BY bar_s)")
    return out.withColumn("change", F.round("change", 6))


@query(f"""SELECT symbol, bar_s, close, source FROM (SELECT symbol, bar_s, close, 'live' AS source FROM {BARS} WHERE bar_s // 3600 % 6 > 1 UNION ALL SELECT symbol, bar_s, close, 'rebuilt' FROM {BARS} WHERE bar_s // 3600 % 6 <= 1)""")
def backfilled_bars(spark, sf_dir):
    """Hours that a stored table lacks, found by what the ticks have, rebuilt from them and merged without displacing a live bar."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    s = store(spark, "outage", ["symbol", "bar_s"])
    row = lambda df, source: df.select("symbol", "bar_s", "day", "close", F.lit(source).alias("source"))
    s.merge(row(b.where("bar_s div 3600 % 6 > 1"), "live"))
    have = s.read().select("symbol", "bar_s")
    traded = T.ticks(spark, sf_dir).select("symbol", F.expr("ts_s div 3600 * 3600").alias("bar_s")).distinct()
    missing = traded.join(have, ["symbol", "bar_s"], "left_anti")
    # A window refetched reaches an hour beyond each gap, so it brings bars that are there, too.
    wide = missing.select("symbol", F.explode(F.array(F.col("bar_s"), F.col("bar_s") + 3600)).alias("bar_s")).distinct()
    s.merge(row(b.join(wide, ["symbol", "bar_s"], "left_semi").withColumn("close", F.col("close")), "rebuilt"), F.struct((F.col("source") == "live").alias("live"), F.col("_new").alias("new")))
    return s.read().select("symbol", "bar_s", "close", "source")


@query(f"SELECT symbol, ts_s, arg_max(price, seq) AS price, max(seq) AS seq FROM {TICKS} GROUP BY 1, 2")
def stream_into_store(spark, sf_dir):
    """A stream whose micro-batches merge into a stored table by symbol and second, the newest number staying, twice over as after a restart."""
    t = T.ticks(spark, sf_dir).select("symbol", "ts_s", "price", "seq").withColumn("day", F.floor(F.col("ts_s") / T.DAY_S))
    low, high = t.agg(F.min("ts_s"), F.max("ts_s")).first()
    t = t.withColumn("part", F.floor((F.col("ts_s") - F.lit(low or 0)) * 3 / F.lit((high or 0) + 1 - (low or 0))).cast("int"))
    at = folder(spark)
    s = store(spark, "sunk", ["symbol", "ts_s"])

    def sink(batch, _):
        s.merge(batch, F.col("seq"))

    stream = live.delivered(t, "part", 3, at)
    for _ in range(2):  # a second run from the beginning brings every batch again and changes nothing
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/sink-{uuid.uuid4().hex}").trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read().select("symbol", "ts_s", "price", "seq")


_QUOTES = f"({T.SQL['quotes']})"


@query(f"""WITH q AS (SELECT *, lag(bid) OVER w AS b, lag(ask) OVER w AS a FROM {_QUOTES} WINDOW w AS (PARTITION BY symbol ORDER BY seq)), f AS (SELECT symbol, ts_s // 86400 AS day, size, seq % 2 = 0 AS buys, price, (a + b) / 2 AS mid, a - b AS spread FROM q WHERE size >= 30),
    l AS (SELECT *, greatest(0, spread / 2 - greatest(0, CASE WHEN buys THEN price - mid ELSE mid - price END)) * size AS extra, CASE WHEN mid > 0 THEN spread / mid * 100 END AS share FROM f)
    SELECT symbol, day, count(*) AS legs, count(spread) AS covered, round(count(spread) / count(*) * 100, 4) AS coverage, round(sum(extra), 4) AS extra, round(median(share), 6) AS median_spread FROM l GROUP BY 1, 2""")
def spread_marks(spark, sf_dir):
    """What half the quoted spread would have cost larger fills beyond what they paid, by day, with how many had a quote."""
    w = W.partitionBy("symbol").orderBy("seq")
    q = T.quotes(spark, sf_dir).withColumns({"b": F.lag("bid").over(w), "a": F.lag("ask").over(w)}).where("size >= 30")
    mid, spread = (F.col("a") + F.col("b")) / 2, F.col("a") - F.col("b")
    paid = F.when(F.col("seq") % 2 == 0, F.col("price") - mid).otherwise(mid - F.col("price"))
    extra = F.when(spread.isNotNull(), F.greatest(F.lit(0.0), spread / 2 - F.greatest(F.lit(0.0), paid)) * F.col("size"))
    l_ = q.select("symbol", F.floor(F.col("ts_s") / T.DAY_S).alias("day"), spread.alias("spread"), extra.alias("extra"), F.when(mid > 0, spread / mid * 100).alias("share"))
    return l_.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("legs"), F.count("spread").alias("covered"), F.round(F.count("spread") / F.count(F.lit(1)) * 100, 4).alias("coverage"), F.round(F.sum("extra"), 4).alias("extra"), F.round(F.median("share"), 6).alias("median_spread"))


_D = f"SELECT symbol, bar_s // 86400 AS day, arg_min(open, bar_s) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_s) AS close FROM {BARS} GROUP BY 1, 2"


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM ({_D})), e AS (SELECT symbol, day AS entry_day, n, close AS entry, close * 0.7 AS stop, close * 1.6 AS target, 10000 / close AS qty FROM d WHERE close > open),
    h AS (SELECT e.*, d.day, d.n - e.n AS k, d.close, CASE WHEN d.low <= stop THEN 'stop' WHEN d.high >= target THEN 'target' WHEN d.n - e.n = 3 THEN 'time' END AS why FROM e JOIN d ON d.symbol = e.symbol AND d.n BETWEEN e.n + 1 AND e.n + 3),
    x AS (SELECT symbol, entry_day, any_value(entry) AS entry, any_value(qty) AS qty, min(day) FILTER (WHERE why IS NOT NULL) AS exit_day, arg_min(CASE why WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE close END, day) FILTER (WHERE why IS NOT NULL) AS exit_price FROM h GROUP BY 1, 2),
    y AS (SELECT e.symbol, e.entry_day, e.entry, e.qty, x.exit_day, x.exit_price FROM e LEFT JOIN x ON x.symbol = e.symbol AND x.entry_day = e.entry_day),
    c AS (SELECT DISTINCT day FROM d), r AS (SELECT exit_day AS day, sum(qty * (exit_price - entry) - 0.001 * qty * (exit_price + entry)) AS pnl FROM y WHERE exit_day IS NOT NULL GROUP BY 1),
    o AS (SELECT d.day, sum(y.qty * (d.close - y.entry)) AS open_pnl, sum(y.qty * y.entry) AS deployed FROM y JOIN d ON d.symbol = y.symbol AND d.day >= y.entry_day AND (y.exit_day IS NULL OR d.day < y.exit_day) GROUP BY 1),
    q AS (SELECT c.day, sum(coalesce(r.pnl, 0)) OVER (ORDER BY c.day) AS realised, coalesce(o.open_pnl, 0) AS marks, coalesce(o.deployed, 0) AS deployed FROM c LEFT JOIN r ON r.day = c.day LEFT JOIN o ON o.day = c.day)
    SELECT day, round(realised, 3) AS realised, round(realised + marks, 3) AS equity, round(deployed, 3) AS deployed, round(realised + marks - greatest(0, max(realised + marks) OVER (ORDER BY day)), 3) AS drawdown FROM q""")
def held_equity(spark, sf_dir):
    """Equity of trades held three sessions unless a stop, looked at first, or a target ends them: realised after costs, and marks of what is open."""
    by = W.partitionBy("symbol")
    d = hourly(spark, sf_dir).groupBy("symbol", F.expr("bar_s div 86400").alias("day")).agg(F.min_by("open", "bar_s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_s").alias("close"))
    along = by.orderBy("day")
    ahead = F.array(*[F.struct(F.lead("day", k).over(along).alias("day"), F.lead("low", k).over(along).alias("low"), F.lead("high", k).over(along).alias("high"), F.lead("close", k).over(along).alias("close"), F.lit(k).alias("k")) for k in (1, 2, 3)])
    e = d.withColumn("ahead", ahead).where("close > open").select("symbol", F.col("day").alias("entry_day"), F.col("close").alias("entry"), (F.col("close") * 0.7).alias("stop"), (F.col("close") * 1.6).alias("target"), (10_000 / F.col("close")).alias("qty"), "ahead")
    ends = F.filter("ahead", lambda x: x["day"].isNotNull() & ((x["low"] <= F.col("stop")) | (x["high"] >= F.col("target")) | (x["k"] == 3)))
    end = F.get(ends, 0)
    price = F.when(end["low"] <= F.col("stop"), F.col("stop")).when(end["high"] >= F.col("target"), F.col("target")).otherwise(end["close"])
    y = e.select("symbol", "entry_day", "entry", "qty", end["day"].alias("exit_day"), F.when(end.isNotNull(), price).alias("exit_price"))
    pnl = F.col("qty") * (F.col("exit_price") - F.col("entry")) - 0.001 * F.col("qty") * (F.col("exit_price") + F.col("entry"))
    realised = y.where("exit_day is not null").groupBy(F.col("exit_day").alias("day")).agg(F.sum(pnl).alias("pnl"))
    # A trade is open for three sessions at most, so each meets its own days and no others.
    held = y.alias("y").join(d.alias("d"), (F.col("y.symbol") == F.col("d.symbol")) & (F.col("d.day") >= F.col("entry_day")) & (F.col("exit_day").isNull() | (F.col("d.day") < F.col("exit_day"))))
    marks = held.groupBy("day").agg(F.sum(F.col("qty") * (F.col("close") - F.col("entry"))).alias("marks"), F.sum(F.col("qty") * F.col("entry")).alias("deployed"))
    q = d.select("day").distinct().join(realised, "day", "left").join(marks, "day", "left").na.fill(0.0)
    q = q.withColumn("realised", F.sum("pnl").over(W.orderBy("day"))).withColumn("equity", F.col("realised") + F.col("marks"))  # a row a day
    peak = F.greatest(F.lit(0.0), F.max("equity").over(W.orderBy("day")))
    return q.select("day", F.round("realised", 3).alias("realised"), F.round("equity", 3).alias("equity"), F.round("deployed", 3).alias("deployed"), F.round(F.col("equity") - peak, 3).alias("drawdown"))
