"""Registered streams with keyed state, each with its batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B, indicators as I
from ..sources import tables as T
from ..streaming import live
from .catalog import TICKS, query
from .more import folder

#: Days of history before the stream, and deliveries of the rest.
HISTORY_DAYS, DELIVERIES = 10, 6
OPEN_S, CLOSE_S = live.SESSION_S
_DELAY = "CASE WHEN seq % 20 = 0 THEN 93600 WHEN seq % 33 = 0 THEN 345600 ELSE seq % 7 END"
#: Ticks with the second of arrival, and the delivery that brings them: arrivals cut in equal spans of time.
_ARRIVED = f"""SELECT *, least({DELIVERIES - 1}, (arrived_s - first_s) * {DELIVERIES} // (last_s + 1 - first_s))::BIGINT AS part FROM (SELECT *, min(arrived_s) OVER () AS first_s, max(arrived_s) OVER () AS last_s
    FROM (SELECT symbol, seq, ts_s, price, size, ts_s + {_DELAY} AS arrived_s, ts_s // 86400 - (SELECT min(ts_s) // 86400 FROM {TICKS}) < {HISTORY_DAYS} AS old FROM {TICKS}) WHERE NOT old)"""
_HISTORY = f"""SELECT symbol, ts_s // 3600 * 3600 AS bar_s, arg_max(price, seq) AS close FROM {TICKS} WHERE ts_s // 86400 - (SELECT min(ts_s) // 86400 FROM {TICKS}) < {HISTORY_DAYS} AND ts_s % 86400 >= {OPEN_S} AND ts_s % 86400 < {CLOSE_S} GROUP BY 1, 2"""
#: Which ticks a pass in order of arrival takes: a bar is closed for a tick if a later one has begun, or if the clock of the delivery before had passed its end.
_TAKEN = f"""a AS ({_ARRIVED}), c AS (SELECT p.part, max(a.arrived_s) AS clock FROM (SELECT DISTINCT part FROM a) p JOIN a ON a.part < p.part GROUP BY 1),
    v AS (SELECT *, ts_s // 3600 * 3600 AS bar_s, least(ts_s // 3600 * 3600 + 3600, ts_s // 86400 * 86400 + {CLOSE_S}) + 600 AS due, CASE WHEN ts_s % 86400 < {OPEN_S} OR ts_s % 86400 >= {CLOSE_S} THEN 'off session' WHEN arrived_s - ts_s > {live.STALE_S} THEN 'stale' END AS why FROM a),
    m AS (SELECT *, max(bar_s) OVER (PARTITION BY symbol ORDER BY arrived_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, min(part) OVER (PARTITION BY symbol, bar_s) AS begun FROM v WHERE why IS NULL),
    k AS (SELECT m.*, CASE WHEN m.bar_s < newest OR m.bar_s = newest AND begun <= m.part - 1 AND coalesce(c.clock >= m.due, false) THEN 'late' END AS late FROM m LEFT JOIN c ON c.part = m.part - 1),
    b AS (SELECT symbol, bar_s, arg_min(price, (arrived_s, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (arrived_s, seq)) AS close, sum(size)::BIGINT AS volume, any_value(due) AS due FROM k WHERE late IS NULL GROUP BY 1, 2),
    d AS (SELECT * FROM b WHERE due <= (SELECT max(arrived_s) FROM a) OR EXISTS (SELECT 1 FROM b n WHERE n.symbol = b.symbol AND n.bar_s > b.bar_s))"""


def arriving(spark, sf_dir):
    """(ticks of the history, later ticks with their arrival and delivery)."""
    t = T.ticks(spark, sf_dir)
    first = t.agg(F.floor(F.min("ts_s") / T.DAY_S)).first()[0] or 0
    old = F.floor(F.col("ts_s") / T.DAY_S) - first < HISTORY_DAYS
    later = t.where(~old).withColumn("arrived_s", F.col("ts_s") + F.when(F.col("seq") % 20 == 0, 93_600).when(F.col("seq") % 33 == 0, 345_600).otherwise(F.col("seq") % 7))
    low, high = later.agg(F.min("arrived_s"), F.max("arrived_s")).first()
    part = F.least(F.lit(DELIVERIES - 1), F.floor((F.col("arrived_s") - F.lit(low or 0)) * DELIVERIES / F.lit((high or 0) + 1 - (low or 0))))
    return t.where(old), later.withColumns({"part": part.cast("int"), "arrived": F.timestamp_seconds("arrived_s")})


def session_stream(spark, sf_dir):
    """What keyed state makes of the later ticks, begun from the indicator of the history's bars; one table."""
    old, later = arriving(spark, sf_dir)
    at = F.col("ts_s") % T.DAY_S
    stored = B.bars(old.where((at >= OPEN_S) & (at < CLOSE_S)), 3600)
    ends = I.macd(stored).groupBy("symbol").agg(F.max("bar_s").alias("last_s"), *[F.max_by(c, "bar_s").alias(c) for c in ("fast", "slow", "signal")])
    at_folder = folder(spark)
    with live.rocksdb(spark):
        return live.drained(live.session_bars(live.delivered(later, "part", DELIVERIES, at_folder), ends), at_folder)


@query(f"""WITH RECURSIVE {_TAKEN}, h AS ({_HISTORY}), s AS (SELECT symbol, bar_s, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_s) AS n FROM (SELECT symbol, bar_s, close FROM h UNION ALL SELECT symbol, bar_s, close FROM d)),
    r AS (SELECT symbol, n, bar_s, close AS fast, close AS slow, 0.0::DOUBLE AS signal FROM s WHERE n = 1 UNION ALL SELECT s.symbol, s.n, s.bar_s, fast + 2.0::DOUBLE / 13 * (close - fast), slow + 2.0::DOUBLE / 27 * (close - slow),
        signal + 2.0::DOUBLE / 10 * ((fast + 2.0::DOUBLE / 13 * (close - fast)) - (slow + 2.0::DOUBLE / 27 * (close - slow)) - signal) FROM r JOIN s ON s.symbol = r.symbol AND s.n = r.n + 1)
    SELECT d.symbol, d.bar_s, open, high, low, close, volume, round(fast - slow, 6) AS macd, round(signal, 6) AS signal FROM d JOIN r ON r.symbol = d.symbol AND r.bar_s = d.bar_s""")
def stream_session_bars(spark, sf_dir):
    """Bars of a stream with late, stale and idle stretches, with an indicator seeded from stored bars."""
    out = session_stream(spark, sf_dir).where("kind = 'bar'")
    return out.select("symbol", "bar_s", "open", "high", "low", "close", "volume", F.round("macd", 6).alias("macd"), F.round("signal", 6).alias("signal"))


@query(f"""WITH {_TAKEN} SELECT symbol, reason, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT symbol, seq, why AS reason FROM v WHERE why IS NOT NULL UNION ALL SELECT symbol, seq, late FROM k WHERE late IS NOT NULL) GROUP BY 1, 2""")
def stream_refused(spark, sf_dir):
    """Ticks that the same stream refused, counted by reason."""
    out = session_stream(spark, sf_dir).where("kind != 'bar'")
    return out.groupBy("symbol", F.col("kind").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""WITH RECURSIVE t AS (SELECT symbol, ts_s, row_number() OVER (PARTITION BY symbol ORDER BY ts_s) AS n FROM (SELECT DISTINCT symbol, ts_s FROM {TICKS} WHERE size >= 45)),
    r AS (SELECT symbol, n, ts_s, ts_s AS fired FROM t WHERE n = 1 UNION ALL SELECT t.symbol, t.n, t.ts_s, CASE WHEN t.ts_s - r.fired >= 14400 THEN t.ts_s ELSE r.fired END FROM r JOIN t ON t.symbol = r.symbol AND t.n = r.n + 1) SELECT symbol, ts_s FROM r WHERE fired = ts_s""")
def stream_cooled(spark, sf_dir):
    """Alerts of a stream, let through four hours or more apart, over several deliveries."""
    t = T.ticks(spark, sf_dir).where("size >= 45").select("symbol", "ts_s")
    low, high = t.agg(F.min("ts_s"), F.max("ts_s")).first()
    t = t.withColumn("part", F.floor((F.col("ts_s") - F.lit(low or 0)) * DELIVERIES / F.lit((high or 0) + 1 - (low or 0))).cast("int"))
    at = folder(spark)
    with live.rocksdb(spark):
        return live.drained(live.cooled(live.delivered(t, "part", DELIVERIES, at), 14_400), at)
