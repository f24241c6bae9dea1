"""Registered queries of profiles: value areas of sessions, periods and brackets, and sessions against those before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orderflow as OF, profiles as P
from ..sources import tables as T
from .catalog import BARS, LADDER, TICKS, hourly, query

LEVEL = 5
DAY = "ts_s // 86400"


def _area(source: str, by: str, tie: str = ">=", columns: str = "{by}, poc, val, vah, total") -> str:
    """Value areas of ``source`` (by, level, volume), a neighbour at a time."""
    names = [c.strip() for c in by.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in names)
    return f"""WITH RECURSIVE m AS (SELECT *, (min(level) OVER p + max(level) OVER p) / 2.0 AS mid, sum(volume) OVER p AS total, count(*) OVER p AS size FROM ({source}) WINDOW p AS (PARTITION BY {by})),
    l AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY level) AS i, row_number() OVER (PARTITION BY {by} ORDER BY volume DESC, abs(level - mid), level DESC) AS best FROM m),
    g AS (SELECT {by}, level AS poc, i AS lo, i AS hi, volume AS held, total, size FROM l WHERE best = 1
        UNION ALL SELECT {by}, poc, CASE WHEN up {tie} down THEN lo ELSE lo - 1 END, CASE WHEN up {tie} down THEN hi + 1 ELSE hi END, held + CASE WHEN up {tie} down THEN up ELSE down END, total, size
        FROM (SELECT g.*, coalesce(u.volume, -1) AS up, coalesce(d.volume, -1) AS down FROM g LEFT JOIN l u ON {on('u', 'g')} AND u.i = g.hi + 1 LEFT JOIN l d ON {on('d', 'g')} AND d.i = g.lo - 1 WHERE g.held < g.total * 0.7 AND (g.lo > 1 OR g.hi < g.size))),
    f AS (SELECT {by}, any_value(poc) AS poc, min(lo) AS lo, max(hi) AS hi, any_value(total) AS total FROM g GROUP BY {by}),
    a AS (SELECT f.*, x.level AS val, y.level AS vah FROM f JOIN l x ON {on('x', 'f')} AND x.i = f.lo JOIN l y ON {on('y', 'f')} AND y.i = f.hi)
    SELECT {columns.format(by=by)} FROM a"""


@query(_area(f"SELECT symbol, level, buy + sell + unclassified AS volume FROM {LADDER}", "symbol"))
def value_area(spark, sf_dir):
    """Point of control and the area of 70 % of the volume, upward on a tie."""
    return OF.value_area(OF.with_volume(T.ladder(spark, sf_dir)), ["symbol"])


_BINS = f"""SELECT symbol, day, CASE WHEN high > low THEN least(29, floor((t - low) / (high - low) * 30)) ELSE 0 END::BIGINT AS level, sum(volume)::DOUBLE AS volume FROM (SELECT symbol, bar_s // 86400 AS day, t, volume, min(t) OVER w AS low, max(t) OVER w AS high
    FROM (SELECT *, (high + low + close) / 3 AS t FROM {BARS}) WINDOW w AS (PARTITION BY symbol, bar_s // 86400)) GROUP BY 1, 2, 3"""


@query(_area(_BINS, "symbol, day", ">"))
def value_area_of_bars(spark, sf_dir):
    """The variant over 30 bins of the bars' typical prices, downward on a tie."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    return OF.value_area(P.typical_bins(b, ["symbol", "day"]), ["symbol", "day"], upward=False)


_TOUCHED = f"SELECT DISTINCT symbol, {DAY} AS day, ts_s % 86400 // 1800 AS bracket, CAST(floor(price / {LEVEL}) AS BIGINT) AS level FROM {TICKS}"
_SO_FAR = f"WITH t AS ({_TOUCHED}) SELECT b.symbol, b.day, b.bracket, t.level, count(*)::BIGINT AS volume FROM (SELECT DISTINCT symbol, day, bracket FROM t) b JOIN t ON t.symbol = b.symbol AND t.day = b.day AND t.bracket <= b.bracket GROUP BY ALL"


def touched(spark, sf_dir):
    """symbol, day, bracket of half an hour, level: what each bracket touched."""
    t = T.ticks(spark, sf_dir)
    return t.select("symbol", F.floor(F.col("ts_s") / T.DAY_S).alias("day"), F.floor(F.col("ts_s") % T.DAY_S / 1800).alias("bracket"), F.floor(F.col("price") / LEVEL).alias("level")).distinct()


@query(_area(_SO_FAR, "symbol, day, bracket", columns="{by}, poc, val, vah, total::BIGINT AS touches"))
def developing_value_area(spark, sf_dir):
    """The value area of a day as it stood when each half hour closed."""
    return P.developing(touched(spark, sf_dir), ["symbol", "day"])


_VOLUME = f"SELECT symbol, {{k}} AS k, CAST(floor(price / {LEVEL}) AS BIGINT) AS level, sum(size)::DOUBLE AS volume FROM {TICKS} GROUP BY 1, 2, 3 HAVING sum(size) > 0"


def _sessions(k: str) -> str:
    return f"""SELECT a.symbol, a.k, poc * {LEVEL} AS poc, val * {LEVEL} AS val, (vah + 1) * {LEVEL} AS vah, open, close, high, low FROM ({_area(_VOLUME.format(k=k), 'symbol, k')}) a
    JOIN (SELECT symbol, {k} AS k, arg_min(price, seq) AS open, arg_max(price, seq) AS close, max(price) AS high, min(price) AS low FROM {TICKS} GROUP BY 1, 2) p ON p.symbol = a.symbol AND p.k = a.k"""


def sessions(spark, sf_dir, seconds: int):
    t = T.ticks(spark, sf_dir).withColumn("k", F.floor(F.col("ts_s") / seconds))
    return P.session_areas(t, ["symbol", "k"], LEVEL)


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k) AS n FROM ({_sessions('ts_s // 3600')})),
    o AS (SELECT b.symbol, b.k AS hour, a.k AS since, a.poc::DOUBLE AS level, row_number() OVER (PARTITION BY b.symbol, b.k ORDER BY a.k DESC) AS place FROM s b JOIN s a ON a.symbol = b.symbol AND a.n < b.n AND a.n > b.n - 40
        WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.symbol = a.symbol AND c.n > a.n AND c.n <= b.n AND c.low <= a.poc AND c.high >= a.poc))
    SELECT symbol, hour, since, level FROM o WHERE place <= 12""")
def naked_levels(spark, sf_dir):
    """After each hour, points of control of the 40 before that no hour since has covered, the twelve newest."""
    return P.naked(sessions(spark, sf_dir, 3_600).withColumnRenamed("k", "hour"), "hour")


@query(f"""WITH s AS ({_sessions(DAY)}), p AS (SELECT symbol, lead(k) OVER (PARTITION BY symbol ORDER BY k) AS day, val, vah FROM s)
    SELECT b.symbol, b.bar_s, CASE WHEN b.close > p.vah THEN 'above' WHEN b.close < p.val THEN 'below' WHEN p.vah IS NOT NULL THEN 'in' END AS place FROM {BARS} b LEFT JOIN p ON p.symbol = b.symbol AND p.day = b.bar_s // 86400""")
def place_against_value(spark, sf_dir):
    """Where a bar closed against the value area of the session before."""
    areas = P.against_before(sessions(spark, sf_dir, T.DAY_S), "k").select("symbol", F.col("k").alias("day"), "last_val", "last_vah")
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400")).join(areas, ["symbol", "day"], "left")
    return b.select("symbol", "bar_s", P.place(F.col("close"), F.col("last_val"), F.col("last_vah")).alias("place"))


_PERIODS = f"""SELECT symbol, p[1] AS period, p[2]::BIGINT AS start, level, sum(size)::DOUBLE AS volume FROM (SELECT symbol, size, CAST(floor(price / {LEVEL}) AS BIGINT) AS level,
    unnest([('week', ({DAY} + 3) // 7 * 7 - 3), ('month', epoch(date_trunc('month', make_timestamp(ts_s * 1000000))) // 86400), ('five days', {DAY} // 5 * 5)]) AS p FROM {TICKS}) GROUP BY ALL"""


@query(_area(f"SELECT * FROM ({_PERIODS}) WHERE volume > 0", "symbol, period, start"))
def period_profiles(spark, sf_dir):
    """Value areas of weeks, months and runs of five days, from their days' ladders merged."""
    day = F.floor(F.col("ts_s") / T.DAY_S)
    month = F.unix_date(F.trunc(F.date_from_unix_date(day.cast("int")), "month")).cast("long")
    t = T.ticks(spark, sf_dir).groupBy("symbol", day.alias("day"), month.alias("month"), F.floor(F.col("price") / LEVEL).alias("level")).agg(F.sum("size").alias("size"))
    starts = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), c.cast("long").alias("start")) for n, c in (("week", F.expr("floor((day + 3) / 7) * 7 - 3")), ("month", F.col("month")), ("five days", F.expr("floor(day / 5) * 5")))]))
    t = t.select("symbol", "level", "size", starts.alias("p")).groupBy("symbol", "p.period", "p.start", "level").agg(F.sum("size").cast("double").alias("volume"))
    return OF.value_area(t.where("volume > 0"), ["symbol", "period", "start"])


STEPS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
_STEP = "CASE " + " ".join(f"WHEN spread <= {s} * 30 THEN {s}" for s in STEPS) + f" ELSE {STEPS[-1]} END"
_GRID = f"""SELECT symbol, day, CAST(floor(price / step) AS BIGINT) AS level, sum(size)::BIGINT AS volume, count(DISTINCT bracket) AS tpo, any_value(step) AS step FROM (SELECT t.symbol, {DAY} AS day, ts_s % 86400 // 1800 AS bracket, price, size, s.step FROM {TICKS} t
    JOIN (SELECT symbol, ({_STEP})::DOUBLE AS step FROM (SELECT symbol, median(high - low) AS spread FROM (SELECT symbol, {DAY} AS day, max(price) AS high, min(price) AS low FROM {TICKS} GROUP BY 1, 2) GROUP BY 1)) s ON s.symbol = t.symbol) GROUP BY 1, 2, 3"""


def gridded(spark, sf_dir):
    """Ticks with their day, bracket and the level of one grid for all days of a symbol."""
    t = T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S))
    spread = t.groupBy("symbol", "day").agg((F.max("price") - F.min("price")).alias("spread")).groupBy("symbol").agg(F.median("spread").alias("spread"))
    steps = spread.select("symbol", P.row_size(F.col("spread"), STEPS).alias("step"))
    return t.join(steps, "symbol").withColumns({"level": F.floor(F.col("price") / F.col("step")), "bracket": F.floor(F.col("ts_s") % T.DAY_S / 1800)})


@query(_GRID)
def profile_series(spark, sf_dir):
    """Each day's volume and brackets by row, on rows wide enough that a usual day has at most 30."""
    return gridded(spark, sf_dir).groupBy("symbol", "day", "level").agg(F.sum("size").alias("volume"), F.count_distinct("bracket").alias("tpo"), F.first("step").alias("step"))


@query(_area(f"SELECT symbol, level, sum(volume)::DOUBLE AS volume FROM ({_GRID}) GROUP BY 1, 2 HAVING sum(volume) > 0", "symbol"))
def composite_profile(spark, sf_dir):
    """The value area of all days on one grid."""
    g = profile_series(spark, sf_dir).groupBy("symbol", "level").agg(F.sum("volume").cast("double").alias("volume"))
    return OF.value_area(g.where("volume > 0"), ["symbol"])


_BALANCE = f"SELECT symbol, {DAY} AS k, max(CASE WHEN ts_s % 86400 < 3600 * 4 THEN price END) AS ib_high, min(CASE WHEN ts_s % 86400 < 3600 * 4 THEN price END) AS ib_low FROM {TICKS} GROUP BY 1, 2"


@query(f"""WITH s AS ({_sessions(DAY)}), i AS ({_BALANCE}),
    p AS (SELECT *, lag(poc) OVER w AS last_poc, lag(val) OVER w AS last_val, lag(vah) OVER w AS last_vah, lag(close) OVER w AS last_close, lag(high) OVER w AS last_high, lag(low) OVER w AS last_low FROM s WINDOW w AS (PARTITION BY symbol ORDER BY k)),
    b AS (SELECT t.symbol, {DAY} AS k, min(CASE WHEN price > ib_high THEN ts_s % 86400 // 1800 END) AS up_at, min(CASE WHEN price < ib_low THEN ts_s % 86400 // 1800 END) AS down_at, min(CASE WHEN ts_s % 86400 >= 14400 THEN price END) AS rest_low, max(CASE WHEN ts_s % 86400 >= 14400 THEN price END) AS rest_high
        FROM {TICKS} t JOIN i ON i.symbol = t.symbol AND i.k = t.ts_s // 86400 GROUP BY 1, 2),
    r AS (SELECT t.symbol, {DAY} AS k, count(DISTINCT CASE WHEN price BETWEEN last_val AND last_vah THEN ts_s % 86400 // 1800 END) AS inside, bool_or(price BETWEEN last_low AND last_high) AS touched FROM {TICKS} t JOIN p ON p.symbol = t.symbol AND p.k = t.ts_s // 86400 GROUP BY 1, 2)
    SELECT p.symbol, p.k AS day, CASE WHEN up_at IS NULL AND down_at IS NULL THEN 'none' WHEN down_at IS NULL THEN 'up' WHEN up_at IS NULL THEN 'down' ELSE 'both' END AS break_side, least(up_at, down_at) AS first_break,
        round(greatest(high - ib_high, 0) / nullif(ib_high - ib_low, 0), 6) AS extension_up, round(greatest(ib_low - low, 0) / nullif(ib_high - ib_low, 0), 6) AS extension_down,
        CASE WHEN open > last_vah THEN 'above' WHEN open < last_val THEN 'below' WHEN last_vah IS NOT NULL THEN 'in' END AS opened, (open > last_vah OR open < last_val) AND inside >= 2 AS eighty_percent,
        CASE WHEN open > last_high THEN round(open - last_high, 6) WHEN open < last_low THEN round(open - last_low, 6) ELSE 0 END AS gap, CASE WHEN open > last_high OR open < last_low THEN touched END AS filled
    FROM p JOIN i ON i.symbol = p.symbol AND i.k = p.k JOIN b ON b.symbol = p.symbol AND b.k = p.k JOIN r ON r.symbol = p.symbol AND r.k = p.k WHERE p.last_poc IS NOT NULL""")
def session_measures(spark, sf_dir):
    """Breaks of the first four hours' range, the opening against the value area before, gaps and whether they were filled."""
    s = P.against_before(sessions(spark, sf_dir, T.DAY_S), "k").where("last_poc is not null")
    t = T.ticks(spark, sf_dir).withColumns({"k": F.floor(F.col("ts_s") / T.DAY_S), "bracket": F.floor(F.col("ts_s") % T.DAY_S / 1800)})
    early = F.col("ts_s") % T.DAY_S < 14_400
    balance = t.groupBy("symbol", "k").agg(F.max(F.when(early, F.col("price"))).alias("ib_high"), F.min(F.when(early, F.col("price"))).alias("ib_low"))
    known = s.join(balance, ["symbol", "k"])
    inside = F.col("price").between(F.col("last_val"), F.col("last_vah"))
    m = t.join(known.select("symbol", "k", "ib_high", "ib_low", "last_val", "last_vah", "last_low", "last_high"), ["symbol", "k"]).groupBy("symbol", "k").agg(
        F.min(F.when(F.col("price") > F.col("ib_high"), F.col("bracket"))).alias("up_at"), F.min(F.when(F.col("price") < F.col("ib_low"), F.col("bracket"))).alias("down_at"),
        F.count_distinct(F.when(inside, F.col("bracket"))).alias("inside"), F.bool_or(F.col("price").between(F.col("last_low"), F.col("last_high"))).alias("touched"))
    m = m.join(known, ["symbol", "k"])
    side = F.when(F.expr("up_at is null and down_at is null"), "none").when(F.col("down_at").isNull(), "up").when(F.col("up_at").isNull(), "down").otherwise("both")
    width = F.nullif(F.col("ib_high") - F.col("ib_low"), F.lit(0.0))
    over, under = F.col("open") > F.col("last_high"), F.col("open") < F.col("last_low")
    return m.select(
        "symbol", F.col("k").alias("day"), side.alias("break_side"), F.least("up_at", "down_at").alias("first_break"),
        F.round(F.greatest(F.col("high") - F.col("ib_high"), F.lit(0.0)) / width, 6).alias("extension_up"), F.round(F.greatest(F.col("ib_low") - F.col("low"), F.lit(0.0)) / width, 6).alias("extension_down"),
        P.place(F.col("open"), F.col("last_val"), F.col("last_vah")).alias("opened"), (F.expr("open > last_vah or open < last_val") & (F.col("inside") >= 2)).alias("eighty_percent"),
        F.when(over, F.round(F.col("open") - F.col("last_high"), 6)).when(under, F.round(F.col("open") - F.col("last_low"), 6)).otherwise(0.0).alias("gap"), F.when(over | under, F.col("touched")).alias("filled"))


#: Fixed value: the letters of brackets, a star beyond them.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@query(f"SELECT symbol, day, level, string_agg(CASE WHEN bracket < 52 THEN substr('{LETTERS}', bracket + 1, 1) ELSE '*' END, '' ORDER BY bracket) AS letters FROM ({_TOUCHED}) GROUP BY 1, 2, 3")
def letter_codes(spark, sf_dir):
    """Each level of a day's profile as the letters of the half hours that touched it."""
    letter = lambda b: F.when(b < len(LETTERS), F.substring(F.lit(LETTERS), (b + 1).cast("int"), F.lit(1))).otherwise("*")
    t = touched(spark, sf_dir).groupBy("symbol", "day", "level").agg(F.sort_array(F.collect_list("bracket")).alias("brackets"))  # 48 at most
    return t.select("symbol", "day", "level", F.array_join(F.transform("brackets", letter), "").alias("letters"))
