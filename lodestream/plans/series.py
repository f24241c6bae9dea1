"""Registered queries of state machines over sorted bars: trend units, lines through swings, balance, Supertrend's start."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I, trends, windows as R
from .catalog import _TR, hourly, query, steady

_N = "row_number() OVER (PARTITION BY symbol ORDER BY bar_s)"
#: Bars with Wilder's ATR of 14 and of 10 and the MACD histogram, bar by bar.
_BASE = f"b AS (SELECT symbol, bar_s, open, high, low, close, tr, {_N} AS n FROM ({_TR}))"


def _wilder(n: int) -> str:
    return f"t{n} + b.tr AS t{n}, CASE WHEN b.n < {n} THEN NULL WHEN b.n = {n} THEN (t{n} + b.tr) / {n} ELSE (atr{n} * {n - 1} + b.tr) / {n} END AS atr{n}"


_INDICATED = f"""{_BASE}, i AS (SELECT symbol, n, bar_s, high, low, close, tr AS t14, CAST(NULL AS DOUBLE) AS atr14, tr AS t10, CAST(NULL AS DOUBLE) AS atr10, close AS fast, close AS slow, 0.0::DOUBLE AS sig FROM b WHERE n = 1
    UNION ALL SELECT b.symbol, b.n, b.bar_s, b.high, b.low, b.close, {_wilder(14)}, {_wilder(10)}, fast + 2.0::DOUBLE / 13 * (b.close - fast), slow + 2.0::DOUBLE / 27 * (b.close - slow),
        sig + 2.0::DOUBLE / 10 * ((fast + 2.0::DOUBLE / 13 * (b.close - fast)) - (slow + 2.0::DOUBLE / 27 * (b.close - slow)) - sig)
    FROM i JOIN b ON b.symbol = i.symbol AND b.n = i.n + 1)"""


def indicated(spark, sf_dir):
    """Hourly bars with true range, ATR of 14 and the MACD histogram."""
    b = hourly(spark, sf_dir).withColumn("tr", R.true_range())
    atr = I.wilder(b, 14, "tr", "atr").select("symbol", "bar_s", "atr")
    return b.join(atr, ["symbol", "bar_s"]).join(I.macd(b).select("symbol", "bar_s", F.col("histogram").alias("hist")), ["symbol", "bar_s"])


@query(f"""WITH RECURSIVE {_INDICATED}, p AS (SELECT symbol, bar_s, high, low, close, atr14 AS atr, fast - slow - sig AS hist, {_N} AS m FROM i WHERE atr14 > 0),
    u AS (SELECT symbol, 0::BIGINT AS m, 0::BIGINT AS bar_s, 0 AS d, 0 AS units, CAST(NULL AS VARCHAR) AS next, CAST(NULL AS DOUBLE) AS ext, 0::BIGINT AS since, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS lo, 0.0::DOUBLE AS peak, false AS pulled, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS fade, CAST(NULL AS DOUBLE) AS pullback FROM p WHERE m = 1
    UNION ALL SELECT symbol, m, bar_s, CASE WHEN turned <> 0 THEN turned ELSE d END, units, CASE WHEN turned <> 0 THEN 'FLIP' WHEN d = 0 THEN NULL WHEN m - since > 10 AND fade < 0.5 AND units > 1 THEN 'REDUCE' WHEN adds THEN 'ADD' END,
        CASE WHEN turned > 0 THEN high WHEN turned < 0 THEN low ELSE ext END, CASE WHEN turned <> 0 THEN m ELSE since END, hi, lo, CASE WHEN turned <> 0 THEN 0 ELSE peak END,
        CASE WHEN turned <> 0 THEN false WHEN d = 0 THEN pulled ELSE pulls AND NOT (adds AND NOT (m - since > 10 AND fade < 0.5 AND units > 1)) END, close, CASE WHEN turned = 0 AND d <> 0 THEN fade END, CASE WHEN turned = 0 AND d <> 0 THEN pullback END
    FROM (SELECT *, pulls AND pullback < 0.25 AND d * (close - last) > 0 AND m - since BETWEEN 3 AND 10 AND fade >= 0.75 AND units > 0 AND units < 3 AS adds
    FROM (SELECT *, CASE WHEN peak > 0 THEN d * hist / atr / peak ELSE 0 END AS fade, pulled OR pullback BETWEEN 0.25 AND 1.0 AS pulls
    FROM (SELECT *, CASE WHEN d <> 0 THEN greatest(before_peak, d * hist / atr) ELSE before_peak END AS peak, d * (ext - close) / atr AS pullback,
            CASE WHEN d = 0 THEN CASE WHEN close >= lo + 2 * atr THEN 1 WHEN close <= hi - 2 * atr THEN -1 ELSE 0 END WHEN d > 0 THEN CASE WHEN close <= ext - 2 * atr THEN -1 ELSE 0 END ELSE CASE WHEN close >= ext + 2 * atr THEN 1 ELSE 0 END END AS turned
    FROM (SELECT p.*, u.d, u.since, u.pulled, u.last, u.peak AS before_peak, CASE u.next WHEN 'FLIP' THEN 1 WHEN 'ADD' THEN least(3, u.units + 1) WHEN 'REDUCE' THEN least(1, u.units) ELSE u.units END AS units,
            CASE WHEN u.d = 0 THEN greatest(u.hi, p.high) ELSE u.hi END AS hi, CASE WHEN u.d = 0 THEN least(u.lo, p.low) ELSE u.lo END AS lo, CASE WHEN u.d > 0 THEN greatest(u.ext, p.high) WHEN u.d < 0 THEN least(u.ext, p.low) END AS ext
        FROM u JOIN p ON p.symbol = u.symbol AND p.m = u.m + 1)))))
    SELECT symbol, bar_s, d AS direction, units, next AS action, CASE WHEN d <> 0 THEN m - since END::INTEGER AS age, round(fade, 6) AS fade, round(pullback, 6) AS pullback FROM u WHERE m > 0""")
def trend_units(spark, sf_dir):
    """Direction and units of the trend after each hour, and what each close decides."""
    return trends.trend_units(indicated(spark, sf_dir)).withColumns({"fade": F.round("fade", 6), "pullback": F.round("pullback", 6)})


_SWINGS = f"""SELECT symbol, bar_s, open, high, low, close, lag(close) OVER v AS before, {_N} - 1 AS n, CASE WHEN count(*) OVER w = 7 AND lag(high, 3) OVER v = max(high) OVER w THEN lag(high, 3) OVER v END AS top, CASE WHEN count(*) OVER w = 7 AND lag(low, 3) OVER v = min(low) OVER w THEN lag(low, 3) OVER v END AS bottom,
    CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY bar_s ROWS 13 PRECEDING) = 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY bar_s ROWS 13 PRECEDING) END AS atr FROM ({_TR}) WINDOW v AS (PARTITION BY symbol ORDER BY bar_s), w AS (PARTITION BY symbol ORDER BY bar_s ROWS 6 PRECEDING)"""
_NULLS = ", ".join(f"CAST(NULL AS {'BIGINT' if c.endswith('i') else 'DOUBLE'}) AS {c}" for c in ("ai", "ap", "bi", "bp", "ci", "cp", "di", "dp"))


@query(f"""WITH RECURSIVE b AS ({_SWINGS}), k AS (SELECT *, 1 AS side, high AS edge, top AS swing FROM b UNION ALL SELECT *, -1, low, bottom FROM b),
    r AS (SELECT symbol, side, n, bar_s, {_NULLS}, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS DOUBLE) AS line FROM k WHERE n = 0
    UNION ALL SELECT symbol, side, n, bar_s, ai, ap, bi, bp, CASE WHEN ends THEN NULL ELSE ci END, CASE WHEN ends THEN NULL ELSE cp END, CASE WHEN ends THEN NULL ELSE di END, CASE WHEN ends THEN NULL ELSE dp END,
        CASE WHEN NOT live THEN NULL WHEN breaks THEN CASE WHEN side > 0 THEN 'breakout' ELSE 'breakdown' END WHEN ends THEN NULL WHEN side * (close - now) < 0 AND side * (edge - now) >= -0.25 * atr AND side * (close - open) < 0 THEN CASE WHEN side > 0 THEN 'bounce_down' ELSE 'bounce_up' END END, now
    FROM (SELECT *, live AND side * (close - now) > 0 AS ends, live AND side * (close - now) > 0.1 * atr AND side * (before - was) <= 0 AS breaks
    FROM (SELECT *, n > 6 AND coalesce(atr > 0, false) AND ci IS NOT NULL AS live, dp + (dp - cp) / (di - ci) * (n - di) AS now, dp + (dp - cp) / (di - ci) * (n - 1 - di) AS was
    FROM (SELECT symbol, side, n, bar_s, open, close, before, edge, atr, ai, ap, bi, bp, CASE WHEN forms THEN ai ELSE ci END AS ci, CASE WHEN forms THEN ap ELSE cp END AS cp, CASE WHEN forms THEN bi ELSE di END AS di, CASE WHEN forms THEN bp ELSE dp END AS dp
    FROM (SELECT *, coalesce(side * (ap - bp) > 0 AND (di IS NULL OR di <> bi), false) AS forms
    FROM (SELECT k.symbol, k.side, k.n, k.bar_s, k.open, k.close, k.before, k.edge, k.atr, r.ci, r.cp, r.di, r.dp, CASE WHEN k.n > 6 AND k.swing IS NOT NULL THEN r.bi ELSE r.ai END AS ai, CASE WHEN k.n > 6 AND k.swing IS NOT NULL THEN r.bp ELSE r.ap END AS ap,
            CASE WHEN k.n > 6 AND k.swing IS NOT NULL THEN k.n - 3 ELSE r.bi END AS bi, CASE WHEN k.n > 6 AND k.swing IS NOT NULL THEN k.swing ELSE r.bp END AS bp
        FROM r JOIN k ON k.symbol = r.symbol AND k.side = r.side AND k.n = r.n + 1))))))
    SELECT symbol, bar_s, event, CASE WHEN event LIKE 'b_unce%' THEN -side ELSE side END AS side, round(line, 6) AS line FROM r WHERE event IS NOT NULL""")
def trendline_events(spark, sf_dir):
    """Breaks of and bounces off the lines through the last two falling highs and rising lows."""
    b = hourly(spark, sf_dir).withColumn("tr", R.true_range())
    w = R.over().rowsBetween(-13, 0)
    b = b.withColumn("atr", F.when(F.count(F.lit(1)).over(w) == 14, F.avg("tr").over(w)))
    return trends.trendlines(b).withColumn("line", F.round("line", 6))


@query(f"""WITH RECURSIVE b AS (SELECT symbol, bar_s // 86400 AS day, bar_s, low, high, row_number() OVER w AS n, 2.5 * median(CASE WHEN high > low THEN high - low END) OVER (PARTITION BY symbol, bar_s // 86400) AS most FROM ({_TR}) WINDOW w AS (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s)),
    e AS (SELECT symbol, day, n AS i, n AS j, bar_s AS first, bar_s AS last, low, high FROM b WHERE most IS NOT NULL
    UNION ALL SELECT e.symbol, e.day, e.i, b.n, e.first, b.bar_s, least(e.low, b.low), greatest(e.high, b.high) FROM e JOIN b ON b.symbol = e.symbol AND b.day = e.day AND b.n = e.j + 1
        WHERE (b.high <= b.low OR greatest(0, least(e.high, b.high) - greatest(e.low, b.low)) / (b.high - b.low) >= 0.6) AND greatest(e.high, b.high) - least(e.low, b.low) <= b.most),
    f AS (SELECT symbol, day, i, max(j) AS j, arg_max(first, j) AS first, arg_max(last, j) AS last, arg_max(low, j) AS low, arg_max(high, j) AS high FROM e GROUP BY 1, 2, 3),
    c AS (SELECT * FROM f WHERE i = 1 UNION ALL SELECT f.* FROM c JOIN f ON f.symbol = c.symbol AND f.day = c.day AND f.i = CASE WHEN c.j - c.i >= 2 THEN c.j + 1 ELSE c.i + 1 END)
    SELECT symbol, day, first, last, low, high, (j - i + 1)::INTEGER AS bars FROM c WHERE j - i >= 2""")
def balance_clusters(spark, sf_dir):
    """Stretches of a day's hours that rotate within a narrow range."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    return trends.balance_clusters(b, ["symbol", "day"])


_BANDS = """SELECT symbol, bar_s, high, low, close, atr10 AS atr, (high + low) / 2 + 3 * atr10 AS u, (high + low) / 2 - 3 * atr10 AS l, row_number() OVER (PARTITION BY symbol ORDER BY bar_s) AS m FROM i WHERE atr10 IS NOT NULL"""


def _supertrend(first: str) -> str:
    return f"""WITH RECURSIVE {_INDICATED}, p AS ({_BANDS}), s AS (SELECT symbol, m, bar_s, u AS ub, l AS lb, {first} AS dir, close AS last FROM p WHERE m = 1
    UNION ALL SELECT symbol, m, bar_s, ub, lb, CASE WHEN dir < 0 AND close > ub THEN 1 WHEN dir > 0 AND close < lb THEN -1 ELSE dir END, close
    FROM (SELECT p.symbol, p.m, p.bar_s, p.close, s.dir, CASE WHEN p.u < s.ub OR s.last > s.ub THEN p.u ELSE s.ub END AS ub, CASE WHEN p.l > s.lb OR s.last < s.lb THEN p.l ELSE s.lb END AS lb FROM s JOIN p ON p.symbol = s.symbol AND p.m = s.m + 1))
    SELECT symbol, bar_s, dir, round(ub + 1e-9, 6) AS ub, round(lb + 1e-9, 6) AS lb FROM s"""


def banded(spark, sf_dir, first):
    b = hourly(spark, sf_dir).withColumn("tr", R.true_range())
    atr = I.wilder(b, 10, "tr", "atr").select("symbol", "bar_s", "atr")
    return I.supertrend(b.join(atr, ["symbol", "bar_s"]), first=first).select("symbol", "bar_s", "dir", steady("ub", 6).alias("ub"), steady("lb", 6).alias("lb"))


@query(_supertrend("1"))
def supertrend(spark, sf_dir):
    """Ratcheting bands and direction, rising at first."""
    return banded(spark, sf_dir, 1)


@query(_supertrend("CASE WHEN close < (high + low) / 2 THEN -1 ELSE 1 END"))
def supertrend_by_middle(spark, sf_dir):
    """The variant whose first direction is the side of the middle on which the first close lies."""
    return banded(spark, sf_dir, None)
