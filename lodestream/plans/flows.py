"""Registered queries that join order flow with profiles: divergences of bars, biases of days, votes, tick sizes, scans of volatility."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from ..operators import bars as B, books, calendar, indicators as I, orderflow as OF, profiles as P, state, windows as R
from ..sources import tables as T
from .catalog import _FIFO, _SIDES, CHAIN, SQL, TICKS, hourly, query
from .desks import BY
from .markets import _HOURLY_FLOW, hourly_flow
from .profiles import _sessions, LEVEL, session_measures, sessions
from .series import _INDICATED
from .volatility import _NEAR, _SOLVED, near_iv, with_iv

#: Bars looked back over, rows and share of the span by which an extreme must be new.
LOOKBACK, EDGE_ROWS, FRACTION = 20, 2, 0.25
_BACK = f"PARTITION BY symbol ORDER BY bar_s ROWS BETWEEN {LOOKBACK - 1} PRECEDING"


@query(f"""WITH c AS (SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY bar_s)::BIGINT AS cvd FROM ({_HOURLY_FLOW})),
    x AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS top, min(low) OVER w AS bottom, max(cvd) OVER w AS most, min(cvd) OVER w AS least, max(high) OVER p AS before_high, min(low) OVER p AS before_low, -(max({{'h': high, 'b': -bar_s}}) OVER p).b AS high_at, (min({{'l': low, 'b': bar_s}}) OVER p).b AS low_at
        FROM c WINDOW w AS ({_BACK} AND CURRENT ROW), p AS ({_BACK} AND 1 PRECEDING)),
    e AS (SELECT *, greatest({EDGE_ROWS * LEVEL}, {FRACTION} * (top - bottom)) AS edge, {FRACTION} * (most - least) AS flow_edge FROM x WHERE n >= 3)
    SELECT * FROM (SELECT symbol, bar_s, CASE WHEN high > before_high + edge AND cvd < most - flow_edge THEN 'bearish' WHEN low < before_low - edge AND cvd > least + flow_edge THEN 'bullish' END AS kind,
        CASE WHEN high > before_high + edge AND cvd < most - flow_edge THEN high_at WHEN low < before_low - edge AND cvd > least + flow_edge THEN low_at END AS reference, cvd FROM e) WHERE kind IS NOT NULL""")
def bar_delta_divergence(spark, sf_dir):
    """Hours that make a new extreme of the last twenty, by rows and share of the span, while the cumulative delta stays behind; with the bar of the old extreme."""
    over = W.partitionBy("symbol").orderBy("bar_s")
    w, p = over.rowsBetween(-(LOOKBACK - 1), 0), over.rowsBetween(-(LOOKBACK - 1), -1)
    b = hourly_flow(spark, sf_dir).withColumn("cvd", F.sum("delta").over(over))
    b = b.withColumns({
        "n": F.count(F.lit(1)).over(w), "span": F.max("high").over(w) - F.min("low").over(w), "most": F.max("cvd").over(w), "least": F.min("cvd").over(w),
        "before_high": F.max(F.struct("high", (-F.col("bar_s")).alias("b"))).over(p), "before_low": F.min(F.struct("low", "bar_s")).over(p)}).where("n >= 3")
    edge, flow = F.greatest(F.lit(float(EDGE_ROWS * LEVEL)), FRACTION * F.col("span")), FRACTION * (F.col("most") - F.col("least"))
    bear = (F.col("high") > F.col("before_high.high") + edge) & (F.col("cvd") < F.col("most") - flow)
    bull = (F.col("low") < F.col("before_low.low") - edge) & (F.col("cvd") > F.col("least") + flow)
    return b.select("symbol", "bar_s", F.when(bear, "bearish").when(bull, "bullish").alias("kind"), F.when(bear, -F.col("before_high.b")).when(bull, F.col("before_low.bar_s")).alias("reference"), "cvd").where("kind is not null")


#: Sessions of a migration, share of a week's width beyond which a close is accepted, sessions that must be known.
RUN, ACCEPTED, KNOWN = 3, 0.10, 5
_DAY_FLOW = f"SELECT symbol, ts_s // 86400 AS k, sum(side * size)::BIGINT AS delta, sum(size)::BIGINT AS volume FROM ({_SIDES}) GROUP BY 1, 2"


@query(f"""WITH s AS ({_sessions('ts_s // 86400')}), w AS ({_sessions('(ts_s // 86400 + 3) // 7')}), f AS ({_DAY_FLOW}),
    d AS (SELECT s.*, f.delta / nullif(f.volume, 0) AS imbalance, (s.k + 3) // 7 AS week, row_number() OVER o AS n, CASE WHEN s.val > lag(s.val) OVER o AND s.vah > lag(s.vah) OVER o THEN 1 WHEN s.val < lag(s.val) OVER o AND s.vah < lag(s.vah) OVER o THEN -1 ELSE 0 END AS way FROM s JOIN f ON f.symbol = s.symbol AND f.k = s.k WINDOW o AS (PARTITION BY s.symbol ORDER BY s.k)),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, way ORDER BY n) AS island FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, way, island ORDER BY n) AS run FROM g),
    j AS (SELECT r.*, w.vah AS wvah, w.val AS wval, w.high AS whigh, w.low AS wlow, (w.vah - w.val) * {ACCEPTED} AS room FROM r LEFT JOIN w ON w.symbol = r.symbol AND w.k = r.week - 1 WHERE r.n > {KNOWN}),
    b AS (SELECT *, CASE WHEN way <> 0 AND run >= {RUN} AND way * imbalance > 0 THEN 'value_migration' WHEN close > wvah + room AND imbalance > 0 OR close < wval - room AND imbalance < 0 THEN 'weekly_breakout'
        WHEN close BETWEEN wval AND wvah AND (high > wvah + room AND imbalance < 0 OR low < wval - room AND imbalance > 0) THEN 'failed_breakout' END AS setup FROM j)
    SELECT symbol, k AS day, setup, CASE WHEN setup = 'value_migration' THEN CASE WHEN way > 0 THEN 'bullish' ELSE 'bearish' END WHEN setup IS NOT NULL THEN CASE WHEN imbalance > 0 THEN 'bullish' ELSE 'bearish' END END AS bias,
        round(CASE setup WHEN 'value_migration' THEN CASE WHEN way > 0 THEN val ELSE vah END WHEN 'weekly_breakout' THEN CASE WHEN imbalance > 0 THEN wvah ELSE wval END WHEN 'failed_breakout' THEN CASE WHEN imbalance > 0 THEN low ELSE high END END::DOUBLE, 6) AS stop, CASE WHEN way <> 0 THEN run ELSE 0 END AS run, round(imbalance, 6) AS imbalance FROM b""")
def positional_bias(spark, sf_dir):
    """A day's setup at its close: value that migrates with the flow, acceptance outside the last week's value, or a probe that failed."""
    o = W.partitionBy("symbol").orderBy("k")
    s = sessions(spark, sf_dir, T.DAY_S)
    flow = OF.flow(OF.classified(T.ticks(spark, sf_dir)), ["symbol", F.floor(F.col("ts_s") / T.DAY_S).alias("k")]).select("symbol", "k", (F.col("delta") / F.nullif(F.col("volume"), F.lit(0))).alias("imbalance"))
    up, down = (F.col("val") > F.lag("val").over(o)) & (F.col("vah") > F.lag("vah").over(o)), (F.col("val") < F.lag("val").over(o)) & (F.col("vah") < F.lag("vah").over(o))
    d = s.join(flow, ["symbol", "k"]).withColumns({"week": F.floor((F.col("k") + 3) / 7), "n": F.row_number().over(o), "way": F.when(up, 1).when(down, -1).otherwise(0)})
    d = d.withColumn("island", F.col("n") - F.row_number().over(W.partitionBy("symbol", "way").orderBy("n"))).withColumn("run", F.row_number().over(W.partitionBy("symbol", "way", "island").orderBy("n")))
    weeks = P.session_areas(T.ticks(spark, sf_dir).withColumn("k", F.floor((F.floor(F.col("ts_s") / T.DAY_S) + 3) / 7)), ["symbol", "k"], LEVEL)
    weeks = weeks.select("symbol", (F.col("k") + 1).alias("week"), F.col("vah").alias("wvah"), F.col("val").alias("wval"), ((F.col("vah") - F.col("val")) * ACCEPTED).alias("room"))
    j = d.where(F.col("n") > KNOWN).join(weeks, ["symbol", "week"], "left")
    setup = (F.when((F.col("way") != 0) & (F.col("run") >= RUN) & (F.col("way") * F.col("imbalance") > 0), "value_migration")
             .when(F.expr("close > wvah + room and imbalance > 0 or close < wval - room and imbalance < 0"), "weekly_breakout")
             .when(F.expr("close between wval and wvah and (high > wvah + room and imbalance < 0 or low < wval - room and imbalance > 0)"), "failed_breakout"))
    j = j.withColumn("setup", setup)
    rises = F.when(F.col("setup") == "value_migration", F.col("way") > 0).when(F.col("setup").isNotNull(), F.col("imbalance") > 0)
    pick = lambda a, b: F.when(rises, F.col(a)).otherwise(F.col(b))
    stop = F.when(F.col("setup") == "value_migration", pick("val", "vah")).when(F.col("setup") == "weekly_breakout", pick("wvah", "wval")).when(F.col("setup") == "failed_breakout", pick("low", "high"))
    return j.select("symbol", F.col("k").alias("day"), "setup", F.when(rises, "bullish").when(~rises, "bearish").alias("bias"), F.round(stop.cast("double"), 6).alias("stop"), F.when(F.col("way") != 0, F.col("run")).otherwise(0).cast("long").alias("run"), F.round("imbalance", 6).alias("imbalance"))


_OFI = f"SELECT b.symbol, t.ts_s // 3600 * 3600 AS bar_s, sum(ofi)::BIGINT AS ofi FROM ({SQL['order_flow_imbalance']}) b JOIN {TICKS} t ON t.symbol = b.symbol AND t.seq = b.seq GROUP BY 1, 2"


@query(f"""WITH d AS (SELECT symbol, ts_s // 3600 * 3600 AS bar_s, sum(side * size)::BIGINT AS delta, sum(CASE WHEN size >= 45 THEN side * size ELSE 0 END)::BIGINT AS large FROM ({_SIDES}) GROUP BY 1, 2)
    SELECT d.symbol, d.bar_s, delta, coalesce(ofi, 0) AS ofi, large, coalesce(nullif(sign(sign(delta) + sign(coalesce(ofi, 0)) + sign(large)), 0), sign(delta))::INTEGER AS vote FROM d LEFT JOIN ({_OFI}) o ON o.symbol = d.symbol AND o.bar_s = d.bar_s""")
def flow_votes(spark, sf_dir):
    """The hour's side by three votes, inferred delta, imbalance of the book and large prints; the delta breaks a tie."""
    t = T.ticks(spark, sf_dir)
    hour = F.expr("ts_s div 3600 * 3600").alias("bar_s")
    signed = F.col("side") * F.col("size")
    d = OF.classified(t).groupBy("symbol", hour).agg(F.sum(signed).alias("delta"), F.sum(F.when(F.col("size") >= 45, signed).otherwise(0)).alias("large"))
    mid = F.lag("price").over(W.partitionBy("symbol").orderBy("seq"))
    book = t.select("symbol", "seq", "ts_s", (mid - 0.05).alias("bid"), (mid + 0.05).alias("ask"), F.col("size").alias("bid_qty"), (99 - F.col("size")).alias("ask_qty"))
    ofi = OF.book_imbalance(book).where("ofi is not null").groupBy("symbol", hour).agg(F.sum("ofi").alias("ofi"))
    j = d.join(ofi, ["symbol", "bar_s"], "left").withColumn("ofi", F.coalesce("ofi", F.lit(0)))
    total = F.signum("delta") + F.signum("ofi") + F.signum("large")
    vote = F.when(total != 0, F.signum(total)).otherwise(F.signum("delta"))
    return j.select("symbol", "bar_s", "delta", "ofi", "large", vote.cast("int").alias("vote"))


#: Tick sizes in cents, and the fewest prices that one is measured from.
TICK_CENTS, FEWEST = (500, 100, 50, 25, 10, 5, 1), 6


def ticked(prints, by: list[str]):
    """(by, prices, divisor): the greatest divisor of all differences of a session's prices, in cents, in one pass."""

    def step(s, cents):
        least, divisor, n = s
        return ((cents, 0, 1) if n == 0 else (least, math.gcd(divisor, cents - least), n + 1)), []

    cents = prints.select(*by, B.cents(F.col("price")).alias("cents")).distinct()
    return state.scan(cents, by, ["cents"], ["cents"], lambda: (0, 0, 0), step, "prices long, divisor long", end=lambda s: [(s[2], s[1])])


_DIVISOR = f"SELECT symbol, day, count(*) AS prices, list_reduce(list_prepend(0, list(c - least ORDER BY c)), lambda a, x: gcd(a, x)) AS divisor FROM (SELECT *, min(c) OVER (PARTITION BY symbol, day) AS least FROM (SELECT DISTINCT symbol, ts_s // 86400 AS day, round(price * 100)::BIGINT AS c FROM {TICKS})) GROUP BY 1, 2"
_TICK = "CASE WHEN prices < 6 OR divisor = 0 THEN 0.05 " + " ".join(f"WHEN divisor % {c} = 0 THEN {c / 100}" for c in TICK_CENTS) + " END::DOUBLE"


@query(f"SELECT symbol, day, prices, {_TICK} AS tick, CASE WHEN prices < 6 OR divisor = 0 THEN 'default' ELSE 'observed' END AS source FROM ({_DIVISOR})")
def tick_sizes(spark, sf_dir):
    """The tick that a day's prices were quoted in, measured where there are enough of them."""
    d = ticked(T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S)), ["symbol", "day"])
    measured = (F.col("prices") >= FEWEST) & (F.col("divisor") > 0)
    tick = F.when(~measured, 0.05)
    for c in TICK_CENTS:
        tick = tick.when(F.col("divisor") % c == 0, c / 100)
    return d.select("symbol", "day", "prices", tick.cast("double").alias("tick"), F.when(measured, "observed").otherwise("default").alias("source"))


_CALLS = f"SELECT underlying, month, strike, premium, row_number() OVER (PARTITION BY underlying, month ORDER BY strike) AS n, row_number() OVER (PARTITION BY underlying, month ORDER BY abs(strike - spot), strike) AS near FROM {CHAIN} WHERE option_type = 'CE'"


@query(f"""WITH RECURSIVE c AS ({_CALLS}), p AS (SELECT a.underlying, a.month, i.premium / a.premium AS inner_ratio, o.premium / a.premium AS outer_ratio, row_number() OVER (PARTITION BY a.underlying ORDER BY a.month) AS k FROM c a JOIN c i ON i.underlying = a.underlying AND i.month = a.month AND i.n = a.n - 1 JOIN c o ON o.underlying = a.underlying AND o.month = a.month AND o.n = a.n + 1 WHERE a.near = 1),
    r AS (SELECT underlying, k, month, inner_ratio, outer_ratio, inner_ratio AS inner_mean, outer_ratio AS outer_mean FROM p WHERE k = 1 UNION ALL SELECT p.underlying, p.k, p.month, p.inner_ratio, p.outer_ratio, inner_mean + 2.0::DOUBLE / 6 * (p.inner_ratio - inner_mean), outer_mean + 2.0::DOUBLE / 6 * (p.outer_ratio - outer_mean) FROM r JOIN p ON p.underlying = r.underlying AND p.k = r.k + 1)
    SELECT underlying, month, {', '.join(f'round({c}, 6) AS {c}' for c in ('inner_ratio', 'outer_ratio', 'inner_mean', 'outer_mean'))} FROM r""")
def ratio_history(spark, sf_dir):
    """Premiums of the calls beside the money against the one at it, where all three are there, and their running means of five."""
    by = W.partitionBy(*BY)
    c = T.chain(spark, sf_dir).where("option_type = 'CE'").withColumns({"n": F.row_number().over(by.orderBy("strike")), "near": F.row_number().over(by.orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")), "lower": F.lag("premium").over(by.orderBy("strike")), "upper": F.lead("premium").over(by.orderBy("strike"))})
    p = c.where("near = 1 and lower is not null and upper is not null").select("underlying", "month", (F.col("lower") / F.col("premium")).alias("inner_ratio"), (F.col("upper") / F.col("premium")).alias("outer_ratio"))
    maps = {f"{s}_mean": I.mean_step(F.col(f"{s}_ratio"), 2 / 6) for s in ("inner", "outer")}
    out = I.recurrence(p, ["inner_ratio", "outer_ratio"], maps, "month", 1_000, ("underlying",))
    return out.select("underlying", "month", *[F.round(x, 6).alias(x) for x in ("inner_ratio", "outer_ratio", "inner_mean", "outer_mean")])


@query(f"""WITH n AS ({_NEAR}), s AS (SELECT underlying, month, avg(iv) FILTER (WHERE option_type = 'PE') - avg(iv) FILTER (WHERE option_type = 'CE') AS skew FROM ({_SOLVED}) WHERE iv IS NOT NULL AND abs(strike / spot - 1) <= 0.1 GROUP BY 1, 2),
    w AS (SELECT n.*, s.skew, min(iv) OVER p AS low, max(iv) OVER p AS high, count(*) OVER p AS before, lag(iv) OVER o AS one, lag(iv, 5) OVER o AS five, max(n.month) OVER (PARTITION BY n.underlying) AS newest FROM n LEFT JOIN s ON s.underlying = n.underlying AND s.month = n.month WINDOW p AS (PARTITION BY n.underlying ORDER BY n.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY n.underlying ORDER BY n.month)),
    l AS (SELECT w.*, (SELECT count(*) FROM n e WHERE e.underlying = w.underlying AND e.month < w.month AND e.iv < w.iv) / nullif(before, 0) AS below FROM w WHERE month = newest)
    SELECT underlying, month, round(iv, 6) AS iv, round((iv - low) / nullif(high - low, 0), 5) AS rank, round(below, 6) AS percentile, round(iv - one, 6) AS change, round(iv - five, 6) AS change_5, round(skew, 6) AS skew, before AS sessions FROM l""")
def volatility_scan(spark, sf_dir):
    """Each underlying's newest volatility against its earlier months only: rank, share below, changes and skew."""
    o = W.partitionBy("underlying").orderBy("month")
    p = o.rowsBetween(W.unboundedPreceding, -1)
    n = near_iv(spark, sf_dir)
    skew = with_iv(spark, sf_dir).where("iv is not null and abs(strike / spot - 1) <= 0.1").groupBy(*BY).agg((F.avg(F.when(F.col("option_type") == "PE", F.col("iv"))) - F.avg(F.when(F.col("option_type") == "CE", F.col("iv")))).alias("skew"))
    w = n.join(skew, BY, "left").withColumns({"low": F.min("iv").over(p), "high": F.max("iv").over(p), "before": F.count(F.lit(1)).over(p), "one": F.lag("iv").over(o), "five": F.lag("iv", 5).over(o), "last": F.row_number().over(W.partitionBy("underlying").orderBy(F.desc("month"))), "newest": F.max_by("iv", "month").over(W.partitionBy("underlying"))})
    below = w.where("last > 1").groupBy("underlying").agg(F.avg((F.col("iv") < F.col("newest")).cast("double")).alias("below"))
    return w.where("last = 1").join(below, "underlying", "left").select(
        *BY, F.round("iv", 6).alias("iv"), F.round((F.col("iv") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), 5).alias("rank"), F.round("below", 6).alias("percentile"),
        F.round(F.col("iv") - F.col("one"), 6).alias("change"), F.round(F.col("iv") - F.col("five"), 6).alias("change_5"), F.round("skew", 6).alias("skew"), F.col("before").alias("sessions"))


@query(f"""WITH RECURSIVE {_INDICATED}, v AS ({SQL['vwap_to_date']}), x AS (SELECT b.symbol, b.bar_s, b.n, b.close, b.close / lag(b.close) OVER w - 1 AS ret_1, b.close / lag(b.close, 3) OVER w - 1 AS ret_3, b.close / lag(b.close, 6) OVER w - 1 AS ret_6, max(b.high) OVER d AS top, min(b.low) OVER d AS bottom FROM b WINDOW w AS (PARTITION BY b.symbol ORDER BY b.n), d AS (PARTITION BY b.symbol, b.bar_s // 86400 ORDER BY b.n)),
    m AS (SELECT symbol, bar_s, ret_3 FROM x WHERE symbol = 'view'), s AS (SELECT *, stddev_samp(ret_1) OVER (PARTITION BY symbol ORDER BY n ROWS 4 PRECEDING) AS short, stddev_samp(ret_1) OVER (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING) AS long, count(ret_1) OVER (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING) AS k FROM x)
    SELECT s.symbol, s.bar_s, round(ret_1, 6) AS ret_1, round(s.ret_3, 6) AS ret_3, round(ret_6, 6) AS ret_6, round(s.close / v.vwap - 1, 6) AS vwap_off, round((s.close - bottom) / nullif(top - bottom, 0), 6) AS day_place, round(fast - slow - sig, 6) AS histogram, round(s.ret_3 - m.ret_3, 6) AS relative, CASE WHEN k = 20 THEN round(short / nullif(long, 0), 6) END AS volatility_ratio
    FROM s JOIN i ON i.symbol = s.symbol AND i.n = s.n JOIN v ON v.symbol = s.symbol AND v.bar_s = s.bar_s LEFT JOIN m ON m.bar_s = s.bar_s""")
def underlying_features(spark, sf_dir):
    """What a model is told of an underlying at each hour: returns, distance from VWAP, place in the day, histogram, strength against a benchmark, ratio of volatilities."""
    w, d = R.over(), W.partitionBy("symbol", F.expr("bar_s div 86400")).orderBy("bar_s")
    b = B.vwap_to_date(hourly(spark, sf_dir))
    back = lambda k: F.col("close") / F.lag("close", k).over(w) - 1
    b = b.withColumns({"ret_1": back(1), "ret_3": back(3), "ret_6": back(6), "top": F.max("high").over(d), "bottom": F.min("low").over(d)})
    long = w.rowsBetween(-19, 0)
    b = b.withColumn("ratio", F.when(F.count("ret_1").over(long) == 20, F.stddev_samp("ret_1").over(w.rowsBetween(-4, 0)) / F.nullif(F.stddev_samp("ret_1").over(long), F.lit(0.0))))
    m = I.macd(hourly(spark, sf_dir)).select("symbol", "bar_s", "histogram")
    bench = b.where("symbol = 'view'").select("bar_s", F.col("ret_3").alias("bench"))
    b = b.join(m, ["symbol", "bar_s"]).join(bench, "bar_s", "left")
    return b.select("symbol", "bar_s", *[F.round(x, 6).alias(x) for x in ("ret_1", "ret_3", "ret_6")], F.round(F.col("close") / F.col("vwap") - 1, 6).alias("vwap_off"), F.round((F.col("close") - F.col("bottom")) / F.nullif(F.col("top") - F.col("bottom"), F.lit(0.0)), 6).alias("day_place"),
                    F.round("histogram", 6).alias("histogram"), F.round(F.col("ret_3") - F.col("bench"), 6).alias("relative"), F.round("ratio", 6).alias("volatility_ratio"))


_RATED = f"""WITH m AS ({SQL['session_measures']}), l AS (SELECT symbol, day, unnest([{{'label': 'extension over 25', 'today': greatest(extension_up, extension_down) >= 0.25}}, {{'label': 'extension over 50', 'today': greatest(extension_up, extension_down) >= 0.5}}, {{'label': 'extension over 100', 'today': greatest(extension_up, extension_down) >= 1}},
    {{'label': 'range broken', 'today': break_side <> 'none'}}, {{'label': 'gapped', 'today': gap <> 0}}, {{'label': 'opened outside value', 'today': opened <> 'in'}}], recursive := true) FROM m)"""


@query(f"""{_RATED} SELECT symbol, day, label, today, hits, sample, round(100 * hits / nullif(sample, 0), 4) AS base_rate FROM (SELECT *, count(*) FILTER (WHERE today) OVER w AS hits, count(today) OVER w AS sample FROM l WINDOW w AS (PARTITION BY symbol, label ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE today IS NOT NULL""")
def session_against_rates(spark, sf_dir):
    """Each session's measures against how often the sessions before it had them; no session counts for itself."""
    m = session_measures(spark, sf_dir)
    reach = F.greatest("extension_up", "extension_down")
    labels = {"extension over 25": reach >= 0.25, "extension over 50": reach >= 0.5, "extension over 100": reach >= 1, "range broken": F.col("break_side") != "none", "gapped": F.col("gap") != 0, "opened outside value": F.col("opened") != "in"}
    rows = m.select("symbol", "day", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.alias("today")) for n, c in labels.items()])).alias("l")).select("symbol", "day", "l.*")
    w = W.partitionBy("symbol", "label").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"hits": F.count(F.when(F.col("today"), 1)).over(w), "sample": F.count("today").over(w)}).where("today is not null")
    return rows.withColumn("base_rate", F.round(100 * F.col("hits") / F.nullif(F.col("sample"), F.lit(0)), 4))


#: Seconds of a morning at which rows of a closed trade go, and days of the year without a session.
GONE_AT, CLOSED_DAYS = 8 * 3600, ("01-01", "12-25")
_CALENDAR = f"SELECT day, (day + 3) % 7 < 5 AND strftime(DATE '1970-01-01' + day::INTEGER, '%m-%d') NOT IN {CLOSED_DAYS} AS open FROM (SELECT unnest(range((SELECT min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) FROM lineitem), (SELECT max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) FROM lineitem) + 15)) AS day)"


@query(f"""WITH c AS (SELECT day, min(CASE WHEN open THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following, open FROM ({_CALENDAR})),
    e AS (SELECT date_diff('day', DATE '1970-01-01', day) AS day, count(*) AS exits, round(sum(quantity), 4) AS quantity FROM ({_FIFO}) GROUP BY 1)
    SELECT e.day, exits, quantity, c.following * 86400 + {GONE_AT} AS visible_until_s, c.following - e.day AS mornings, (SELECT sum(o.exits) FROM e o JOIN c d ON d.day = o.day WHERE o.day <= e.day AND d.following > e.day)::BIGINT AS visible FROM e JOIN c ON c.day = e.day""")
def closed_rows(spark, sf_dir):
    """Exits of each day, until when a desk shows them (eight on the next trading morning, over weekends and holidays), and how many it shows that evening."""
    s = books.fifo(T.fills(spark, sf_dir)).groupBy(F.unix_date("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("exits"), F.round(F.sum("quantity"), 4).alias("quantity"))
    low, high = T.table(spark, sf_dir, "lineitem").agg(F.min(F.unix_date(F.to_date("l_shipdate"))), F.max(F.unix_date(F.to_date("l_shipdate")))).first()
    c = spark.range(low or 0, (high or 0) + 15).withColumnRenamed("id", "day")
    shut = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "MM-dd").isin(*CLOSED_DAYS)
    ahead = W.orderBy("day").rowsBetween(1, W.unboundedFollowing)  # a row a day of the calendar
    c = c.withColumn("following", F.min(F.when((calendar.weekday(F.col("day")) < 5) & ~shut, F.col("day"))).over(ahead))
    e = s.join(c, "day")
    # A day's rows are shown on each day until the next trading one.
    shown = e.select(F.explode(F.sequence(F.col("day"), F.col("following") - 1)).alias("day"), F.col("exits").alias("shown")).groupBy("day").agg(F.sum("shown").alias("visible"))
    return e.join(shown, "day").select("day", "exits", "quantity", (F.col("following") * 86_400 + GONE_AT).alias("visible_until_s"), (F.col("following") - F.col("day")).alias("mornings"), "visible")
