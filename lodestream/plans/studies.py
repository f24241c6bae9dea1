"""Registered queries of studies: averages by weight, payoffs, margins, funnels, coverage, positions, barriers."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import bars as B, books, options as O, orderflow as OF, windows as R
from ..sources import tables as T
from .catalog import _BOOK, _FIFO, _PAIRS, _SIDES, BARS, CHAIN, LADDER, OVER, hourly, query, steady


@query(f"SELECT symbol, bar_s, round(CASE WHEN n >= 5 THEN (5 * c0 + 4 * c1 + 3 * c2 + 2 * c3 + c4) / 15 END, 6) AS wma FROM (SELECT symbol, bar_s, row_number() {OVER}) AS n, close AS c0, " + ", ".join(f"lag(close, {i}) {OVER}) AS c{i}" for i in range(1, 5)) + f" FROM {BARS})")
def weighted_average(spark, sf_dir):
    w = R.over()
    total = sum((5 - i) * (F.lag("close", i).over(w) if i else F.col("close")) for i in range(5))
    return hourly(spark, sf_dir).select("symbol", "bar_s", F.round(total / 15, 6).alias("wma"))


@query(f"SELECT symbol, max(n) FILTER (WHERE up) AS longest_rise, max(n) FILTER (WHERE NOT up) AS longest_fall FROM (SELECT symbol, up, count(*) AS n FROM (SELECT symbol, up, row_number() {OVER}) - row_number() OVER (PARTITION BY symbol, up ORDER BY bar_s) AS island FROM (SELECT symbol, bar_s, close > open AS up FROM {BARS})) GROUP BY symbol, up, island) GROUP BY 1")
def longest_runs(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("up", F.col("close") > F.col("open"))
    b = b.withColumn("island", F.row_number().over(R.over()) - F.row_number().over(W.partitionBy("symbol", "up").orderBy("bar_s")))
    runs = b.groupBy("symbol", "up", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("symbol").agg(F.max(F.when(F.col("up"), F.col("n"))).alias("longest_rise"), F.max(F.when(~F.col("up"), F.col("n"))).alias("longest_fall"))


@query(f"SELECT symbol, bar_s, high < lag(high) {OVER}) AND low > lag(low) {OVER}) AS inside_bar, close > lag(open) {OVER}) AND open < lag(close) {OVER}) AND lag(close) {OVER}) < lag(open) {OVER}) AS bullish_engulfing, close > max(high) {OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS breakout FROM {BARS}")
def candle_patterns(spark, sf_dir):
    w = R.over()
    p = lambda c: F.lag(c).over(w)
    return hourly(spark, sf_dir).select(
        "symbol", "bar_s", ((F.col("high") < p("high")) & (F.col("low") > p("low"))).alias("inside_bar"),
        ((F.col("close") > p("open")) & (F.col("open") < p("close")) & (p("close") < p("open"))).alias("bullish_engulfing"),
        (F.col("close") > F.max("high").over(w.rowsBetween(-5, -1))).alias("breakout"))


@query(f"SELECT symbol, bar_s // 86400 AS day, max(high) FILTER (WHERE bar_s % 86400 < 43200) AS before_high, max(high) FILTER (WHERE bar_s % 86400 >= 43200) AS after_high, arg_max(close, bar_s) FILTER (WHERE bar_s % 86400 < 43200) AS at_cut, sum(volume) FILTER (WHERE bar_s % 86400 < 43200)::BIGINT AS before_volume FROM {BARS} GROUP BY 1, 2")
def day_at_cut_off(spark, sf_dir):
    early = F.col("bar_s") % T.DAY_S < 43_200
    return hourly(spark, sf_dir).groupBy("symbol", F.floor(F.col("bar_s") / T.DAY_S).alias("day")).agg(
        F.max(F.when(early, F.col("high"))).alias("before_high"), F.max(F.when(~early, F.col("high"))).alias("after_high"),
        F.max_by("close", F.when(early, F.col("bar_s"))).alias("at_cut"), F.sum(F.when(early, F.col("volume"))).alias("before_volume"))


@query(f"SELECT symbol, count(*) AS scanned, count(*) FILTER (WHERE volume >= 100) AS liquid, count(*) FILTER (WHERE volume >= 100 AND close > open) AS rising, count(*) FILTER (WHERE volume >= 100 AND close > open AND close = high) AS strong FROM {BARS} GROUP BY 1")
def stage_funnel(spark, sf_dir):
    liquid = F.col("volume") >= 100
    rising = liquid & (F.col("close") > F.col("open"))
    return hourly(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(liquid).alias("liquid"), F.count_if(rising).alias("rising"), F.count_if(rising & (F.col("close") == F.col("high"))).alias("strong"))


@query("SELECT 'events' AS name, count(*) AS n, count(DISTINCT event_type) AS entities FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_partkey) FROM lineitem")
def coverage(spark, sf_dir):
    out = None
    for name, entity in (("events", "event_type"), ("orders", "o_custkey"), ("lineitem", "l_partkey")):
        one = T.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("entities")).select(F.lit(name).alias("name"), "n", "entities")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT symbol, bar_s, CASE WHEN target_s IS NOT NULL AND (stop_s IS NULL OR target_s < stop_s) THEN 'target' WHEN stop_s IS NOT NULL THEN 'stop' ELSE 'time' END AS outcome FROM (SELECT b.symbol, b.bar_s, min(CASE WHEN h.high >= b.close * 1.5 THEN h.bar_s END) AS target_s, min(CASE WHEN h.low <= b.close * 0.5 THEN h.bar_s END) AS stop_s FROM {BARS} b JOIN {BARS} h ON h.symbol = b.symbol AND h.bar_s BETWEEN b.bar_s + 3600 AND b.bar_s + 21600 GROUP BY 1, 2)")
def barrier_outcomes(spark, sf_dir):
    """The first of target and stop within six hours; the stop wins a tie."""
    w = R.over().rangeBetween(3_600, 21_600)
    ahead = F.collect_list(F.struct("bar_s", "high", "low")).over(w)
    first = lambda hit: F.array_min(F.transform(F.filter("ahead", hit), lambda h: h["bar_s"]))
    b = hourly(spark, sf_dir).withColumn("ahead", ahead).where(F.size("ahead") > 0)
    b = b.withColumns({"target_s": first(lambda h: h["high"] >= F.col("close") * 1.5), "stop_s": first(lambda h: h["low"] <= F.col("close") * 0.5)})
    won = F.col("target_s").isNotNull() & (F.col("stop_s").isNull() | (F.col("target_s") < F.col("stop_s")))
    return b.select("symbol", "bar_s", F.when(won, "target").when(F.col("stop_s").isNotNull(), "stop").otherwise("time").alias("outcome"))


@query(f"SELECT symbol, bar_s // 86400 AS day, round(max(close - least_before), 6) AS best_round_trip FROM (SELECT symbol, bar_s, close, min(close) OVER (PARTITION BY symbol, bar_s // 86400 ORDER BY bar_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_before FROM {BARS}) GROUP BY 1, 2")
def perfect_foresight(spark, sf_dir):
    day = F.floor(F.col("bar_s") / T.DAY_S)
    least = F.min("close").over(W.partitionBy("symbol", day).orderBy("bar_s").rowsBetween(W.unboundedPreceding, -1))
    b = hourly(spark, sf_dir).withColumns({"day": day, "least": least})
    return b.groupBy("symbol", "day").agg(F.round(F.max(F.col("close") - F.col("least")), 6).alias("best_round_trip"))


@query(f"SELECT underlying, month, spot_at, round(sum(oi * greatest(0, CASE WHEN option_type = 'CE' THEN spot_at - strike ELSE strike - spot_at END)), 4) AS payout FROM {CHAIN} CROSS JOIN (SELECT unnest([900.0, 925.0, 950.0, 975.0, 1000.0])::DOUBLE AS spot_at) GROUP BY 1, 2, 3")
def payoff_grid(spark, sf_dir):
    """What holders are paid at each of a few spots; the least of them is where writers lose least."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in (900, 925, 950, 975, 1000)]))
    c = T.chain(spark, sf_dir).withColumn("spot_at", grid)
    paid = F.greatest(F.lit(0.0), F.when(O.is_call(), F.col("spot_at") - F.col("strike")).otherwise(F.col("strike") - F.col("spot_at")))
    return c.groupBy("underlying", "month", "spot_at").agg(F.round(F.sum(F.col("oi") * paid), 4).alias("payout"))


@query(f"SELECT underlying, month, option_type, strike, CASE WHEN before IS NOT NULL THEN oi - before END AS oi_change FROM (SELECT *, CASE WHEN lag(month) OVER w = month - 1 THEN lag(oi) OVER w END AS before FROM {CHAIN} WINDOW w AS (PARTITION BY underlying, option_type, strike ORDER BY month))")
def interest_change(spark, sf_dir):
    """Change of open interest against the month before, only where there was one."""
    w = W.partitionBy("underlying", "option_type", "strike").orderBy("month")
    before = F.when(F.lag("month").over(w) == F.col("month") - 1, F.lag("oi").over(w))
    return T.chain(spark, sf_dir).select("underlying", "month", "option_type", "strike", (F.col("oi") - before).alias("oi_change"))


@query(f"SELECT underlying, month, strike, CASE WHEN strike < spot * 0.98 THEN 'low' WHEN strike > spot * 1.02 THEN 'high' ELSE 'near' END AS moneyness, round(greatest(0, call - greatest(0, spot - strike)), 9) AS extrinsic FROM ({_PAIRS}) WHERE call IS NOT NULL AND put IS NOT NULL")
def moneyness(spark, sf_dir):
    p = O.paired(T.chain(spark, sf_dir), ["underlying", "month"])
    kind = F.when(F.col("strike") < F.col("spot") * 0.98, "low").when(F.col("strike") > F.col("spot") * 1.02, "high").otherwise("near")
    return p.select("underlying", "month", "strike", kind.alias("moneyness"), F.round(F.greatest(F.lit(0.0), F.col("call") - F.greatest(F.lit(0.0), F.col("spot") - F.col("strike"))), 9).alias("extrinsic"))


@query(f"SELECT symbol, seq, CASE WHEN n >= 20 THEN round(total / nullif(depth, 0), 6) END AS normalised FROM (SELECT symbol, seq, count(ofi) OVER w AS n, sum(ofi) OVER w AS total, avg(bid_qty + ask_qty) OVER w AS depth FROM (SELECT *, (CASE WHEN bid > pb THEN bid_qty WHEN bid = pb THEN bid_qty - pbq ELSE -pbq END) - (CASE WHEN ask < pa THEN ask_qty WHEN ask = pa THEN ask_qty - paq ELSE -paq END) AS ofi FROM (SELECT *, lag(bid) OVER v AS pb, lag(ask) OVER v AS pa, lag(bid_qty) OVER v AS pbq, lag(ask_qty) OVER v AS paq FROM ({_BOOK}) WHERE bid > 0 AND ask > bid WINDOW v AS (PARTITION BY symbol ORDER BY seq))) WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 29 PRECEDING))")
def depth_normalised_imbalance(spark, sf_dir):
    mid = F.lag("price").over(W.partitionBy("symbol").orderBy("seq"))
    b = T.ticks(spark, sf_dir).select("symbol", "seq", (mid - 0.05).alias("bid"), (mid + 0.05).alias("ask"), F.col("size").alias("bid_qty"), (99 - F.col("size")).alias("ask_qty"))
    b = OF.book_imbalance(b)
    w = W.partitionBy("symbol").orderBy("seq").rowsBetween(-29, 0)
    return b.select("symbol", "seq", F.when(F.count("ofi").over(w) >= 20, F.round(F.sum("ofi").over(w) / F.nullif(F.avg(F.col("bid_qty") + F.col("ask_qty")).over(w), F.lit(0.0)), 6)).alias("normalised"))


@query(f"SELECT symbol, level, buy, sell, CASE WHEN level = low THEN 'low' ELSE 'high' END AS edge, CASE WHEN buy > 0 AND sell > 0 THEN 'unfinished' ELSE 'finished' END AS verdict FROM (SELECT *, min(level) OVER (PARTITION BY symbol) AS low, max(level) OVER (PARTITION BY symbol) AS high FROM {LADDER}) WHERE level = low OR level = high")
def unfinished_auction(spark, sf_dir):
    by = W.partitionBy("symbol")
    p = T.ladder(spark, sf_dir).withColumns({"low": F.min("level").over(by), "high": F.max("level").over(by)}).where("level = low or level = high")
    return p.select("symbol", "level", "buy", "sell", F.when(F.col("level") == F.col("low"), "low").otherwise("high").alias("edge"), F.when((F.col("buy") > 0) & (F.col("sell") > 0), "unfinished").otherwise("finished").alias("verdict"))


@query(f"SELECT symbol, ts_s // 86400 AS day, round(sum(side * size) / nullif(sum(size), 0), 6) AS initiative, CASE WHEN sum(side * size) >= 0.05 * sum(size) THEN 'buyers' WHEN sum(side * size) <= -0.05 * sum(size) THEN 'sellers' ELSE 'balanced' END AS label FROM ({_SIDES}) GROUP BY 1, 2")
def initiative(spark, sf_dir):
    t = OF.flow(OF.classified(T.ticks(spark, sf_dir)), ["symbol", F.floor(F.col("ts_s") / T.DAY_S).alias("day")])
    label = F.when(F.col("delta") >= 0.05 * F.col("volume"), "buyers").when(F.col("delta") <= -0.05 * F.col("volume"), "sellers").otherwise("balanced")
    return t.select("symbol", "day", F.round(F.col("delta") / F.nullif(F.col("volume"), F.lit(0)), 6).alias("initiative"), label.alias("label"))


@query(f"SELECT date_trunc('week', day)::DATE AS week, round(sum(quantity * (sold_at - bought_at)), 7) AS net, count(*) AS exits FROM ({_FIFO}) GROUP BY 1")
def weekly_scoreboard(spark, sf_dir):
    s = books.fifo(T.fills(spark, sf_dir))
    return s.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.round(F.sum("pnl"), 7).alias("net"), F.count(F.lit(1)).alias("exits"))


@query(f"WITH d AS (SELECT symbol, bar_s, close, row_number() {OVER}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {BARS}), k AS (SELECT symbol, n, unnest(range(0, 50)) AS j FROM (SELECT DISTINCT symbol, n FROM d)) SELECT d.symbol, d.bar_s, d.close FROM d JOIN (SELECT DISTINCT symbol, CASE WHEN j = 49 THEN n - 1 ELSE j * n // 50 END AS i FROM k) t ON t.symbol = d.symbol AND t.i = d.i")
def thinned_curve(spark, sf_dir):
    """At most 50 points of each series: element floor(j n / 50), and the last."""
    d = hourly(spark, sf_dir).withColumns({"i": F.row_number().over(R.over()) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("symbol"))})
    j = F.floor((F.col("i") * 50 + F.col("n") - 1) / F.col("n"))
    kept = ((j < 49) & (F.floor(j * F.col("n") / 50) == F.col("i"))) | (F.col("i") == F.col("n") - 1)
    return d.where(kept).select("symbol", "bar_s", "close")


_FEES = "q * price * 0.0005 + q * price * 0.0005 * 0.18 + CASE WHEN side = 'SELL' THEN q * price * 0.001 ELSE 0 END"
_FILLED = f"SELECT symbol, l_orderkey, l_linenumber, n, price, q, CASE WHEN side = 'BUY' THEN q ELSE -q END AS x, {_FEES} AS fees FROM (SELECT l_partkey AS symbol, l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS side, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem)"


@query(f"""WITH RECURSIVE b AS ({_FILLED}), r AS (
    SELECT symbol, n, l_orderkey, l_linenumber, x AS held, price AS average, -fees AS realised, fees AS entry, price AS low, price AS high, price AS seen_low, price AS seen_high, CAST(NULL AS DOUBLE) AS closed, CAST(NULL AS DOUBLE) AS gross, CAST(NULL AS DOUBLE) AS borne FROM b WHERE n = 1
    UNION ALL SELECT symbol, n, l_orderkey, l_linenumber, held + x, CASE WHEN adds THEN (average * abs(held) + price * q) / abs(held + x) WHEN held + x = 0 THEN 0 WHEN turns THEN price ELSE average END,
        realised + coalesce(g, 0) - fees, CASE WHEN adds THEN entry + fees WHEN held + x = 0 THEN 0 WHEN turns THEN fees - fees * c / q ELSE entry - entry * c / abs(held) END,
        CASE WHEN held + x = 0 THEN NULL WHEN turns THEN price ELSE least(low, price) END, CASE WHEN held + x = 0 THEN NULL WHEN turns THEN price ELSE greatest(high, price) END, least(low, price), greatest(high, price), c, g, entry * c / abs(held) + fees * c / q
    FROM (SELECT b.symbol, b.n, b.l_orderkey, b.l_linenumber, r.held, r.average, r.realised, r.entry, r.low, r.high, b.price, b.q, b.x, b.fees, r.held * b.x >= 0 AS adds, (r.held + b.x) * r.held < 0 AS turns,
            CASE WHEN r.held * b.x < 0 THEN least(abs(r.held), b.q) END AS c, CASE WHEN r.held * b.x < 0 THEN (b.price - r.average) * least(abs(r.held), b.q) * sign(r.held) END AS g
        FROM r JOIN b ON b.symbol = r.symbol AND b.n = r.n + 1))
    SELECT symbol, l_orderkey, l_linenumber, held, CASE WHEN held <> 0 THEN round(average + 1e-9, 6) END AS average, round(realised + 1e-9, 3) AS realised, closed, round(gross + 1e-9, 4) AS gross, round(borne + 1e-9, 5) AS fees, round(seen_low + 1e-9, 6) AS low, round(seen_high + 1e-9, 6) AS high FROM r""")
def position_book(spark, sf_dir):
    """Average price, size, result after fees, closed slices and excursion of each symbol after each fill."""
    f = books.with_charges(T.fills(spark, sf_dir)).withColumnRenamed("charges", "fees").select("symbol", "seq.*", "side", "quantity", "price", "fees")
    out = books.position_book(f, ["s", "l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("symbol", "l_orderkey", "l_linenumber", "held", "closed", *[steady(c, d).alias(c) for c, d in (("average", 6), ("realised", 3), ("gross", 4), ("fees", 5), ("low", 6), ("high", 6))])


@query(f"SELECT symbol, bar_s FROM (SELECT symbol, bar_s, volume, avg(volume) OVER (PARTITION BY symbol, bar_s % 86400 ORDER BY bar_s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS usual FROM {BARS}) WHERE volume >= 2 * usual")
def volume_spikes(spark, sf_dir):
    b = hourly(spark, sf_dir)
    usual = F.avg("volume").over(W.partitionBy("symbol", F.col("bar_s") % T.DAY_S).orderBy("bar_s").rowsBetween(-10, -1))
    return b.withColumn("usual", usual).where(F.col("volume") >= 2 * F.col("usual")).select("symbol", "bar_s")


@query(f"SELECT symbol, day, session, n FROM (SELECT symbol, bar_s // 86400 AS day, ntile(5) OVER (PARTITION BY symbol ORDER BY bar_s // 86400) AS session, count(*) AS n FROM {BARS} GROUP BY 1, 2)")
def chronological_split(spark, sf_dir):
    d = hourly(spark, sf_dir).groupBy("symbol", F.floor(F.col("bar_s") / T.DAY_S).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("symbol", "day", F.ntile(5).over(W.partitionBy("symbol").orderBy("day")).cast("long").alias("session"), "n")


@query(f"SELECT label, round(sum(gain / ln(1 + place) * ln(2)) / sum(gain / ln(1 + ideal) * ln(2)), 6) AS ndcg FROM (SELECT label, gain, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place, row_number() OVER (PARTITION BY label ORDER BY gain DESC, vec_id) AS ideal FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS score, (vec_id % 3)::DOUBLE AS gain FROM embeddings)) GROUP BY 1")
def ranking_gain(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("score"), (F.col("vec_id") % 3).cast("double").alias("gain"))
    by = W.partitionBy("label")
    e = e.withColumns({"place": F.row_number().over(by.orderBy(F.desc("score"), "vec_id")), "ideal": F.row_number().over(by.orderBy(F.desc("gain"), "vec_id"))})
    sum_at = lambda c: F.sum(F.col("gain") / F.log(1 + F.col(c)) * F.log(F.lit(2.0)))
    return e.groupBy("label").agg(F.round(sum_at("place") / sum_at("ideal"), 6).alias("ndcg"))


@query(f"SELECT symbol, bar_s // 86400 * 86400 AS bar_s, round(100 * (arg_max(close, bar_s) / arg_min(open, bar_s) - 1), 6) AS day_change, min(bar_s) % 86400 > 3600 AS partial FROM {BARS} GROUP BY symbol, bar_s // 86400")
def period_change(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return b.groupBy("symbol", B.bucket(F.col("bar_s"), T.DAY_S).alias("day_s")).agg(
        F.round(100 * (F.max_by("close", "bar_s") / F.min_by("open", "bar_s") - 1), 6).alias("day_change"), (F.min("bar_s") % T.DAY_S > 3600).alias("partial")).withColumnRenamed("day_s", "bar_s")
