"""Further registered queries: parsing, calendars, joins, studies, books and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window as W, functions as F

from ..operators import bars as B, books, joins as J, orderflow as OF, windows as R
from ..sources import tables as T
from ..streaming import live
from .catalog import BARS, CHAIN, CLOSES, LADDER, OVER, TICKS, _FIFO, _SIDES, hourly, query


def folder(spark) -> str:
    """The folder that driver and executors share; one of our own only where Spark runs in this one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or "file://" + tempfile.mkdtemp(prefix="lodestream-")).rstrip("/")


# Parsing, predicates, scalars (B, M).

@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS root, upper(substr(p_brand, 1, 5)) AS prefix, CASE WHEN p_name LIKE '%e' THEN 'index' WHEN regexp_matches(p_brand, '#1') THEN 'option' ELSE 'cash' END AS segment FROM part")
def symbol_segments(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_name").like("%e"), "index").when(F.col("p_brand").rlike("#1"), "option").otherwise("cash")
    return p.select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("root"), F.upper(F.substring("p_brand", 1, 5)).alias("prefix"), kind.alias("segment"))


@query(f"SELECT symbol, seq FROM {TICKS} WHERE (ts_s // 86400 + 3) % 7 < 5 AND ts_s % 86400 >= 33300 AND ts_s % 86400 < 55800")
def in_session(spark, sf_dir):
    day, at = F.floor(F.col("ts_s") / T.DAY_S), F.col("ts_s") % T.DAY_S
    return T.ticks(spark, sf_dir).where(((day + 3) % 7 < 5) & (at >= T.OPEN_S) & (at < 55_800)).select("symbol", "seq")


@query(f"WITH d AS (SELECT DISTINCT ts_s // 86400 AS day FROM {TICKS}) SELECT day, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day FROM d")
def trading_calendar(spark, sf_dir):
    # A row a day.
    d = T.ticks(spark, sf_dir).select(F.floor(F.col("ts_s") / T.DAY_S).alias("day")).distinct()
    w = W.orderBy("day")
    return d.select("day", F.lag("day").over(w).alias("prev_day"), F.lead("day").over(w).alias("next_day"))


@query(f"SELECT symbol, ts_s // 60 AS minute, arg_max(price, seq) AS price FROM {TICKS} GROUP BY 1, 2")
def last_snapshot_per_minute(spark, sf_dir):
    return T.ticks(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_s") / 60).alias("minute")).agg(F.max_by("price", "seq").alias("price"))


@query(f"WITH c AS (SELECT underlying, month, count(*) AS n FROM {CHAIN} GROUP BY 1, 2) SELECT underlying, month, n FROM (SELECT *, median(n) OVER (PARTITION BY underlying) AS typical FROM c) WHERE n >= 0.6 * typical")
def whole_snapshots(spark, sf_dir):
    c = T.chain(spark, sf_dir).groupBy("underlying", "month").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("typical", F.percentile("n", F.lit(0.5)).over(W.partitionBy("underlying"))).where("n >= 0.6 * typical").drop("typical")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(props) AS fingerprint, CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS bin FROM events")
def json_payload(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return T.table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.sha2("props", 256).alias("fingerprint"), F.floor(k / 25).alias("bin"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_shipdate DESC, l_partkey, l_suppkey) = 1")
def source_priority(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    w = W.partitionBy("l_orderkey", "l_linenumber").orderBy(rank, F.desc("l_shipdate"), "l_partkey", "l_suppkey")
    return T.table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


# Joins and sets (C, L).

@query("SELECT c_mktsegment, n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def sector_enrichment(spark, sf_dir):
    c, n, r = (T.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")  # 25 and 5 rows
    return j.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query(f"WITH g AS (SELECT s.symbol, m.month, c.close FROM (SELECT DISTINCT symbol FROM {CLOSES}) s CROSS JOIN (SELECT DISTINCT month FROM {CLOSES}) m LEFT JOIN {CLOSES} c ON c.symbol = s.symbol AND c.month = m.month) SELECT symbol, month, round(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY month ROWS 5 PRECEDING), 4) AS close FROM g")
def carried_back(spark, sf_dir):
    return J.carried_back(T.closes(spark, sf_dir), "symbol", "month", "close", 5).select("symbol", "month", F.round("close", 4).alias("close"))


@query(f"SELECT bar_s FROM {BARS} WHERE symbol = 'click' INTERSECT SELECT bar_s FROM {BARS} WHERE symbol = 'view' EXCEPT SELECT bar_s FROM {BARS} WHERE symbol = 'error'")
def common_times(spark, sf_dir):
    of = lambda s: hourly(spark, sf_dir).where(F.col("symbol") == s).select("bar_s")
    return of("click").intersect(of("view")).subtract(of("error"))


@query(f"SELECT coalesce(s.symbol, l.symbol) AS symbol, coalesce(s.bar_s, l.bar_s) AS bar_s, coalesce(l.close, s.close) AS close FROM (SELECT symbol, bar_s, close FROM {BARS} WHERE symbol < 'p') s FULL JOIN (SELECT symbol, bar_s, open AS close FROM {BARS} WHERE symbol > 'd') l ON s.symbol = l.symbol AND s.bar_s = l.bar_s")
def live_overlay(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return J.overlay(b.where("symbol < 'p'").select("symbol", "bar_s", "close"), b.where("symbol > 'd'").select("symbol", "bar_s", F.col("open").alias("close")), ["symbol", "bar_s"])


@query(f"SELECT symbol, bar_s, field, reading FROM (SELECT symbol, bar_s, open, close FROM {BARS}) UNPIVOT (reading FOR field IN (open, close))")
def unpivoted(spark, sf_dir):
    return hourly(spark, sf_dir).unpivot(["symbol", "bar_s"], ["open", "close"], "field", "reading")


@query(f"SELECT symbol, bar_s, volume FROM {BARS} ORDER BY volume DESC NULLS LAST, symbol, bar_s LIMIT 25 OFFSET 50")
def third_page(spark, sf_dir):
    """Paging is the feature: rows 51 to 75 by volume."""
    return hourly(spark, sf_dir).orderBy(F.desc_nulls_last("volume"), "symbol", "bar_s").offset(50).limit(25).select("symbol", "bar_s", "volume")


# Studies (E, G, H, J).

@query(f"WITH r AS (SELECT symbol, bar_s, close / lag(close) {OVER}) - 1 AS x, lead(close) {OVER}) / close - 1 AS y FROM {BARS}), k AS (SELECT bar_s // 86400 AS day, rank() OVER (PARTITION BY bar_s // 86400 ORDER BY x) + (count(*) OVER (PARTITION BY bar_s // 86400, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY bar_s // 86400 ORDER BY y) + (count(*) OVER (PARTITION BY bar_s // 86400, y) - 1) / 2.0 AS ry FROM r WHERE x IS NOT NULL AND y IS NOT NULL) SELECT day, count(*) AS n, round(corr(rx, ry), 6) AS ic FROM k GROUP BY 1 HAVING count(*) >= 50")
def information_coefficient(spark, sf_dir):
    b = hourly(spark, sf_dir).select("bar_s", (F.col("close") / F.lag("close").over(R.over()) - 1).alias("x"), (F.lead("close").over(R.over()) / F.col("close") - 1).alias("y"))
    b = b.where("x is not null and y is not null").withColumn("day", F.floor(F.col("bar_s") / T.DAY_S))
    b = b.withColumns({"rx": R.average_rank("x", ["day"]), "ry": R.average_rank("y", ["day"])})
    return b.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("ic")).where("n >= 50")


@query(f"WITH t AS (SELECT symbol, seq, ts_s, size FROM {TICKS}), m AS (SELECT symbol, seq, size, list(size) OVER (PARTITION BY symbol ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS held FROM t) SELECT symbol, seq, size FROM (SELECT symbol, seq, size, list_sort(held) AS h FROM m WHERE len(held) >= 30) WHERE size >= 1.8 * h[len(h) // 2 + 1]")
def large_prints(spark, sf_dir):
    return OF.large_prints(T.ticks(spark, sf_dir), multiple=1.8).select("symbol", "seq", "size")


@query(f"SELECT symbol, round(sum(confidence * pow(0.5, (m - ts_s) / 86400.0)), 5) AS aggression, side FROM (SELECT *, max(ts_s) OVER (PARTITION BY symbol) AS m FROM ({_SIDES})) GROUP BY symbol, side")
def decayed_aggression(spark, sf_dir):
    t = OF.classified(T.ticks(spark, sf_dir)).withColumn("m", F.max("ts_s").over(W.partitionBy("symbol")))
    return t.groupBy("symbol", "side").agg(F.round(F.sum(F.col("confidence") * F.pow(F.lit(0.5), (F.col("m") - F.col("ts_s")) / 86_400)), 5).alias("aggression"))


@query(f"SELECT symbol, volume_ratio, n, round(100.0 * n / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM (SELECT symbol, CASE WHEN volume < 100 THEN 'thin' WHEN volume < 300 THEN 'usual' ELSE 'busy' END AS volume_ratio, count(*) AS n FROM {BARS} GROUP BY 1, 2)")
def binned_shares(spark, sf_dir):
    kind = F.when(F.col("volume") < 100, "thin").when(F.col("volume") < 300, "usual").otherwise("busy")
    b = hourly(spark, sf_dir).groupBy("symbol", kind.alias("volume_ratio")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("symbol")), 6))


@query(f"SELECT symbol, median(volume) AS median, round(quantile_cont(volume, 0.25), 6) AS p25, round(quantile_cont(volume, 0.75), 6) AS p75, round(avg(volume), 6) AS mean, round(stddev_samp(volume), 6) AS sd, count(*) AS n FROM {BARS} GROUP BY 1")
def baselines(spark, sf_dir):
    q = lambda p: F.percentile("volume", F.lit(p))
    return hourly(spark, sf_dir).groupBy("symbol").agg(q(0.5).alias("median"), F.round(q(0.25), 6).alias("p25"), F.round(q(0.75), 6).alias("p75"), F.round(F.avg("volume"), 6).alias("mean"), F.round(F.stddev_samp("volume"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


@query(f"WITH d AS (SELECT symbol, bar_s // 86400 AS day, max(high) AS high, min(low) AS low FROM {BARS} GROUP BY 1, 2), p AS (SELECT *, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS pl FROM d) SELECT symbol, day, CASE WHEN pl > high THEN 'gap down' WHEN low > ph THEN 'gap up' WHEN high > ph AND low > pl THEN 'higher' WHEN high < ph AND low < pl THEN 'lower' WHEN high >= ph AND low <= pl THEN 'outside' ELSE 'inside' END AS migration FROM p WHERE ph IS NOT NULL")
def value_migration(spark, sf_dir):
    d = B.resample(hourly(spark, sf_dir), T.DAY_S).withColumns({"ph": F.lag("high").over(R.over()), "pl": F.lag("low").over(R.over())}).where("ph is not null")
    label = (F.when(F.col("pl") > F.col("high"), "gap down").when(F.col("low") > F.col("ph"), "gap up").when((F.col("high") > F.col("ph")) & (F.col("low") > F.col("pl")), "higher")
             .when((F.col("high") < F.col("ph")) & (F.col("low") < F.col("pl")), "lower").when((F.col("high") >= F.col("ph")) & (F.col("low") <= F.col("pl")), "outside").otherwise("inside"))
    return d.select("symbol", F.floor(F.col("bar_s") / T.DAY_S).alias("day"), label.alias("migration"))


@query(f"SELECT level, sum(buy)::DOUBLE AS buy, sum(sell)::DOUBLE AS sell FROM {LADDER} GROUP BY 1")
def merged_ladders(spark, sf_dir):
    return T.ladder(spark, sf_dir).groupBy("level").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


# Books (K).

@query(f"SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0), 6) AS profit_factor FROM (SELECT symbol, quantity * (sold_at - bought_at) AS pnl FROM ({_FIFO})) GROUP BY 1")
def trade_stats(spark, sf_dir):
    return books.trade_stats(books.fifo(T.fills(spark, sf_dir)), ["symbol"]).select("symbol", "trades", "wins", F.round("profit_factor", 6).alias("profit_factor"))


@query(f"WITH d AS (SELECT day, sum(quantity * (sold_at - bought_at)) AS realised FROM ({_FIFO}) GROUP BY 1), m AS (SELECT year(day) * 12 + month(day) AS month, sum(realised) AS realised FROM d GROUP BY 1), e AS (SELECT month, sum(realised) OVER (ORDER BY month) AS equity FROM m) SELECT month, round(equity, 4) AS equity, round(max(equity) OVER (ORDER BY month) - equity, 4) AS drawdown FROM e")
def equity_curve(spark, sf_dir):
    m = books.daily(books.fifo(T.fills(spark, sf_dir))).groupBy((F.year("day") * 12 + F.month("day")).alias("month")).agg(F.sum("realised").alias("realised"))
    w = W.orderBy("month")  # a row a month
    e = m.withColumn("equity", F.sum("realised").over(w))
    return e.select("month", F.round("equity", 4).alias("equity"), F.round(F.max("equity").over(w) - F.col("equity"), 4).alias("drawdown"))


@query(f"SELECT underlying, month, strike, round(call, 6) AS call, round(put, 6) AS put FROM (SELECT underlying, month, strike, max(CASE WHEN option_type = 'CE' THEN oi END) AS call, max(CASE WHEN option_type = 'PE' THEN oi END) AS put FROM {CHAIN} GROUP BY 1, 2, 3)")
def chain_table(spark, sf_dir):
    c = T.chain(spark, sf_dir).groupBy("underlying", "month", "strike").pivot("option_type", ["CE", "PE"]).agg(F.max("oi"))
    return c.select("underlying", "month", "strike", F.round("CE", 6).alias("call"), F.round("PE", 6).alias("put"))


@query(f"SELECT underlying, month, arg_max(strike, CASE WHEN option_type = 'CE' THEN oi * 10000 - strike END) AS call_wall, arg_max(strike, CASE WHEN option_type = 'PE' THEN oi * 10000 - strike END) AS put_wall FROM {CHAIN} GROUP BY 1, 2")
def call_and_put_wall(spark, sf_dir):
    wall = lambda k: F.max_by("strike", F.when(F.col("option_type") == k, F.struct("oi", -F.col("strike"))))
    return T.chain(spark, sf_dir).groupBy("underlying", "month").agg(wall("CE").alias("call_wall"), wall("PE").alias("put_wall"))


# Streams (N): run over all that is there, each with its batch twin in SQL.

@query(f"SELECT symbol, bar_s, open, high, low, close, volume FROM {BARS} WHERE bar_s + 3600 <= (SELECT max(ts_s) FROM {TICKS}) - 600")
def stream_tumbling(spark, sf_dir):
    s = live.tumbling(live.events(spark, sf_dir), "1 hour").select("symbol", F.unix_timestamp("window.start").alias("bar_s"), "open", "high", "low", "close", "volume")
    return live.drained(s, folder(spark))


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM e) SELECT user_id, min(us) // 1000000 AS begin_s, count(*) AS n FROM s GROUP BY user_id, run HAVING max(us) + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000")
def stream_sessions(spark, sf_dir):
    s = live.activity(live.events(spark, sf_dir), "1 hour").select("user_id", F.unix_timestamp("session_window.start").alias("begin_s"), "n")
    return live.drained(s, folder(spark))


@query("SELECT event_id AS seq FROM events")
def stream_once(spark, sf_dir):
    e = live.events(spark, sf_dir)
    return live.drained(live.once(e.unionByName(e), ["seq"]).select("seq"), folder(spark))


@query(f"SELECT symbol, seq, gap FROM (SELECT symbol, seq, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY seq) AS gap FROM {TICKS}) WHERE gap > 1")
def sequence_gaps(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("seq")
    return T.ticks(spark, sf_dir).select("symbol", "seq", (F.col("seq") - F.lag("seq").over(w)).alias("gap")).where("gap > 1")


@query(f"SELECT symbol, max(seq) AS seq, arg_max(price, seq) AS price FROM {TICKS} GROUP BY 1")
def newest_per_key(spark, sf_dir):
    return live.newest(T.ticks(spark, sf_dir)).select("symbol", "seq", "price")
