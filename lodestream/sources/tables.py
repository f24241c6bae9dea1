"""Views of the shared tables as market data; every operator runs over one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Seconds of a UTC+5:30 day at which a session opens.
OPEN_S = 9 * 3600 + 15 * 60
DAY_S = 86_400


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, ts_s, price, size: a tick for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), epoch(F.col("ts")).alias("ts_s"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, ts_s, price, size, bid, ask, bid_total, ask_total, received_s: ticks with the book that was quoted and the time of receipt."""
    bid = F.floor(F.col("value") * 20) / 20 - 0.05 * (F.col("user_id") % 3)
    size = F.get_json_object("props", "$.k").cast("long")
    at = epoch(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), at.alias("ts_s"), F.col("value").alias("price"), size.alias("size"),
        F.round(bid, 2).alias("bid"), F.round(bid + 0.05 * (1 + F.col("user_id") % 4), 2).alias("ask"),
        (F.col("user_id") * 7 % 101 + 1).alias("bid_total"), (F.col("user_id") * 13 % 103 + 1).alias("ask_total"), (at + F.col("user_id") % 300).alias("received_s"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, day, side, quantity, price: a fill for each line item."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day"),
        F.struct(epoch(F.col("l_shipdate")).alias("s"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, month (months since year 0), close: a panel of monthly average order prices."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(
        F.avg("o_totalprice").alias("close"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, level, buy, sell, unclassified: volume at price by side."""
    line = table(spark, sf_dir, "lineitem")
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("double")).otherwise(0.0))
    return line.groupBy((F.col("l_suppkey") % 10).alias("symbol"), F.floor(F.col("l_extendedprice") / 1000).alias("level")).agg(
        side("A").alias("buy"), side("R").alias("sell"), side("N").alias("unclassified"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """underlying, month, strike, option_type, oi, premium, spot: an option chain per brand and month."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    spot = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("spot"))
    rows = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("underlying"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"),
        (F.round(F.col("p_retailprice") / 10) * 10).alias("strike"),
        F.when(F.col("l_linenumber") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        F.col("l_quantity").cast("double").alias("oi"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("premium"))
    return rows.groupBy("underlying", "month", "strike", "option_type").agg(F.sum("oi").alias("oi"), F.avg("premium").alias("premium")).join(
        F.broadcast(spot), F.col("underlying") == F.col("p_brand")).drop("p_brand")


#: The same views in SQL.
SQL = {
    "ticks": "SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000000 AS ts_s, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events",
    "quotes": "SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000000 AS ts_s, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, round(floor(value * 20) / 20 - 0.05::DOUBLE * (user_id % 3), 2) AS bid, round(floor(value * 20) / 20 - 0.05::DOUBLE * (user_id % 3) + 0.05::DOUBLE * (1 + user_id % 4), 2) AS ask, user_id * 7 % 101 + 1 AS bid_total, user_id * 13 % 103 + 1 AS ask_total, epoch_us(ts) // 1000000 + user_id % 300 AS received_s FROM events",
    "closes": "SELECT o_orderpriority AS symbol, year(o_orderdate) * 12 + month(o_orderdate) AS month, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2",
    "ladder": "SELECT l_suppkey % 10 AS symbol, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS level, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END)::DOUBLE AS buy, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END)::DOUBLE AS sell, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE AS unclassified FROM lineitem GROUP BY 1, 2",
    "chain": "SELECT underlying, month, strike, option_type, sum(oi) AS oi, avg(premium) AS premium, any_value(spot) AS spot FROM (SELECT p_brand AS underlying, year(l_shipdate) * 12 + month(l_shipdate) AS month, round(p_retailprice / 10) * 10 AS strike, CASE WHEN l_linenumber % 2 = 0 THEN 'CE' ELSE 'PE' END AS option_type, l_quantity::DOUBLE AS oi, l_extendedprice / l_quantity / 100 AS premium FROM lineitem JOIN part ON l_partkey = p_partkey) c JOIN (SELECT p_brand, avg(p_retailprice) AS spot FROM part GROUP BY 1) s ON s.p_brand = c.underlying GROUP BY 1, 2, 3, 4",
}
SQL["bars"] = f"SELECT symbol, ts_s // 3600 * 3600 AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size)::BIGINT AS volume FROM ({SQL['ticks']}) GROUP BY 1, 2"
