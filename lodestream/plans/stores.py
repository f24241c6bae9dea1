"""Registered queries of stored tables: merges, retention, ordered batches and line protocol, each written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import exchange, tables as T
from ..sources.store import Store
from .catalog import BARS, TICKS, hourly, query
from .more import folder


def store(spark, name: str, keys: list[str], part: str = "day") -> Store:
    return Store(spark, f"{folder(spark)}/lodestream/{name}-{uuid.uuid4().hex}", keys, part)


def daily_bars(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))


@query(f"SELECT symbol, bar_s, close, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_s ORDER BY taken DESC) AS k FROM (SELECT symbol, bar_s, close, volume % 3 AS source, 1 AS taken FROM {BARS} UNION ALL SELECT symbol, bar_s, open, 5, 2 FROM {BARS} WHERE volume % 2 = 0)) WHERE k = 1")
def upserted_bars(spark, sf_dir):
    """Replace on key: a second delivery of bars merged into a stored table, of which it rewrites the days it touches."""
    b = daily_bars(spark, sf_dir)
    s = store(spark, "bars", ["symbol", "bar_s"])
    s.merge(b.select("symbol", "bar_s", "day", "close", (F.col("volume") % 3).alias("source")))
    s.merge(b.where("volume % 2 = 0").select("symbol", "bar_s", "day", F.col("open").alias("close"), F.lit(5).cast("long").alias("source")))
    return s.read().select("symbol", "bar_s", "close", "source")


@query(f"SELECT symbol, bar_s, close FROM {BARS} WHERE volume % 2 = 1 UNION ALL SELECT symbol, bar_s, open FROM {BARS} WHERE volume % 2 = 0")
def kept_first(spark, sf_dir):
    """Insert or ignore: rows whose key the stored table has already don't displace it."""
    b = daily_bars(spark, sf_dir)
    s = store(spark, "firsts", ["symbol", "bar_s"])
    s.merge(b.where("volume % 2 = 1").select("symbol", "bar_s", "day", "close"))
    s.merge(b.select("symbol", "bar_s", "day", F.col("open").alias("close")), -F.col("_new"))
    return s.read().select("symbol", "bar_s", "close")


_DELIVERED = f"SELECT symbol, bar_s, close, 'live' AS source, 1 AS taken FROM {BARS} WHERE volume % 3 > 0 UNION ALL SELECT symbol, bar_s, open, 'rebuilt', 2 FROM {BARS} WHERE volume % 2 = 0 UNION ALL SELECT symbol, bar_s, high, CASE WHEN volume % 5 = 0 THEN 'live' ELSE 'rebuilt' END, 3 FROM {BARS} WHERE volume % 7 < 3"


@query(f"SELECT symbol, bar_s, close, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_s ORDER BY source = 'live' DESC, taken DESC) AS k FROM ({_DELIVERED})) WHERE k = 1")
def guarded_bars(spark, sf_dir):
    """Three merges in a row, of which no rebuilt row displaces a live one."""
    b = daily_bars(spark, sf_dir)
    s = store(spark, "guarded", ["symbol", "bar_s"])
    guard = F.struct((F.col("source") == "live").alias("live"), F.col("_new").alias("new"))
    row = lambda df, price, source: df.select("symbol", "bar_s", "day", F.col(price).alias("close"), source.alias("source"))
    s.merge(row(b.where("volume % 3 > 0"), "close", F.lit("live")), guard)
    s.merge(row(b.where("volume % 2 = 0"), "open", F.lit("rebuilt")), guard)
    s.merge(row(b.where("volume % 7 < 3"), "high", F.when(F.col("volume") % 5 == 0, "live").otherwise("rebuilt")), guard)
    return s.read().select("symbol", "bar_s", "close", "source")


def archived(spark, sf_dir) -> tuple[Store, Store]:
    """(hot table, archive): ticks by day, and all of them but some days and some rows of others."""
    t = T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S))
    hot, cold = (store(spark, n, ["symbol", "seq"]) for n in ("hot", "archive"))
    hot.merge(t)
    cold.merge(t.where("day % 5 != 0 and not (day % 2 = 1 and seq % 97 = 0)"))
    return hot, cold


_INDEX = f"SELECT ts_s // 86400 AS day, count(*) AS hot, count(*) FILTER (WHERE ts_s // 86400 % 5 <> 0 AND NOT (ts_s // 86400 % 2 = 1 AND seq % 97 = 0)) AS archived FROM {TICKS} GROUP BY 1"


@query(f"SELECT day, hot, archived, hot = archived AS may_go FROM ({_INDEX})")
def archive_guard(spark, sf_dir):
    """Days of the hot table that may go: those that the archive's manifest holds with the same rows and checksum."""
    hot, cold = archived(spark, sf_dir)
    here, there = hot.manifest()["parts"], cold.manifest()["parts"]
    safe = set(hot.covered(cold))
    rows = [(int(k[1:]), v["rows"], there.get(k, {"rows": 0})["rows"], k in safe) for k, v in here.items()]  # one row a day, from the manifests
    return spark.createDataFrame(rows, "day long, hot long, archived long, may_go boolean")


@query(f"WITH i AS ({_INDEX}), l AS (SELECT max(day) - 10 AS least FROM i) SELECT t.ts_s // 86400 AS day, t.symbol, count(*) AS rows, sum(t.size)::BIGINT AS volume FROM {TICKS} t JOIN i ON i.day = t.ts_s // 86400, l WHERE NOT (i.day < l.least AND i.hot = i.archived) GROUP BY 1, 2")
def retained_ticks(spark, sf_dir):
    """What the hot table still holds after retention: old days go where the archive covers them, and only there."""
    hot, cold = archived(spark, sf_dir)
    newest = max((int(k[1:]) for k in hot.manifest()["parts"]), default=0)
    hot.retain(cold, str(newest - 10))
    return hot.read().groupBy("day", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("volume"))


@query(f"SELECT day, hot AS rows, day % 4 <> 0 AS sound FROM (SELECT ts_s // 86400 AS day, count(*) AS hot FROM {TICKS} GROUP BY 1)")
def sealed_archive(spark, sf_dir):
    """Days of an archive whose files still hold what its manifest says, after some were written over."""
    t = T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S))
    s = store(spark, "sealed", ["symbol", "seq"])
    s.merge(t)
    parts = s.manifest()["parts"]
    # Something else writes over the folders of every fourth day: as many rows, one price another.
    for k in (k for k in parts if int(k[1:]) % 4 == 0):
        there = s.read([k])
        least = there.agg(F.min(F.struct("symbol", "seq")).alias("m")).select("m.*")
        other = there.join(F.broadcast(least.withColumn("_hit", F.lit(1))), ["symbol", "seq"], "left").withColumn("price", F.col("price") + F.coalesce("_hit", F.lit(0))).select(*there.columns)
        fresh = f"{s.path}/over-{uuid.uuid4().hex}"
        other.write.parquet(fresh)
        spark.read.schema(there.schema).parquet(fresh).write.mode("overwrite").parquet(f"{s.path}/{parts[k]['folder']}")
    broken = set(s.damaged())
    return spark.createDataFrame([(int(k[1:]), v["rows"], k not in broken) for k, v in parts.items()], "day long, rows long, sound boolean")


@query(f"SELECT symbol, seq, ts_s, price FROM {TICKS} WHERE symbol = 'click' AND ts_s // 86400 >= (SELECT min(ts_s) // 86400 + 5 FROM {TICKS}) AND ts_s // 86400 < (SELECT min(ts_s) // 86400 + 12 FROM {TICKS})")
def archive_batches(spark, sf_dir):
    """A week of one symbol from a stored table, by ordered batches of its files with the filters pushed into them."""
    t = T.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_s") / T.DAY_S))
    s = store(spark, "batches", ["symbol", "seq"])
    s.merge(t)
    first = min((int(k[1:]) for k in s.manifest()["parts"]), default=0)
    exchange.register(spark)
    out = f"{s.path}/picked"
    with exchange.pushing(spark):  # which has to hold while the plan runs
        df = spark.read.format("archive_batches").schema(t.schema).option("part", "day").load(s.path)
        df.where((F.col("day") >= first + 5) & (F.col("day") < first + 12) & (F.col("symbol") == "click")).select("symbol", "seq", "ts_s", "price").write.parquet(out)
    return spark.read.parquet(out)


@query(f"SELECT symbol, bar_s, open, high, low, close, volume FROM {BARS}")
def line_protocol(spark, sf_dir):
    """Bars written as line protocol, by tasks whose files one manifest names, and read back."""
    b = hourly(spark, sf_dir)
    exchange.register(spark)
    path = f"{folder(spark)}/lodestream/lines-{uuid.uuid4().hex}"
    options = {"measurement": "bars_1h", "tags": "symbol", "at": "bar_s"}
    b.write.format("line_protocol").options(**options).mode("append").save(path)
    return spark.read.format("line_protocol").schema(b.schema).options(**options).load(path)
