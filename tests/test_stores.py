"""Stored tables, data sources and streams with keyed state."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import exchange
from lodestream.sources.store import Conflict, Store
from lodestream.streaming import live


def rows_of(store):
    return sorted(tuple(r) for r in store.read().select("k", "day", "v", "source").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, day long, v long, source string")


def test_merges_in_a_row_by_priority(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["k", "day"], "day")
    guard = F.struct((F.col("source") == "live").alias("l"), F.col("_new").alias("n"))
    assert s.version() == 0
    assert s.merge(frame(spark, [("a", 1, 1, "live"), ("b", 1, 2, "rebuilt"), ("a", 2, 3, "live"), ("n", None, 9, "live")]), guard) == 1
    untouched = s.manifest()["parts"]["p2"]
    assert s.merge(frame(spark, [("a", 1, 10, "rebuilt"), ("b", 1, 20, "rebuilt"), ("c", 1, 30, "rebuilt"), ("n", None, 8, "rebuilt")]), guard) == 2
    assert {(r[0], r[1]): (r[2], r[3]) for r in s.read().collect()} == {("a", 1): (1, "live"), ("b", 1): (20, "rebuilt"), ("c", 1): (30, "rebuilt"), ("a", 2): (3, "live"), ("n", None): (9, "live")}
    assert s.manifest()["parts"]["p2"] == untouched  # a partition that was not touched was not written
    assert {(r[0], r[1]): r[2] for r in s.read(version=1).collect()}[("b", 1)] == 2  # the version before is as it was
    s.merge(frame(spark, [("b", 1, 21, "live")]), guard)
    assert {(r[0], r[1]): r[2] for r in s.read().collect()}[("b", 1)] == 21
    assert s.damaged() == []


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["k"], "day")
    s.merge(frame(spark, [("a", 1, 1, "live")]))
    with pytest.raises(Exception, match="lost"):
        s.merge(frame(spark, [("a", 1, 2, "live"), ("b", 1, 3, "live")]).withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long")))
    assert s.version() == 1 and rows_of(s) == [("a", 1, 1, "live")]


def test_two_merges_at_a_time_cannot_both_succeed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["k"], "day")
    s.merge(frame(spark, [("a", 1, 1, "live")]))
    held = s.manifest()
    s.merge(frame(spark, [("a", 1, 2, "live")]))
    with pytest.raises(Conflict):
        s._commit(1, held["schema"], held["parts"])
    assert rows_of(s) == [("a", 1, 2, "live")]


def test_retention_needs_the_archive(spark, tmp_path):
    hot, cold = (Store(spark, f"file://{tmp_path}/{n}", ["k"], "day") for n in ("hot", "cold"))
    rows = [(f"{d}{i}", d, i, "live") for d in (1, 2, 3) for i in range(5)]
    hot.merge(frame(spark, rows))
    cold.merge(frame(spark, [r for r in rows if r[1] != 2 or r[2] != 4]))
    assert hot.retain(cold, "3") == ["p1"] and {r[1] for r in rows_of(hot)} == {2, 3}


def test_ordered_batches_with_pushed_filters(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["k"], "day")
    df = spark.range(2_000).select(F.format_string("%05d", "id").alias("k"), (F.col("id") % 5).alias("day"), F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, "live").alias("source"))
    s.merge(df)
    exchange.register(spark)
    reader = exchange.ArchiveReader({"path": s.path, "part": "day"}, df.schema)
    list(reader.pushFilters([exchange.EqualTo(("day",), 3), exchange.GreaterThan(("v",), 100)]))
    parts = reader.partitions()
    assert parts and all("_part=p3" in p.file for p in parts)  # other days' files are not opened
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == df.where("day = 3 and v > 100").count()
    with exchange.pushing(spark):
        got = spark.read.format("archive_batches").schema(df.schema).option("part", "day").load(s.path).where("day in (1, 3) and v <= 50 and source = 'live'")
        assert sorted(r["v"] for r in got.collect()) == [v for v in range(51) if v % 5 in (1, 3) and v % 2 == 0]


def test_line_protocol_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("a b,c=d", 5, 1.5, 7, True, 'say "x", y'), ("é", 6, None, None, False, "back\\slash"), (None, 7, 0.1, -3, None, None)], "symbol string, at long, x double, n long, ok boolean, note string")
    exchange.register(spark)
    o = {"measurement": "bars", "tags": "symbol", "at": "at"}
    path = f"file://{tmp_path}/l"
    df.repartition(3).write.format("line_protocol").options(**o).mode("append").save(path)
    back = spark.read.format("line_protocol").schema(df.schema).options(**o).load(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    # A file that no manifest names, as a task that ran twice leaves it, adds nothing.
    (tmp_path / "l/lines/stray.line").write_text("bars,symbol=z x=1.0 9000000000\n")
    assert back.count() == 3
    df.limit(1).write.format("line_protocol").options(**o).mode("append").save(path)
    assert spark.read.format("line_protocol").schema(df.schema).options(**o).load(path).count() == 4
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "l").glob("*.commit"))


def test_session_bars_by_hand(spark, tmp_path):
    """Seeded, with a late, a stale and an off-session tick, an idle bar that the clock closes and a flush at the session's end."""
    day = 20_000 * 86_400
    at = lambda h, m: day + h * 3600 + m * 60
    ticks = [  # delivery, seq, made, came, price, size
        (0, 1, at(9, 0), at(9, 0), 1.0, 1), (0, 2, at(10, 1), at(10, 1), 10.0, 5), (0, 3, at(10, 59), at(10, 59), 12.0, 5),
        (1, 4, at(11, 5), at(11, 6), 11.0, 1), (1, 5, at(10, 30), at(11, 7), 99.0, 1),
        (2, 6, at(15, 10), at(15, 10), 13.0, 2), (2, 7, at(15, 12) - 4 * 86_400, at(15, 12), 50.0, 2),
        (3, 8, at(15, 20), at(15, 50), 14.0, 1), (4, 9, at(17, 0), at(17, 0), 1.0, 1)]
    df = spark.createDataFrame([("s", *t[1:], t[0]) for t in ticks], "symbol string, seq long, ts_s long, arrived_s long, price double, size long, part int").withColumn("arrived", F.timestamp_seconds("arrived_s"))
    seed = spark.createDataFrame([("s", at(9, 0) - 86_400, 9.0, 8.0, 0.5)], "symbol string, last_s long, fast double, slow double, signal double")
    with live.rocksdb(spark):
        out = live.drained(live.session_bars(live.delivered(df, "part", 5, f"file://{tmp_path}"), seed), f"file://{tmp_path}").collect()
    bars = {(r["bar_s"] - day) // 3600: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out if r["kind"] == "bar"}
    assert bars == {10: (10, 12, 10, 12, 10), 11: (11, 11, 11, 11, 1), 15: (13, 14, 13, 14, 3)}
    assert {(r["seq"], r["kind"]) for r in out if r["kind"] != "bar"} == {(1, "off session"), (5, "late"), (7, "stale"), (9, "off session")}
    first = next(r for r in out if r["kind"] == "bar" and r["close"] == 12)
    fast, slow = 9 + 2 / 13 * 3, 8 + 2 / 27 * 4
    assert first["macd"] == pytest.approx(fast - slow) and first["signal"] == pytest.approx(0.5 + 0.2 * (fast - slow - 0.5))
