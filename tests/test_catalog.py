"""Every registered query against its SQL on the smallest tables, and a few rules by hand."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import pricing
from lodestream.operators import books, indicators, joins, orderflow
from lodestream.plans import catalog, desks, discovery, flows, markets, more, pictures, profiles, series, sessions, signals, stores, streams, studies, volatility  # noqa: F401  they register their queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(v)
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    oracle.execute(catalog.SQL[name])
    names = [d[0] for d in oracle.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in oracle.fetchall())


def test_nearest_takes_the_first_of_one_second(spark, tmp_path):
    rows = [(1, 0, "view", 5.0), (2, 0, "view", 7.0), (3, 10, "purchase", 1.0), (4, 30, "view", 9.0), (5, 31, "purchase", 1.0), (6, 31, "view", None), (7, 9_000, "purchase", 1.0)]
    events = duckdb.connect()
    events.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    events.executemany("INSERT INTO events VALUES (?, make_timestamp(?::BIGINT * 1000000), ?, ?, '{\"k\": 1}')", rows)
    events.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {r["seq"]: r["price"] for r in catalog.nearest_in_time(spark, str(tmp_path)).collect()}
    assert got == {3: 5.0, 5: 9.0, 7: None} == dict(events.execute(catalog.SQL["nearest_in_time"]).fetchall())


def test_nearest_forms_no_pairs(spark, tmp_path):
    draw = np.random.default_rng(7)
    kinds = ["view", "purchase", "click"]
    rows = [(i // 2 if i % 50 == 0 else i, int(t) if i % 97 else None, kinds[int(k)], None if i % 31 == 0 else float(i)) for i, (t, k) in enumerate(zip(draw.integers(-40_000, 400_000, 1_500), draw.integers(0, 3, 1_500)))]
    rows += [(2_000 + i, t, k, float(i)) for i, (t, k) in enumerate([(900_000, "purchase"), (896_400, "view"), (903_600, "view"), (920_000, "purchase"), (923_601, "view"), (940_000, "purchase"), (936_399, "view"), (943_600, "view")])]
    events = duckdb.connect()
    events.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    events.executemany("INSERT INTO events VALUES (?, make_timestamp(?::BIGINT * 1000000), ?, ?, '{\"k\": 1}')", rows)
    events.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = catalog.nearest_in_time(spark, str(tmp_path))
    known = events.execute(catalog.SQL["nearest_in_time"]).fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, known))
    assert {(2_000, 1.0), (2_003, None), (2_005, 7.0)} <= set(known)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_by_key(spark):
    draw = np.random.default_rng(8)
    keys = ["a", "b", None]
    left = [(i, keys[int(k)], int(t)) for i, (k, t) in enumerate(zip(draw.integers(0, 3, 200), draw.integers(-300, 300, 200)))] + [(200, "a", None), (201, "c", 0)]
    right = [(keys[int(k)], int(t), None if t % 5 == 0 else int(t)) for t in draw.permutation(np.arange(-300, 300, 7)) for k in draw.integers(0, 3, 1)] + [("a", None, 5)]
    got = joins.nearest(spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), "k", "t", "v", 10).collect()
    assert len(got) == len(left)
    for r in got:
        near = [(abs(t - r["t"]), t, v) for k, t, v in right if None not in (k, t, r["t"]) and k == r["k"] and abs(t - r["t"]) <= 10]
        assert (r["v_at"], r["v"]) == (min(near, key=lambda x: x[:2])[1:] if near else (None, None))


def test_flagship(spark):
    assert catalog.FLAGSHIP(spark, DIR).count() > 0


def test_value_area_grows_up_on_a_tie(spark):
    rows = [("a", k, v) for k, v in [(1, 5.0), (2, 10.0), (3, 30.0), (4, 10.0), (5, 5.0)]]
    r = orderflow.value_area(spark.createDataFrame(rows, "symbol string, level long, volume double"), ["symbol"], 0.6).first()
    assert (r["poc"], r["val"], r["vah"]) == (3, 3, 4)


def test_value_area_of_a_single_level(spark):
    r = orderflow.value_area(spark.createDataFrame([("a", 7, 1.0)], "symbol string, level long, volume double"), ["symbol"]).first()
    assert (r["poc"], r["val"], r["vah"]) == (7, 7, 7)


def test_fifo_splits_lots(spark):
    fills = spark.createDataFrame(
        [("x", 1, "2024-01-01", "BUY", 10.0, 100.0), ("x", 2, "2024-01-02", "BUY", 10.0, 110.0), ("x", 3, "2024-01-03", "SELL", 15.0, 120.0)],
        "symbol string, seq int, day string, side string, quantity double, price double").withColumn("day", F.to_date("day"))
    got = sorted((r["quantity"], r["bought_at"], r["pnl"]) for r in books.fifo(fills).collect())
    assert got == [(5.0, 110.0, 50.0), (10.0, 100.0, 200.0)]


def test_asof_takes_the_newest_and_ages(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100)], "k string, at long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0)], "k string, at long, v double")
    got = {r["at"]: r["v"] for r in joins.asof(left, right, "k", "at", "v", most_age=50).collect()}
    assert got == {10: 2.0, 100: None}
    got = {r["at"]: r["v"] for r in joins.asof(left, right, "k", "at", "v", strictly=True).collect()}
    assert got == {10: 1.0, 100: 2.0}


def test_supertrend_turns(spark):
    rows = [("s", i, c + 1.0, c - 1.0, float(c), 1.0) for i, c in enumerate([10, 11, 12, 13, 5, 4, 3, 12, 14])]
    out = indicators.supertrend(spark.createDataFrame(rows, "symbol string, bar_s int, high double, low double, close double, atr double"))
    got = [r["dir"] for r in out.orderBy("bar_s").collect()]
    assert got[0] == 1 and got[4] == -1 and got[-1] == 1


def test_parity_of_modelled_prices(spark):
    s, k, t, r, v = (F.lit(x) for x in (100.0, 95.0, 0.5, 0.03, 0.2))
    call, put = (pricing.black_scholes(F.lit(c), s, k, t, r, v) for c in (True, False))
    row = spark.range(1).select((call - put).alias("d")).first()
    assert abs(row["d"] - (100 - 95 * math.exp(-0.015))) < 1e-5


def test_empty_series(spark):
    empty = spark.createDataFrame([], "symbol string, bar_s long, close double")
    assert indicators.macd(empty).count() == 0


def test_means_run_on_across_spans(spark):
    xs = [None, 5.0, 7.0, None, 4.0, 9.0, None, 1.0, 3.0, 8.0, 2.0, 6.0]
    at = [0, 3, 4, 9, 10, 11, 30, 31, 45, 46, 90, 91]  # spans of 10, some of them empty
    rows = spark.createDataFrame([(s, t, x) for s in "ab" for t, x in zip(at, xs)], "symbol string, bar_s int, close double")
    state, mean, known, want = None, None, [], {}
    for t, x in zip(at, xs):
        if x is not None:
            known.append(x)
            mean = sum(known) / 3 if len(known) == 3 else (mean * 2 + x) / 3 if len(known) > 3 else None
        want[t] = mean
    got = {(r["symbol"], r["bar_s"]): r["w"] for r in indicators.wilder(rows, 3, "close", "w", span=10).collect()}
    assert set(got) == {(s, t) for s in "ab" for t in at}
    for (s, t), w in got.items():
        assert (w is None) == (want[t] is None) and (w is None or math.isclose(w, want[t]))
    for t, x in zip(at[1:], xs[1:]):
        state = x if state is None else state if x is None else state + 0.5 * (x - state)
        want[t] = state
    for r in indicators.ema(rows.where("bar_s > 0"), 3, span=10).collect():
        assert math.isclose(r["ema"], want[r["bar_s"]])


def test_signal_of_macd_in_one_pass_and_in_two(spark):
    xs = [math.sin(i * i) + i / 7 for i in range(40)]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "symbol string, bar_s int, close double")
    for fast, slow, signal in ((3, 6, 4), (3, 6, 3)):
        f = s = xs[0]
        sig, want = 0.0, []
        for x in xs:
            f, s = f + 2 / (fast + 1) * (x - f), s + 2 / (slow + 1) * (x - s)
            sig += 2 / (signal + 1) * (f - s - sig)
            want.append(sig)
        got = [r["signal"] for r in indicators.macd(rows, fast, slow, signal, span=7).orderBy("bar_s").collect()]
        assert all(math.isclose(g, w, abs_tol=1e-12) for g, w in zip(got, want, strict=True))
