"""Passes over sorted series, trends, books and profiles by hand and against plain loops."""

import math
import random
import time

import pytest

from lodestream.operators import books, indicators, profiles, state, trends


def series(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_scan_carries_state_over_batches(spark):
    """A state that is None, batches of few rows and rows at a series' end."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = series(spark, [(k, i, i * 10) for k in "abc" for i in range(10)], "k string, i int, v int")
        step = lambda s, i, v: ((s or 0) + v, [(i, (s or 0) + v)] if i % 2 else [])
        got = state.scan(df, ["k"], ["i"], ["i", "v"], lambda: None, step, "i int, total long", end=lambda s: [(-1, s)]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(k, i, sum(range(i + 1)) * 10) for k in "abc" for i in (1, 3, 5, 7, 9)} | {(k, -1, 450) for k in "abc"}
    assert {tuple(r) for r in got} == want and len(got) == 18
    assert state.scan(df.where("i < 0"), ["k"], ["i"], ["i"], list, lambda s, i: (s, []), "i int", end=lambda s: [(0,)]).count() == 0


def test_a_long_series_is_linear(spark):
    """50,000 points of one symbol."""
    df = spark.range(50_000).selectExpr("'s' AS symbol", "id * 60 AS bar_s", "100 + sin(id / 50.0) * 10 AS close")
    indicators.macd(df.limit(10)).count()
    began = time.time()
    last = indicators.macd(df).orderBy("bar_s", ascending=False).first()
    assert time.time() - began < 20
    f = s = None
    for i in range(50_000):
        x = 100 + math.sin(i / 50.0) * 10
        f, s = (x, x) if f is None else (f + 2 / 13 * (x - f), s + 2 / 27 * (x - s))
    assert math.isclose(last["macd"], f - s, rel_tol=1e-9)


def test_trend_turns_adds_and_reduces(spark):
    """Up 2 ATR confirms; one unit a bar later; a pullback and its end add; an old and faded trend goes down to one."""
    closes = [10, 10, 13, 14, 15, 16, 15.5, 16.6, 17, *[17.2 + i / 10 for i in range(10)], 14]
    rows = [("s", i, c + 0.2, c - 0.2, float(c), 1.0, 1.0 if i < 12 else 0.3) for i, c in enumerate(closes)]
    df = series(spark, rows, "symbol string, bar_s int, high double, low double, close double, atr double, hist double")
    got = {r["bar_s"]: r for r in trends.trend_units(df).collect()}
    assert got[2]["direction"] == 1 and got[2]["action"] == "FLIP" and got[2]["units"] == 0 and got[3]["units"] == 1
    assert got[7]["action"] == "ADD" and got[8]["units"] == 2 and got[7]["age"] == 5
    assert got[13]["action"] == "REDUCE" and got[14]["units"] == 1 and got[13]["fade"] == pytest.approx(0.3)
    assert got[19]["direction"] == -1 and got[19]["action"] == "FLIP"


def plain_lines(bars, k):
    """Events by looking back over the whole history at each bar."""
    out = []
    lines = {1: None, -1: None}
    for t in range(2 * k + 1, len(bars)):
        for side, field in ((1, "high"), (-1, "low")):
            e = [side * b[field] for b in bars]
            swings = [i for i in range(k + 1, t - k + 1) if e[i] == max(e[i - k:i + k + 1])]
            if len(swings) >= 2 and e[swings[-1]] < e[swings[-2]] and (lines[side] is None or lines[side][1] != swings[-1]):
                lines[side] = (swings[-2], swings[-1])
        if bars[t]["atr"] is None:
            continue
        for side, field in ((1, "high"), (-1, "low")):
            if lines[side] is None:
                continue
            i, j = lines[side]
            a, b = bars[i][field], bars[j][field]
            at = lambda n: b + (b - a) / (j - i) * (n - j)
            c, now = bars[t]["close"], at(t)
            if side * (c - now) > 0:
                if side * (c - now) > 0.1 * bars[t]["atr"] and side * (bars[t - 1]["close"] - at(t - 1)) <= 0:
                    out.append((t, "breakout" if side > 0 else "breakdown"))
                lines[side] = None
            elif side * (bars[t][field] - now) >= -0.25 * bars[t]["atr"] and c != now and side * (c - bars[t]["open"]) < 0:
                out.append((t, "bounce_down" if side > 0 else "bounce_up"))
    return sorted(out)


def test_trendlines_as_a_plain_search_finds_them(spark):
    rng = random.Random(4)
    price, bars = 100.0, []
    for i in range(400):
        o = price
        price = max(5.0, price + rng.uniform(-2, 2))
        bars.append({"open": o, "high": max(o, price) + rng.random(), "low": min(o, price) - rng.random(), "close": price, "atr": 2.0 if i > 13 else None})
    df = series(spark, [("s", i, b["open"], b["high"], b["low"], b["close"], b["atr"]) for i, b in enumerate(bars)], "symbol string, bar_s int, open double, high double, low double, close double, atr double")
    got = sorted((r["bar_s"], r["event"]) for r in trends.trendlines(df, 3).collect())
    assert got == plain_lines(bars, 3) and {e for _, e in got} == {"breakout", "breakdown", "bounce_up", "bounce_down"}


def test_balance_restarts_one_bar_on(spark):
    """The first bar belongs to no run; the three after it do, and the wide one ends it."""
    bars = [(0, 50, 60), (1, 10, 20), (2, 11, 21), (3, 9, 19), (4, 0, 90), (5, 30, 40), (6, 31, 41)]
    df = series(spark, [("s", at, float(lo), float(hi)) for at, lo, hi in bars], "symbol string, bar_s int, low double, high double")
    assert [tuple(r) for r in trends.balance_clusters(df, ["symbol"]).collect()] == [("s", 1, 3, 9.0, 21.0, 3)]


def test_cooldown(spark):
    df = series(spark, [("a", t) for t in (0, 5, 10, 14, 19, 20, 31)] + [("b", 7)], "symbol string, ts_s int")
    assert sorted((r["symbol"], r["ts_s"]) for r in trends.cooled(df, ["symbol"], "ts_s", 10).collect()) == [("a", 0), ("a", 10), ("a", 20), ("a", 31), ("b", 7)]


def test_position_book_fees_reversal_and_excursion(spark):
    fills = [("x", 1, "BUY", 10.0, 100.0, 1.0), ("x", 2, "BUY", 10.0, 110.0, 1.0), ("x", 3, "SELL", 5.0, 120.0, 0.5), ("x", 4, "SELL", 25.0, 90.0, 2.5), ("x", 5, "BUY", 10.0, 80.0, 1.0)]
    got = books.position_book(series(spark, fills, "symbol string, n int, side string, quantity double, price double, fees double"), ["n"]).orderBy("n").collect()
    assert [r["held"] for r in got] == [10, 20, 15, -10, 0] and [r["average"] for r in got] == [100, 105, 105, 90, None]
    assert got[2]["closed"] == 5 and got[2]["gross"] == 75 and got[2]["fees"] == pytest.approx(2 * 5 / 20 + 0.5) and (got[2]["low"], got[2]["high"]) == (100, 120)
    # Through zero: 15 close at a loss, 10 begin a short with what is left of the fee.
    assert got[3]["closed"] == 15 and got[3]["gross"] == -225 and got[3]["fees"] == pytest.approx(1.5 + 2.5 * 15 / 25) and got[3]["low"] == 90
    assert got[4]["gross"] == 100 and got[4]["fees"] == pytest.approx(1.0 + 1.0) and (got[4]["low"], got[4]["high"]) == (80, 90)
    # What the slices earned after their fees is the result, as nothing is open.
    assert got[4]["realised"] == pytest.approx(sum((r["gross"] or 0) - (r["fees"] or 0) for r in got))


def test_areas_on_ties():
    assert profiles.area_of({1: 5, 2: 10, 3: 30, 4: 10, 5: 5}, 0.6) == (3, 3, 4)
    assert profiles.area_of({1: 5, 2: 10, 3: 30, 4: 10, 5: 5}, 0.6, upward=False) == (3, 2, 3)
    assert profiles.area_of({7: 1}) == (7, 7, 7)


def test_developing_area_is_that_of_the_rows_so_far(spark):
    rng = random.Random(2)
    rows = sorted({("s", rng.randrange(12), rng.randrange(20)) for _ in range(120)})
    got = {r["bracket"]: r for r in profiles.developing(series(spark, rows, "symbol string, bracket long, level long"), ["symbol"]).collect()}
    for b in {r[1] for r in rows}:
        held = {}
        for _, bracket, level in rows:
            if bracket <= b:
                held[level] = held.get(level, 0) + 1
        assert (got[b]["poc"], got[b]["val"], got[b]["vah"]) == profiles.area_of(held) and got[b]["touches"] == sum(held.values())


def test_naked_levels_go_when_covered(spark):
    rows = [("s", 1, 10.0, 9.0, 11.0), ("s", 2, 20.0, 18.0, 22.0), ("s", 3, 30.0, 19.0, 31.0), ("s", 4, 15.0, 14.0, 16.0)]
    got = sorted((r["hour"], r["since"], r["level"]) for r in profiles.naked(series(spark, rows, "symbol string, hour int, poc double, low double, high double"), "hour").collect())
    assert got == [(2, 1, 10.0), (3, 1, 10.0), (4, 1, 10.0), (4, 3, 30.0)]
