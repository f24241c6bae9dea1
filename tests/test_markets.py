"""Rules of calendars, quotes and large prints by hand and by brute force."""

import numpy as np

from lodestream.operators import calendar, orderflow, quotes


def days(spark, lo, hi):
    return spark.range(lo, hi + 1).withColumnRenamed("id", "day")


def test_sessions_holidays_and_specials(spark):
    # Day 4 is a Monday; 6 is a holiday, on Saturday 9 there is an evening session.
    specials = spark.createDataFrame([(9, 64_800, 68_400), (99, 0, 1)], "day long, open_s int, close_s int")
    s = calendar.sessions(days(spark, 4, 11), spark.createDataFrame([(6,)], "day long"), specials)
    assert sorted((r["day"], r["kind"]) for r in s.collect()) == [(4, "regular"), (5, "regular"), (7, "regular"), (8, "regular"), (9, "special"), (11, "regular")]
    at = [(4, 33_299, 0), (4, 33_300, 1), (4, 55_799, 1), (4, 55_800, 0), (6, 40_000, 0), (9, 65_000, 1), (9, 40_000, 0)]
    ticks = spark.createDataFrame([("x", i, d * 86_400 + t) for i, (d, t, _) in enumerate(at)], "symbol string, seq long, ts_s long")
    assert {r["seq"] for r in calendar.in_session(ticks, s).collect()} == {i for i, (*_, there) in enumerate(at) if there}
    assert {r["day"]: r["logical_day"] for r in calendar.logical_days(s).collect()}[9] == 8
    assert {r["day"]: (r["prev_day"], r["next_day"]) for r in calendar.with_neighbours(s).collect()}[8] == (7, 11)


def test_expiry_moves_to_the_open_day_before(spark):
    d = days(spark, 0, 30)  # January 1970; its Tuesdays are 5, 12, 19, 26
    s = calendar.sessions(d, spark.createDataFrame([(26,)], "day long"), spark.createDataFrame([], "day long, open_s int, close_s int"))
    r = calendar.monthly_expiries(d, s, 1).first()
    assert (r["by_rule"], r["expiry"]) == (26, 25)


def test_tape_of_a_total_that_is_reset(spark):
    rows = [("x", 1, 10, 5.0, 100), ("x", 2, 11, 5.1, 140), ("x", 3, 12, 5.2, 140), ("x", 4, 13, 5.3, 20), ("x", 5, 14, 5.4, 50)]
    t = quotes.tape(spark.createDataFrame(rows, "symbol string, seq long, ts_s long, price double, total long")).orderBy("seq").collect()
    assert [r["traded"] for r in t] == [0, 40, 0, 0, 30] and [r["ref_price"] for r in t] == [None, None, 5.1, 5.1, 5.1]


def test_votes_agree_or_carry(spark):
    rows = [("x", 1, 9.9, 10.0, 50, 50, 9.95, 10), ("x", 2, 9.9, 10.0, 50, 40, 10.0, 10), ("x", 3, 9.9, 10.0, 50, 40, 9.95, 10), ("x", 4, 9.9, 10.0, 50, 40, 9.95, 10)]
    v = quotes.votes(spark.createDataFrame(rows, "symbol string, seq long, bid double, ask double, bid_total long, ask_total long, price double, size long"))
    got = quotes.combined(v, v.seq == 2).orderBy("seq").collect()
    assert [(r["side"], r["method"]) for r in got] == [(0, "none"), (1, "quote+pending"), (-1, "tick"), (-1, "carry")] and abs(got[1]["confidence"] - 0.72) < 1e-9


def test_large_prints_match_a_plain_search(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], i, int(t), int(s)) for i, (t, s) in enumerate(zip(rng.integers(0, 4_000, 400), rng.integers(1, 60, 400), strict=True))]
    got = {r["seq"]: r["median"] for r in orderflow.large_prints(spark.createDataFrame(rows, "symbol string, seq long, ts_s long, size long"), 500, 1.5, 5).collect()}
    want = {}
    for symbol, seq, t, size in rows:
        held = sorted(s for y, _, u, s in rows if y == symbol and t - 500 <= u < t)
        if len(held) >= 5 and size >= 1.5 * held[len(held) // 2]:
            want[seq] = held[len(held) // 2]
    assert got == want
