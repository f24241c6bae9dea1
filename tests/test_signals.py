"""Signals by hand: previews, rotation, entry rules by name, the table function of runs."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestream.operators import indicators, ranks, signals


def bars_of(spark, closes, symbol="s"):
    rows = [(symbol, i * 3600, float(c), c + 1.0, c - 1.0, float(c), 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_s long, open double, high double, low double, close double, volume long")


def test_preview_is_what_closing_there_would_give(spark):
    rng = random.Random(1)
    closes = [100 + rng.uniform(-5, 5) for _ in range(40)]
    whole = {r["bar_s"]: r for r in indicators.macd(bars_of(spark, closes)).collect()}
    got = {r["bar_s"]: r for r in signals.macd_preview(bars_of(spark, closes), F.col("close")).collect()}
    assert len(got) == 39 and all(math.isclose(r["preview"], whole[t]["macd"], abs_tol=1e-9) and math.isclose(r["preview_signal"], whole[t]["signal"], abs_tol=1e-9) for t, r in got.items())
    # A close at the zero price makes the next MACD zero.
    at = got[39 * 3600]
    again = indicators.macd(bars_of(spark, [*closes[:-1], at["zero_price"]])).orderBy("bar_s", ascending=False).first()
    assert abs(again["macd"]) < 1e-9 and math.isclose(at["previous"], whole[38 * 3600]["macd"], abs_tol=1e-9)


def test_rotation_against_plain_loops(spark):
    rng = random.Random(2)
    mine, bench = [50 + rng.uniform(-3, 3) for _ in range(60)], [100 + rng.uniform(-3, 3) for _ in range(60)]

    def ema(xs, n):
        out = []
        for x in xs:
            out.append(x if not out else out[-1] + 2 / (n + 1) * (x - out[-1]))
        return out

    def z(xs):
        return [100 + (xs[i] - statistics.fmean(xs[i - 13:i + 1])) / statistics.pstdev(xs[i - 13:i + 1]) for i in range(13, len(xs))]

    ratio = z(ema([100 * a / b for a, b in zip(mine, bench)], 5))
    momentum = ema(z([b - a for a, b in zip(ratio, ratio[1:])]), 3)
    df = bars_of(spark, mine, "a").unionByName(bars_of(spark, bench, "b")).select("symbol", "bar_s", "close")
    got = signals.rotation(df, "b").orderBy("bar_s").collect()
    assert len(got) == len(momentum) and all(math.isclose(r["momentum"], m, abs_tol=1e-9) for r, m in zip(got, momentum))
    assert all(math.isclose(r["ratio"], x, abs_tol=1e-9) for r, x in zip(got, ratio[-len(got):]))
    for r in got:
        assert r["quadrant"] == {(True, True): "leading", (True, False): "weakening", (False, True): "improving", (False, False): "lagging"}[r["ratio"] >= 100, r["momentum"] >= 100]


def test_rules_are_found_by_name(spark):
    df = bars_of(spark, [10.0] * 21 + [15.0, 14.0])
    got = signals.entries(df, {"channel_break": {"lookback": 20}, "macd_cross": {}})
    assert [tuple(r) for r in got.collect()] == [("channel_break", "s", 21 * 3600)]
    with pytest.raises(KeyError, match="no such rule: tea_leaves"):
        signals.entries(df, {"tea_leaves": {}})
    assert set(signals.RULES) == {"macd_cross", "opening_range_break", "vwap_reclaim", "channel_break", "ignition", "pullback"}


def test_runs_end_where_the_way_turns(spark):
    signals.register_runs(spark, "runs_here")
    bars_of(spark, [1.0, 2, 3, 4, 4, 3, 2, 1, 0, 5], "a").unionByName(bars_of(spark, [5.0, 6, 7], "b")).createOrReplaceTempView("runs_of")
    got = spark.sql("SELECT * FROM runs_here(least => 2, row => TABLE(runs_of) PARTITION BY symbol ORDER BY bar_s)").collect()
    assert {tuple(r) for r in got} == {("a", 0, 3 * 3600, 3, 3.0), ("a", 4 * 3600, 8 * 3600, 4, -4.0), ("b", 0, 2 * 3600, 2, 2.0)}


@pytest.mark.parametrize("n, tiles", [(13, 5), (5, 5), (3, 5), (20, 4)])
def test_places_and_tiles_over_ranges(spark, tmp_path, n, tiles):
    df = spark.range(n).select((F.col("id") * 7 % n if n not in (7, 14) else F.col("id")).alias("v"), F.col("id"))
    placed = ranks.numbered(df.repartition(4), ["v", "id"], f"file://{tmp_path}")
    rows = placed.withColumn("tile", ranks.tile(F.col("place"), n, tiles)).orderBy("v", "id").collect()
    assert [r["place"] for r in rows] == list(range(1, n + 1))
    each, more = divmod(n, tiles)
    assert [r["tile"] for r in rows] == [t + 1 for t in range(tiles) for _ in range(each + (t < more))]


def test_trailing_shares_by_plain_windows(spark):
    rng = random.Random(3)
    xs = [rng.choice([None, 1.0, 2.0, 3.0, 4.0]) for _ in range(50)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "symbol string, bar_s int, v double")
    for inclusive in (True, False):
        got = {r["bar_s"]: r["share"] for r in ranks.trailing_share(df, "v", 6, inclusive).collect()}
        for i, x in enumerate(xs):
            held = [v for v in (xs[max(0, i - 5):i + 1] if inclusive else xs[max(0, i - 6):i]) if v is not None]
            want = None if x is None or not held else sum(v <= x if inclusive else v < x for v in held) / len(held)
            assert got[i] == want if want is None else math.isclose(got[i], want)
