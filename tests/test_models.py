"""Fitted models, rules, resampling, clustering and solved volatilities against plain counterparts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import pricing
from lodestream.operators import bars, models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x @ [1.5, -2.0, 0.3] + 0.4 + rng.logistic(size=600) > 0).astype(float)
    rows = [(int(i // 6), *map(float, r), float(v), float(np.sin(r[0]) + 0.5 * rng.normal())) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "day long, a double, b double, c double, won double, target double").repartition(4).cache()


def test_logistic_equals_newton_on_one_machine(points):
    got = models.logistic(points, ["a", "b", "c"], "won", ridge=1e-3)
    m = np.array([tuple(r) for r in points.select("a", "b", "c", "won").collect()])
    x, y, w = np.hstack([m[:, :3], np.ones((len(m), 1))]), m[:, 3], np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4), x.T @ (p - y) + 1e-3 * w)
    assert np.allclose(got, w, atol=1e-8)
    chance = points.select(models.logit(["a", "b", "c"], got).alias("p"), "won")
    assert chance.agg(F.avg(((F.col("p") > 0.5) == (F.col("won") > 0)).cast("double"))).first()[0] > 0.8


def test_logistic_of_one_class_ends(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, won double")
    assert np.all(np.isfinite(models.logistic(df, ["a"], "won")))


def test_quantile_loss_falls_and_gradients_are_right(points):
    names = ["a", "b", "c"]
    net, w, losses = models.quantile_net(points, names, "target", 0.9, rounds=12)
    assert losses[-1] < 0.8 * losses[0] and min(losses) == pytest.approx(min(losses[-3:]), rel=0.2)
    # The gradient that is summed over partitions, against differences of the loss.
    m = np.array([tuple(r) for r in points.select(*names, "target").collect()])

    def loss(v):
        off = m[:, -1] - net.run(v, m[:, :-1])[0]
        return np.sum(np.maximum(0.9 * off, -0.1 * off))

    out, held = net.run(w, m[:, :-1])
    g = net.gradient(w, m[:, :-1], held, np.where(m[:, -1] - out >= 0, -0.9, 0.1))
    for i in range(0, len(w), 5):
        e = np.zeros_like(w)
        e[i] = 1e-6
        assert (loss(w + e) - loss(w - e)) / 2e-6 == pytest.approx(g[i], rel=1e-3, abs=1e-2)
    got = models.scored(points, net, w, names, "q").select("q").count()
    assert got == 600


def test_listwise_loss_falls_over_groups_cut_by_batches(spark, points):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    gains = points.withColumn("gain", F.greatest(F.col("target"), F.lit(0.0)))
    try:
        out = []
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out.append(models.listwise_net(gains, "day", ["a", "b", "c"], "gain", rounds=6)[2])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(*out) and out[0][-1] < out[0][0]


def test_rules_equal_trying_every_rule(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.uniform(0, 1)]), float(rng.randrange(6)), rng.uniform(-1, 1), rng.randrange(-50, 80), rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, gain long, test boolean").repartition(3)
    got = [tuple(r) for r in models.rules(df.where("not test"), df.where("test"), ["a", "b", "c"], "gain", least=10, most=15).collect()]
    train, test = [r for r in rows if not r[4]], [r for r in rows if r[4]]
    found = []
    for k in range(3):
        held = sorted(r[k] for r in train if r[k] is not None)
        for t in sorted({held[max(0, math.ceil(q * len(held)) - 1)] for q in (0.2, 0.35, 0.5, 0.65, 0.8)}):
            found += [(k, ">=", t), (k, "<=", t)]
    fits = lambda r, c: r[c[0]] is not None and (r[c[0]] >= c[2] if c[1] == ">=" else r[c[0]] <= c[2])
    want = []
    for i, x in enumerate(found):
        for j, y in list(enumerate(found))[i:]:
            if i != j and x[0] == y[0]:
                continue
            hit = [r[3] for r in train if fits(r, x) and fits(r, y)]
            if len(hit) >= 10 and sum(hit) > 0:
                want.append((-sum(hit) / len(hit) * math.sqrt(len(hit)), i, j, len(hit), [r[3] for r in test if fits(r, x) and fits(r, y)]))
    for place, (row, (score, i, j, n, held_out)) in enumerate(zip(got, sorted(want)[:15], strict=True), 1):
        assert row[:4] == (place, "abc"[found[i][0]], *found[i][1:]) and row[4:7] == (("abc"[found[j][0]], *found[j][1:]) if i != j else (None, None, None))
        assert row[7] == n and row[9] == pytest.approx(-score) and row[10] == len(held_out) and row[11] == (pytest.approx(sum(held_out) / len(held_out)) if held_out else None)


def test_bootstrap_equals_plain_resampling_by_the_same_seeds(spark):
    import hashlib

    values = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("t", 0, 2.5)], "symbol string, day int, v double")
    got = {r["symbol"]: r for r in models.bootstrap(df, ["symbol"], "v", "day", draws=80, seed="x").collect()}
    means = sorted(np.mean([values[int(hashlib.md5(f"x:{r}:{k}".encode()).hexdigest()[:12], 16) % 7] for k in range(7)]) for r in range(80))
    assert got["s"]["low"] == pytest.approx(np.quantile(means, 0.025)) and got["s"]["high"] == pytest.approx(np.quantile(means, 0.975))
    assert (got["t"]["low"], got["t"]["high"], got["t"]["blocks"]) == (2.5, 2.5, 1)


@pytest.mark.parametrize("n, target", [(25, 20), (25, 3), (6, 1), (3, 5), (1, 1)])
def test_clusters_equal_a_plain_agglomeration(spark, n, target):
    rng = np.random.default_rng(n)
    d = rng.uniform(0, 2, (n, n))
    d = (d + d.T) / 2
    groups = [[i] for i in range(n)]
    while len(groups) > target:
        _, i, j = min((np.mean([d[a, b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    name = lambda i: f"g{i:02d}"
    pairs = spark.createDataFrame([(name(i), name(j), float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a string, b string, distance double")
    got = {r["name"]: (r["cluster"], r["members"]) for r in models.clustered(pairs, spark.createDataFrame([(name(i),) for i in range(n)], "name string"), target).collect()}
    assert got == {name(i): (name(min(g)), len(g)) for g in groups for i in g}


def test_newton_equals_bisection_in_few_steps(spark):
    rng = np.random.default_rng(8)
    n = 3_000
    c, s, k = rng.integers(0, 2, n).astype(float), np.full(n, 100.0), rng.uniform(60, 150, n)
    t, v = rng.uniform(0.02, 2, n), rng.uniform(0.05, 1.5, n)
    r = np.full(n, 0.03)
    p = pricing._price(c, s, k, t, r, v)
    iv, moved, steps = pricing.solve(c, p, s, k, t, r)
    lo, hi = np.full(n, 0.01), np.full(n, 3.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = pricing._price(c, s, k, t, r, mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    good = np.isfinite(iv) & (moved <= pricing.UNCERTAIN)
    assert good.mean() > 0.5 and np.max(np.abs(iv - (lo + hi) / 2)[good]) < 1e-7
    assert np.mean(steps[good]) < 10
    rows = [(True, 0.5, 100.0, 130.0, 0.1), (True, None, 100.0, 100.0, 0.1), (False, 200.0, 100.0, 100.0, 0.1), (True, 5.0, 100.0, 100.0, 0.0), (True, 5.0, None, 100.0, 0.1), (True, 4.0, 100.0, 100.0, 0.1)]
    df = spark.createDataFrame(rows, "c boolean, p double, s double, k double, t double")
    got = [x["v"] for x in df.select(pricing.solved_volatility(F.col("c"), F.col("p"), F.col("s"), F.col("k"), F.col("t"), F.lit(0.0)).alias("v")).collect()]
    assert [g["iv"] is not None for g in got] == [True, False, False, False, False, True]


def test_means_of_cents_at_a_half(spark):
    """7360049.9999... in doubles is 7360050 by whole numbers: halves go up, whatever the order of the sum."""
    df = spark.createDataFrame([(73_600_500, 16), (1, 3), (0, 0), (200, 300)], "total long, w long")
    got = [r[0] for r in df.select(bars.exact_mean(F.col("total"), F.col("w")).alias("m")).collect()]
    assert got == [46_000.3125, 0.003333, None, 0.006667]
    assert spark.createDataFrame([(4_600_031_250_001, 1_000_000_000)], "total long, w long").select(bars.exact_mean(F.col("total"), F.col("w"))).first()[0] == 46.000313


def test_nets_fitted_together_equal_nets_fitted_alone(points):
    names = ["a", "b", "c"]
    both = models.quantile_nets(points, names, "target", [0.1, 0.9], rounds=3)
    for share, (_, w, losses) in zip([0.1, 0.9], both, strict=True):
        _, alone, alone_losses = models.quantile_net(points, names, "target", share, rounds=3)
        assert np.allclose(w, alone) and np.allclose(losses, alone_losses)


def test_features_are_computed_once_for_all_rounds(spark):
    from lodestream.plans import discovery

    train, test = discovery.parted(spark, "/root/testdata/sf0.001")
    for df in (train, test):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan
