"""Models fitted by sums over partitions, rules searched by counts of bits, resampling and clustering.

Rows never leave their tasks: each task puts out one array of sums, whose length the model
alone sets, Spark adds the arrays up and the driver takes a step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Series that one task clusters: a matrix of their distances is held.
MOST_SERIES = 4_000


def matrix_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def summed(rows: DataFrame, names: list[str], kernel: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of ``kernel`` (of a block of rows, an array of ``width``): a row a task, added up in Spark."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            total += kernel(matrix_of(batch, names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "value"])

    sums = rows.select(*[F.col(n).cast("double") for n in names]).mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(width)
    for r in sums.collect():  # ``width`` numbers
        out[r["place"]] = r["value"]
    return out


def scaling(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of each column; a column that never varies has deviation one."""
    r = rows.agg(*[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    mean, deviation = np.array(r[:len(names)], float), np.array(r[len(names):], float)
    return mean, np.where(deviation > 0, deviation, 1.0)


def standard(names: list[str], scale: tuple[np.ndarray, np.ndarray], limit: float = 4.0) -> list[Column]:
    """Each column in deviations from its mean, kept within ``limit``."""
    return [F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(n) - float(m)) / float(d))).alias(n) for n, m, d in zip(names, *scale, strict=True)]


def logistic(rows: DataFrame, names: list[str], label: str, ridge: float = 1e-3, settled: float = 1e-10) -> np.ndarray:
    """Coefficients, the constant last, by Newton's steps; each takes the gradient and the curvature from one pass.

    The penalty ``ridge`` makes the curvature positive, so a step whose loss does not fall is halved and the rounds end.
    """
    k = len(names) + 1
    columns = [*names, label]

    def loss_at(w: np.ndarray) -> np.ndarray:
        def kernel(m: np.ndarray) -> np.ndarray:
            x, y = np.hstack([m[:, :-1], np.ones((len(m), 1))]), m[:, -1]
            z = x @ w
            p = 1 / (1 + np.exp(-z))
            return np.concatenate([[np.sum(np.logaddexp(0, z) - y * z)], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        out = summed(rows, columns, kernel, 1 + k + k * k)
        return np.concatenate([[out[0] + ridge / 2 * w @ w], out[1:k + 1] + ridge * w, out[k + 1:] + (ridge * np.eye(k)).ravel()])

    w = np.zeros(k)
    now = loss_at(w)
    while True:
        step = np.linalg.solve(now[k + 1:].reshape(k, k), now[1:k + 1])
        if np.max(np.abs(step)) <= settled:
            return w
        size = 1.0
        while True:
            after = loss_at(w - size * step)
            if after[0] <= now[0] or size < 1e-6:
                break
            size /= 2
        w, now = w - size * step, after
        if size < 1e-6:
            return w


def logit(names: list[str], w: np.ndarray) -> Column:
    z = F.lit(float(w[-1]))
    for n, c in zip(names, w[:-1], strict=True):
        z = z + F.col(n) * float(c)
    return 1 / (1 + F.exp(-z))


class Net:
    """One hidden layer; its numbers are one array, so that gradients add up."""

    def __init__(self, inputs: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shape = (inputs, hidden)
        self.w = np.concatenate([rng.normal(0, 1 / np.sqrt(inputs), inputs * hidden), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)])

    def parts(self, w: np.ndarray):
        i, h = self.shape
        return w[:i * h].reshape(i, h), w[i * h:i * h + h], w[i * h + h:-1], w[-1]

    def run(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.parts(w)
        held = np.tanh(x @ a + b)
        return held @ c + d, held

    def gradient(self, w: np.ndarray, x: np.ndarray, held: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Of the weights, given that of each row's output."""
        _, _, c, _ = self.parts(w)
        back = slope[:, None] * c[None, :] * (1 - held * held)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), held.T @ slope, [slope.sum()]])


def descended(w: np.ndarray, loss: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int, rate: float = 0.05) -> tuple[np.ndarray, list[float]]:
    """(the weights of least loss, the loss of each round) of steps scaled by running moments of the gradient."""
    return descended_together([w], lambda ws: [loss(ws[0])], rounds, rate)[0]


def descended_together(ws: list[np.ndarray], losses: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], rounds: int, rate: float = 0.05) -> list[tuple[np.ndarray, list[float]]]:
    """The same for several models, each with its own steps, whose losses come from one call a round."""
    m, v = ([np.zeros_like(w) for w in ws] for _ in "mv")
    now, best, seen = list(ws), list(ws), [[] for _ in ws]
    for i in range(1, rounds + 1):
        for k, (loss, g) in enumerate(losses(now)):
            if not seen[k] or loss < min(seen[k]):
                best[k] = now[k]
            seen[k].append(loss)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            now[k] = now[k] - rate * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-8)
    return list(zip(best, seen, strict=True))


def quantile_nets(rows: DataFrame, names: list[str], target: str, shares: list[float], hidden: int = 8, rounds: int = 40, seed: int = 7) -> list[tuple[Net, np.ndarray, list[float]]]:
    """For each of ``shares`` a net for that quantile of ``target``, by the mean pinball loss over all rows.

    A round is one pass over ``rows`` whatever the number of nets; they are read as often
    as there are rounds, so what is costly to compute is written first.
    """
    n = max(1, rows.count())
    nets = [Net(len(names), hidden, seed) for _ in shares]
    width = 1 + len(nets[0].w)

    def losses(ws: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def kernel(m: np.ndarray) -> np.ndarray:
            x, y = m[:, :-1], m[:, -1]
            out = []
            for net, w, share in zip(nets, ws, shares, strict=True):
                value, held = net.run(w, x)
                off = y - value
                out += [[np.sum(np.maximum(share * off, (share - 1) * off))], net.gradient(w, x, held, np.where(off >= 0, -share, 1 - share))]
            return np.concatenate(out)

        s = summed(rows, [*names, target], kernel, width * len(nets)).reshape(len(nets), width)
        return [(v[0] / n, v[1:] / n) for v in s]

    return [(net, *fit) for net, fit in zip(nets, descended_together([net.w for net in nets], losses, rounds), strict=True)]


def quantile_net(rows: DataFrame, names: list[str], target: str, share: float, hidden: int = 8, rounds: int = 40, seed: int = 7) -> tuple[Net, np.ndarray, list[float]]:
    """A net for the ``share`` quantile of ``target``, by the mean pinball loss over all rows."""
    return quantile_nets(rows, names, target, [share], hidden, rounds, seed)[0]


def listwise_net(rows: DataFrame, group: str, names: list[str], gain: str, hidden: int = 8, rounds: int = 40, seed: int = 7) -> tuple[Net, np.ndarray, list[float]]:
    """A net whose scores within a group, as shares by softmax, come near to the shares of ``gain``; ``group`` is a number.

    A group's rows, few as they are the names of one day, lie in one task and in order.
    """
    net = Net(len(names), hidden, seed)
    laid = rows.select(F.col(group).cast("double").alias(group), *names, gain).repartition(group).sortWithinPartitions(group)
    n = max(1, rows.select(group).distinct().count())
    columns = [group, *names, gain]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def each(m: np.ndarray) -> np.ndarray:
            first = np.flatnonzero(np.r_[True, m[1:, 0] != m[:-1, 0]])
            size = np.diff(np.r_[first, len(m)])
            out, held = net.run(w, m[:, 1:-1])
            top = np.repeat(np.maximum.reduceat(out, first), size)
            e = np.exp(out - top)
            p = e / np.repeat(np.add.reduceat(e, first), size)
            total = np.repeat(np.add.reduceat(m[:, -1], first), size)
            q = np.where(total > 0, m[:, -1] / np.where(total > 0, total, 1), 0.0)
            slope = np.where(total > 0, p, 0.0) - q
            return np.concatenate([[-np.sum(q * np.log(np.maximum(p, 1e-300)))], net.gradient(w, m[:, 1:-1], held, slope)])

        def partial(batches):
            total, rest = np.zeros(1 + len(net.w)), np.zeros((0, len(columns)))
            for batch in batches:
                m = np.vstack([rest, matrix_of(batch, columns)])
                cut = np.searchsorted(m[:, 0], m[-1, 0]) if len(m) else 0  # the last group may go on
                if cut:
                    total += each(m[:cut])
                rest = m[cut:]
            if len(rest):
                total += each(rest)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

        s = np.zeros(1 + len(net.w))
        for r in laid.mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            s[r["place"]] = r["value"]
        return s[0] / n, s[1:] / n

    return net, *descended(net.w, loss, rounds)


def scored(rows: DataFrame, net: Net, w: np.ndarray, names: list[str], out: str) -> DataFrame:
    """``rows`` with the net's value in column ``out``, batch by batch."""
    i = len(rows.columns)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], pa.array(net.run(w, matrix_of(batch, names))[0])], [*batch.schema.names[:i], out])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, {out} double")


def cuts(rows: DataFrame, names: list[str], shares: tuple[float, ...]) -> list[tuple[str, str, float]]:
    """(feature, op, threshold): both sides of each of ``rows``' quantiles, a value that is there, each once."""
    ordered = lambda n: F.array_sort(F.array_distinct(F.array(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {n})") for q in shares])))
    exact = rows.agg(*[ordered(n).alias(n) for n in names]).first()
    return [(n, op, float(t)) for n in names for t in exact[n] or () if t is not None for op in (">=", "<=")]


def rules(train: DataFrame, test: DataFrame, names: list[str], gain: str, shares: tuple[float, ...] = (0.2, 0.35, 0.5, 0.65, 0.8), least: int = 12, most: int = 20) -> DataFrame:
    """The ``most`` rules, of one or two conditions, whose mean ``gain`` in ``train`` times the root of their rows is greatest.

    Conditions are the cuts of ``train``. Each row is a row of bits, one a condition, so
    counts and sums of all pairs of conditions are two products of matrices a task.
    ``gain`` is whole, so sums are exact. ``test`` has no say in what is chosen. Returns place, feature, op,
    threshold (and the second condition's or null), n_train, mean_train, score, n_test, mean_test.
    """
    found = cuts(train, names, shares)
    k = len(found)
    at = np.array([t for *_, t in found])
    upward = np.array([op == ">=" for _, op, _ in found])
    column = np.array([names.index(n) for n, *_ in found], int)

    def kernel(m: np.ndarray) -> np.ndarray:
        x = m[:, column] if k else np.zeros((len(m), 0))
        with np.errstate(invalid="ignore"):
            bits = np.where(upward, x >= at, x <= at).astype(float)  # a null is on neither side
        return np.concatenate([(bits.T @ bits).ravel(), (bits.T @ (bits * m[:, -1:])).ravel()])

    here, there = ([a.reshape(k, k) for a in np.split(summed(df, [*names, gain], kernel, 2 * k * k), 2)] for df in (train, test))
    out = []
    for i in range(k):
        for j in range(i, k):
            if i != j and column[i] == column[j] or here[0][i, j] < least or here[1][i, j] <= 0:
                continue
            mean = here[1][i, j] / here[0][i, j]
            out.append((-mean * np.sqrt(here[0][i, j]), i, j))
    out = sorted(out)[:most]
    rows = []
    for place, (score, i, j) in enumerate(out, 1):
        second = found[j] if i != j else (None, None, None)
        n, m = int(here[0][i, j]), int(there[0][i, j])
        rows.append((place, *found[i], *second, n, float(here[1][i, j] / n), float(-score), m, float(there[1][i, j] / m) if m else None))
    return train.sparkSession.createDataFrame(rows, "place int, feature string, op string, threshold double, feature2 string, op2 string, threshold2 double, n_train long, mean_train double, score double, n_test long, mean_test double")


def bootstrap(values: DataFrame, by: list[str], value: str, block: str, draws: int = 500, seed: str = "days", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, blocks, mean, low, high): the interval of the mean of ``value`` over ``draws`` resamples of whole blocks.

    ``values`` has a row per block (a day). Draw k of resample r takes the block at the place that the hash of
    seed, r and k gives, so the same seed gives the same interval anywhere. Resampled
    rows are sums by (by, r) at once; a group's interval needs its ``draws`` means only.
    """
    numbered = values.select(*by, block, F.col(value).cast("double").alias("_v"))
    numbered = numbered.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(block)) - 1)
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), F.avg("_v").alias("mean"))
    drawn = sizes.select(*by, "blocks", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_r")).select(*by, "blocks", "_r", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("_k"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_r", "_k")), 1, 12), 16, 10).cast("long")
    drawn = drawn.select(*by, "_r", (hashed % F.col("blocks")).cast("int").alias("_i"))
    weights = drawn.groupBy(*by, "_r", "_i").agg(F.count(F.lit(1)).alias("_w"))  # a resample as weights of the blocks it holds
    means = weights.join(numbered, [*by, "_i"]).groupBy(*by, "_r").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_m"))
    ends = means.groupBy(*by).agg(F.percentile("_m", F.lit(low)).alias("low"), F.percentile("_m", F.lit(high)).alias("high"))
    return sizes.join(ends, by)


def correlations(series: DataFrame, name: str, at: str, value: str, least: int = 10) -> DataFrame:
    """(a, b, distance): one less the correlation of two series where both have values, 1 with fewer than ``least`` in common; a < b."""
    one, other = (series.select(at, F.col(name).alias(s), F.col(value).alias(f"_{s}")).where(f"_{s} is not null") for s in "ab")
    both = one.join(other, at).where("a < b").groupBy("a", "b").agg(F.corr("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") >= least, 1 - F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).otherwise(1.0).alias("distance"))


def agglomerated(distance: np.ndarray, target: int) -> np.ndarray:
    """Labels of ``target`` clusters (or as many as there are) by average linkage: chains of nearest neighbours, then the lowest joins.

    A chain goes from a cluster to its nearest until two are each other's nearest and join.
    Average linkage joins in any such order to the same tree, in time of the square of
    the series.
    """
    n = len(distance)
    if n <= target:
        return np.arange(n)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    joins, chain = [], []
    while len(joins) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        row = np.where(alive, d[top], np.inf)
        row[top] = np.inf
        near = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
            joins.append((row[near], min(top, near), max(top, near)))
            a, b = min(top, near), max(top, near)
            merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
            d[a], d[:, a] = merged, merged
            d[a, a] = np.inf
            size[a], alive[b] = size[a] + size[b], False
            del chain[-2:]
        else:
            chain.append(near)
    label = np.arange(n)
    # The lowest joins first; one below another in the tree is never higher.
    for _, a, b in sorted(joins, key=lambda j: j[0])[:n - target]:
        label[label == label[b]] = label[a]
    return label


def clustered(pairs: DataFrame, names: DataFrame, target: int = 20) -> DataFrame:
    """(name, cluster, members): clusters by average linkage over ``pairs`` (a, b, distance), called by their first member in order.

    ``names`` (name) has a row per series, of which there may be MOST_SERIES: their matrix
    goes to one task. Series that share no time are at distance one.
    """
    n = names.count()
    if n > MOST_SERIES:
        raise ValueError(f"{n} series; a matrix of at most {MOST_SERIES} is clustered")
    rows = pairs.unionByName(names.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("distance")))

    def run(batches):
        a, b, x = [], [], []
        for batch in batches:
            a, b, x = a + batch.column("a").to_pylist(), b + batch.column("b").to_pylist(), x + batch.column("distance").to_pylist()
        if not a:
            return
        order = sorted(set(a) | set(b))
        at = {v: i for i, v in enumerate(order)}
        d = np.ones((len(order), len(order)))
        i, j = np.array([at[v] for v in a]), np.array([at[v] for v in b])
        d[i, j] = d[j, i] = x
        label = agglomerated(d, target)
        first = {v: order[int(np.flatnonzero(label == v)[0])] for v in set(label.tolist())}
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array([first[v] for v in label.tolist()]), pa.array([int((label == v).sum()) for v in label.tolist()], pa.int64())], ["name", "cluster", "members"])

    kind = dict(names.dtypes)["name"]
    return rows.coalesce(1).mapInArrow(run, f"name {kind}, cluster {kind}, members long")
