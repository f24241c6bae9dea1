"""Passes over sorted series with a state that is carried from point to point.

A series is read in Arrow batches in its order, so a task holds one batch and one state,
however long the series is, and the work is linear in its points. One series runs in one
task: where a series has no end, ``by`` should name the session or the contract as well.
Steps that compose (``affine``) need no such care: each span of a series is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that a pass puts out.
OUT_ROWS = 10_000


def runs_of(batch: pa.RecordBatch, by: list[str]):
    """(key, first, end) of the stretches of ``batch`` that agree in ``by``."""
    if not batch.num_rows:
        return
    columns = [batch.column(c).to_pylist() for c in by]
    keys = list(zip(*columns, strict=True)) if by else list(repeat((), batch.num_rows))
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


def scan(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, outputs: str, end: Callable | None = None) -> DataFrame:
    """What ``step`` puts out for each point of each series: ``by`` and ``outputs``.

    ``start()`` gives the state before a series. ``step(state, *point)``, with the point's
    ``inputs``, gives the state after it and a list of rows; ``end(state)``, if given, the
    rows behind the last point. Points of equal ``order`` come in any order: name columns
    that tell them apart. A series without points gives nothing.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[c] for c in by))
    schema = f"{kinds}, {outputs}" if by else outputs
    fields = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    picked = list(dict.fromkeys([*by, *order, *inputs]))

    def run(batches):
        key = state = None
        begun = False
        out: list[tuple] = []

        def table():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        for batch in batches:
            points = list(zip(*(batch.column(c).to_pylist() for c in inputs), strict=True))
            for here, a, b in runs_of(batch, by):
                if here != key or not begun:
                    if begun and end:
                        out.extend((*key, *r) for r in end(state))
                    key, state, begun = here, start(), True
                for p in points[a:b]:
                    state, given = step(state, *p)
                    for r in given:
                        out.append((*key, *r))
                    if len(out) >= OUT_ROWS:
                        yield table()
        if begun and end:
            out.extend((*key, *r) for r in end(state))
        if out:
            yield table()

    sorted_ = rows.select(*picked).repartition(*by) if by else rows.select(*picked).coalesce(1)
    return sorted_.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def affine(rows: DataFrame, keep: list[str], maps: dict[str, tuple[Column, Column, Column]], order: str, span: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds y' = a * y + b along each series, for each name of ``maps`` with its (a, b, seed); ``keep`` are the columns kept.

    ``seed`` is read at the first point of a series and stands for y before it. The steps
    within ``span`` units of ``order`` compose to one pair (a, b), in a task a key and
    span. One pair a span is chained in a pass over its series; each span's points
    then run from its start. A point with a null coefficient is passed over, and
    where a is 0 the value before does not matter, even if it is null.
    """
    names = list(maps)
    steps = {}
    for n, (a, b, seed) in maps.items():
        known = a.isNotNull() & b.isNotNull()
        steps |= {f"_a_{n}": F.when(known, a).otherwise(1.0).cast("double"), f"_b_{n}": F.when(known, b).otherwise(0.0).cast("double"), f"_s_{n}": seed.cast("double")}
    points = rows.select(*by, order, *keep, F.floor(F.col(order) / span).alias("_span"), *[c.alias(k) for k, c in steps.items()])
    key = [*by, "_span"]
    width = len(names)

    def ends(points: DataFrame) -> DataFrame:
        """The pair of each span and the seed of its first point."""
        pairs = [f"_{part}_{n}" for n in names for part in "ab"]

        def step(state, *row):
            if state[0] is None:
                state[0] = row[2 * width:]
            for i in range(width):
                a, b = row[2 * i], row[2 * i + 1]
                state[2 * i + 1] *= a
                state[2 * i + 2] = a * state[2 * i + 2] + b
            return state, ()

        def start():
            return [None, *[1.0, 0.0] * width]

        columns = ", ".join([*[f"{p} double" for p in pairs], *[f"_s_{n} double" for n in names]])
        return scan(points, key, [order], [*pairs, *[f"_s_{n}" for n in names]], start, step, columns, end=lambda s: [(*s[1:], *s[0])])

    def chained(state, at, *row):
        seeds = row[2 * width:]
        before = state or list(seeds)
        after = []
        for i, y in enumerate(before):
            a, b = row[2 * i], row[2 * i + 1]
            after.append(b if a == 0 else None if y is None else a * y + b)
        return after, [(at, *before)]

    pairs = [f"_{part}_{n}" for n in names for part in "ab"]
    starts = scan(ends(points), list(by), ["_span"], ["_span", *pairs, *[f"_s_{n}" for n in names]], list, chained, "_at long, " + ", ".join(f"_y_{n} double" for n in names))
    rows_ = points.drop(*[f"_s_{n}" for n in names]).withColumn("_first", F.lit(1))
    both = starts.withColumnRenamed("_at", "_span").withColumn("_first", F.lit(0)).unionByName(rows_, allowMissingColumns=True)
    kinds = dict(rows_.dtypes)
    out_kinds = {**{c: kinds[c] for c in (*by, order, *keep)}, **dict.fromkeys(names, "double")}
    fields = to_arrow_schema(rows.sparkSession.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in out_kinds.items())).schema)
    kept = [*by, order, *keep]

    def run(batches):
        state = [None] * width
        for batch in batches:
            first = batch.column("_first").to_numpy() == 0
            starts = [batch.column(f"_y_{n}").to_pylist() for n in names]
            out = []
            for i, n in enumerate(names):
                y, given, values = state[i], starts[i], []
                for head, a, b, s in zip(first.tolist(), batch.column(f"_a_{n}").to_pylist(), batch.column(f"_b_{n}").to_pylist(), given, strict=True):
                    y = s if head else b if a == 0 else None if y is None else a * y + b
                    values.append(y)
                state[i] = y
                out.append(pa.array(values, pa.float64()))
            at = pa.array(np.flatnonzero(~first))
            yield pa.RecordBatch.from_arrays([c.take(at).cast(f.type) for c, f in zip([*[batch.column(k) for k in kept], *out], fields, strict=True)], schema=fields)

    return both.repartition(*key).sortWithinPartitions(*key, "_first", order).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in out_kinds.items()))
