"""Helpers that several operators use: the shared folder, and order without a global sort."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in this one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="lodestream-")
        _OWN[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables that ``materialise`` wrote within it; what reads them has to be written by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], held: str, total: int, most: int = 20_000) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and, in ``held``, how many of the ``total`` rows have it.

    Keys with more than a ``most``-th of all rows are fewer than ``most``: that part of the
    table is broadcast, so that no key's rows meet in one task. The others join by shuffle.
    """
    hot = F.broadcast(table.where(F.col(held) > total / most))
    cold = table.where(F.col(held) <= total / most)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation, and fixes rows that a retry might number differently.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestream/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> None:
    """Bounds what a Python worker holds of its input at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns the memory that this process has freed to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidily(f, seconds: float = 1.0):
    """``f`` over batches; the worker gives back the memory it has freed between batches, every few ``seconds``, and at the end: workers live on from stage to stage."""

    def spaced(batches):
        last = time.monotonic()
        for batch in batches:
            yield batch
            if time.monotonic() - last > seconds:
                give_back()
                last = time.monotonic()

    def run(batches):
        try:
            yield from f(spaced(batches))
        finally:
            gc.collect()
            give_back()

    return run


def doc_column(docs: DataFrame, name: str, kind: str) -> Column:
    """A column of ``docs`` cast to ``kind``, or null where the table lacks it."""
    return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)


def doc_text(docs: DataFrame) -> Column:
    return F.coalesce(doc_column(docs, "text", "string"), F.lit(""))


def cut_points(df: DataFrame, column: str, rows_each: int, most: int = 20_000) -> list[int]:
    """At most ``most`` values that split ``column`` into ranges of about ``rows_each`` rows."""
    n = df.count()
    parts = max(1, min(most, -(-n // rows_each)))
    if parts == 1:
        return []
    shares = F.lit(np.arange(1, parts) / parts)
    accuracy = max(10_000, 20 * parts)
    row = df.agg(F.percentile_approx(F.col(column), shares, accuracy).alias("p")).first()
    return sorted(set(row["p"] or []))
