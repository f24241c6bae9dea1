"""Packing of documents into sequences along a Hilbert curve through their hashed vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import doc_column, doc_text, materialise, small_batches, tidily
from .tokens import ChunkEncoder, as_binary, slices

DIMS = 4
BITS = 10
LENGTH = 2048


def directions(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A pseudo-random direction of +-1 for each id, by hashing the id."""
    x = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(7 * d + 1)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dims)], 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, dims) with coordinates of ``bits`` bits.

    Undoes, from the top bit down, the exchanges and inversions that the curve makes
    in each of its sub-cubes, then Gray-decodes and interleaves the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in reversed(range(1, bits)):
        q, low = 1 << bit, (1 << bit) - 1
        for d in range(dims):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in reversed(range(1, bits)):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(row, doc_id, n, ids, v0..) of each document: its ids with the end id, and its hashed vector."""
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())] + [(f"v{d}", pa.float32()) for d in range(DIMS)])

    def encoded(batches):
        encoder, row = ChunkEncoder.open(tokenizer_path), TaskContext.get().partitionId() << 36
        table = directions(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        for batch in slices(batches):
            ids, n = encoder.encode_with_end(batch.column("text"), end_id)
            vectors = np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column("doc_id"), pa.array(n), as_binary(ids, n), *[pa.array(vectors[:, d].astype(np.float32)) for d in range(DIMS)]], schema=fields)
            row += len(n)

    small_batches(docs.sparkSession)
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    return materialise(rows.mapInArrow(tidily(encoded), "row long, doc_id long, n long, ids binary, " + ", ".join(f"v{d} float" for d in range(DIMS))), "packing-tokens")


def along_curve(tokens: DataFrame) -> DataFrame:
    """(row, start): the number of ids that lie before each document along the curve."""
    spark = tokens.sparkSession
    stats = tokens.agg(*[f(f"v{d}").alias(f"{k}{d}") for d in range(DIMS) for k, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    mean = [stats[f"mean{d}"] or 0.0 for d in range(DIMS)]
    std = [stats[f"std{d}"] or 1.0 for d in range(DIMS)]

    def keyed(batches):
        for batch in batches:
            cells = []
            for d in range(DIMS):
                z = (batch.column(f"v{d}").to_numpy(zero_copy_only=False) - mean[d]) / std[d]
                share = 1 / (1 + np.exp(-1.702 * np.clip(z, -9, 9)))  # nearly the normal distribution's, so cells are used evenly
                cells.append(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(hilbert_key(np.stack(cells, 1)))], ["row", "n", "key"])

    def summed(batches):
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), shard, np.int32)), pa.array(ends - n), batch.column("n")], ["row", "shard", "before", "n"])
                before = int(ends[-1])

    # The key file is written, so that range bounds are drawn from the rows that are then dealt.
    keys = materialise(tokens.select("row", "n", *[f"v{d}" for d in range(DIMS)]).mapInArrow(tidily(keyed), "row long, n long, key long"), "packing-keys")
    order = materialise(keys.repartitionByRange("key", "row").sortWithinPartitions("key", "row").mapInArrow(tidily(summed), "row long, shard int, before long, n long"), "packing-order")
    bases, base = [], 0
    for r in order.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # a row for each part of the curve
        bases.append((r["shard"], base))
        base += r["n"]
    placed = order.join(F.broadcast(spark.createDataFrame(bases, "shard int, base long")), "shard")
    return placed.select("row", (F.col("base") + F.col("before")).alias("start_along"))


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, neighbours on the curve together.

    Documents follow each other along the curve without a gap and are cut where a
    sequence ends, so only the last sequence is padded. A null or empty text has the
    end id alone; repeated rows are documents of their own, told apart by ``row``; an
    empty table gives an empty result; extra columns are ignored. Returns per piece
    doc_id, row, start, length, ids, doc_tokens, sequence_id, offset.
    """
    tokens = write_tokens(docs, tokenizer_path, end_id)
    placed = tokens.select("row", "doc_id", "ids").join(along_curve(tokens), "row")
    fields = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pieces(batches):
        for batch in batches:
            out = []
            for doc, row, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "ids", "start_along")), strict=True):
                n, start = len(ids) // 4, 0
                while start < n:
                    offset = (at + start) % length
                    take = min(length - offset, n - start)
                    out.append((doc, row, start, take, ids[4 * start: 4 * (start + take)], n, (at + start) // length, offset))
                    start += take
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return placed.mapInArrow(tidily(pieces), "doc_id long, row long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padding(n_tokens: int, length: int = LENGTH) -> int:
    """Ids of padding in the last sequence: none where its length is a power of two."""
    rest = n_tokens % length
    return 0 if rest == 0 or math.log2(rest).is_integer() else length - rest


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
