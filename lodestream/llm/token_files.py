"""Token ids of documents in blocks of Simple-8b words, in files that Spark commits and reads.

A file is a Parquet part whose rows are blocks: the ids of a few documents in
ascending doc_id order, coded on their own, with the documents' ids and lengths, the
position of every 512th word, and the number of ids before the block in its shard.
So a block is decoded without its neighbours, and a lost task is written again whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import simple8b
from .shared import doc_column, doc_text, materialise, small_batches, tidily
from .tokens import ChunkEncoder, as_binary, slices

BLOCK_IDS = 65_536
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<int>, words binary, offsets binary, escapes binary"
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])


def write_token_file(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """Encodes, writes and reads back blocks. Shards are ranges of doc_id, in order; null ids come first."""

    def blocks(batches):
        encoder, shard = ChunkEncoder.open(tokenizer_path), TaskContext.get().partitionId()
        block = before = held = 0
        parts, doc_ids, lengths = [], [], []

        def row():
            joined = np.concatenate(parts)
            words, offsets, escapes = simple8b.encode(joined)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "before": before, "n_ids": len(joined), "doc_ids": doc_ids, "lengths": lengths, "words": words, "offsets": offsets, "escapes": escapes}], _BLOCKS)

        for batch in slices(batches):
            ids, counts = encoder.encode_with_end(batch.column("text"), end_id)
            done = at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                if held and held + n > BLOCK_IDS:
                    parts.append(ids[done:at])
                    yield row()
                    block, before, held, done = block + 1, before + held, 0, at
                    parts, doc_ids, lengths = [], [], []
                doc_ids.append(doc)
                lengths.append(n)
                held, at = held + n, at + n
            parts.append(ids[done:at])
        if doc_ids:
            yield row()

    small_batches(docs.sparkSession)
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(tidily(blocks), BLOCKS), "token-file")


def read_token_file(spark: SparkSession, file: DataFrame) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    totals = file.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each part file
    bases, base = [], 0
    for r in totals:
        bases.append((r["shard"], base))
        base += r["n"]
    placed = file.join(F.broadcast(spark.createDataFrame(bases, "shard int, base long")), "shard")
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ("doc_ids", "lengths", "words", "offsets", "escapes", "n_ids")}
                ids = simple8b.decode_by_offsets(r["words"], r["offsets"], r["escapes"], r["n_ids"]).astype(np.uint32)
                lengths = np.array(r["lengths"], np.int64)
                first = batch.column("base")[i].as_py() + batch.column("before")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(np.cumsum(lengths) - lengths + first), pa.array(lengths), as_binary(ids, lengths)], schema=fields)

    return placed.select("doc_ids", "lengths", "words", "offsets", "escapes", "n_ids", "before", "base").mapInArrow(tidily(documents), "doc_id long, start long, n_tokens long, ids binary")


def ids_between(row, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one block, decoding only the strides of words that hold them."""
    return simple8b.decode_range(row["words"], row["offsets"], row["escapes"], row["n_ids"], start, stop)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Writes the token file of ``docs`` and reads it back.

    A null or empty text has the end id alone. Rows equal in doc_id follow each other
    by text. An empty table gives an empty file; extra columns are ignored.
    """
    return read_token_file(spark, write_token_file(docs, tokenizer_path, end_id))


def digests(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
