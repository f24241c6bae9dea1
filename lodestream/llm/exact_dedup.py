"""Exact duplicates by an extendible-hash index on shared files; DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import doc_column, doc_text, fresh_names, materialise

#: Keys of a bucket before it splits, and bits by which slots are counted finer when they don't suffice.
BUCKET_KEYS, FINER = 4_000, 4
HOT_SHARE = 1_000
#: A directory of so many bits at most is sent to all tasks.
SENT_BITS = 18


def normalised(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; ``lower`` does the same to ASCII, many times as fast."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """The directory of an extendible-hash index over the distinct 64-bit ``key`` of ``keys``: (slot, bucket, depth), and its bits.

    It begins with one bucket. As long as one holds over ``bucket_keys`` keys the directory
    doubles: buckets that are too full split by one more leading bit, the others keep their
    slots together. A slot is the first ``bits`` bits of a key, a bucket goes by its first
    slot. Slots are counted from the keys once, and anew with more bits where one slot alone
    is still too full. Equal keys cannot be split and chain in one bucket, so keys count once.
    """
    keys = materialise(keys.select("key").distinct(), "index-keys")
    bits = max(1, (keys.count() // bucket_keys).bit_length() + 1)
    while True:
        slot = F.shiftrightunsigned("key", 64 - bits)
        slots = materialise(keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("depth")), "index-slots")
        while True:
            named = slots.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {bits} - depth), {bits} - depth)"))
            full = named.groupBy("bucket", "depth").agg(F.sum("n").alias("held")).where(F.col("held") > bucket_keys)
            splits = materialise(full.where(F.col("depth") < bits).select("bucket", "depth"), "index-splits")
            if splits.isEmpty():
                break
            slots = materialise(named.join(splits.withColumn("more", F.lit(1)), ["bucket", "depth"], "left").select("slot", "n", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "index-slots")
        if full.isEmpty() or bits + FINER > 62:
            return named.select("slot", "bucket", "depth"), bits
        bits += FINER


def routed(rows: DataFrame, slots: DataFrame, bits: int, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the bucket that the directory names for their ``key``.

    The directory is sent to all tasks while it is small. Beyond that rows go to their
    slot; those of the few ``hot`` keys don't, but get their buckets as a table of those keys.
    """
    at = lambda df: df.withColumn("slot", F.shiftrightunsigned("key", 64 - bits))
    places = slots.select("slot", "bucket")
    if bits <= SENT_BITS:
        return at(rows).join(F.broadcast(places), "slot").drop("slot")
    if hot is None:
        return at(rows).join(places, "slot").drop("slot")
    keys = F.broadcast(hot.select("key").distinct())
    hot_places = materialise(at(hot.select("key").distinct()).join(places, "slot").select("key", "bucket"), "hot-buckets")
    cold = at(rows.join(keys, "key", "left_anti")).join(places, "slot").drop("slot")
    return cold.unionByName(rows.join(F.broadcast(hot_places), "key"))


def build_index(docs: DataFrame, hot: DataFrame | None, slots: DataFrame, bits: int) -> DataFrame:
    """Writes and reads back the index (bucket, key, digest, keep_id, group_size): one row per distinct normalised text.

    Rows go to the owner task of their bucket, a range of keys. There texts of one key
    chain, and those whose whole bytes are equal become one entry. Groups of very many
    copies (``hot``, by key) are combined where they lie before anything is sent.
    """
    text = normalised(doc_text(docs))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("norm"), doc_column(docs, "doc_id", "long").alias("doc_id"))
    chained = lambda df: df.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    if hot is None:
        entries = chained(routed(rows, slots, bits).repartition("bucket"))
    else:
        keys = F.broadcast(hot.select("key").distinct())
        owned = chained(routed(rows.join(keys, "key", "left_anti"), slots, bits).repartition("bucket"))
        entries = owned.unionByName(chained(routed(rows.join(keys, "key", "left_semi"), slots, bits, hot)))
    return materialise(entries.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size"), "exact-index")


def exact_dedup(spark: SparkSession, docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: which texts are equal and which row stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty and an empty text is a text like others. Of equal texts the row with the
    largest doc_id stays; of rows equal in doc_id and text one stays; null ids
    rank below all others. An empty table gives an empty result, and extra columns
    are ignored. Returns doc_id, keep_id, group_size, kept, text_sha256, bucket.
    """
    text = normalised(doc_text(docs))
    key_file = materialise(
        docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "exact-keys",
    )
    # At most HOT_SHARE groups can hold more than n / HOT_SHARE rows each, so this table is bounded.
    hot_from = max(50, key_file.count() // HOT_SHARE)
    hot = materialise(key_file.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot_from), "hot-groups")
    hot = None if hot.isEmpty() else hot
    slots, bits = directory(key_file, bucket_keys)
    index = build_index(docs, hot, slots, bits)
    entry = ["bucket", "key", "digest"]
    sought = routed(key_file, slots, bits, hot)
    if hot is None:
        found = sought.join(index, entry)
    else:
        many, few = index.where(F.col("group_size") > hot_from), index.where(F.col("group_size") <= hot_from)
        found = sought.join(F.broadcast(many), entry).unionByName(sought.join(F.broadcast(many.select(*entry)), entry, "left_anti").join(few, entry))
    found = materialise(found.withColumn("best", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "exact-found")
    # Rows equal in doc_id and text, of which the first written stays; most tables have none.
    twins = materialise(found.where("best").groupBy("key", "digest").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first")).where(F.col("rows") > 1).drop("rows"), "exact-twins")
    n = twins.count()
    if n:
        found = found.join(F.broadcast(twins) if n <= 100_000 else twins, ["key", "digest"], "left").withColumn("best", F.col("best") & (F.col("first").isNull() | (F.col("first") == F.col("row"))))
    return found.select("doc_id", "keep_id", "group_size", F.col("best").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with; of rows equal in doc_id and text, one."""
    judged = materialise(exact_dedup(spark, docs).select("doc_id", "keep_id", "kept", F.unhex("text_sha256").alias("digest")), "exact-judged")
    gone, gone_digest, digest, own = fresh_names(docs, "_gone", "_gone_digest", "_digest", "_own")
    dropped = judged.where("not kept").select(F.col("doc_id").alias(gone), F.col("digest").alias(gone_digest), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("twin"))
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(doc_text(docs)), 256))).withColumn(own, doc_column(docs, "doc_id", "long"))
    same = F.col(own).eqNullSafe(F.col(gone)) & (F.col(digest) == F.col(gone_digest))
    kept = marked.join(dropped.where("not twin").drop("twin").distinct(), same, "left_anti")
    if not dropped.where("twin").isEmpty():
        kept = kept.dropDuplicates([own, digest])
    return kept.select(*docs.columns)
