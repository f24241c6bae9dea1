"""Bottom-k sketches of word-shingle hashes; DataFrame operations only.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a
text's 5-word shingles. Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and the number of shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import cut_points, doc_column, doc_text

SIZE = 128
WORDS = 5
#: Hashes are signed 64-bit numbers; this maps one to its place in (0, 1].
LOWEST, SPAN = float(-(2**63)), float(2**64)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles of ``words`` words; with fewer words, of the whole sequence; without words, none."""
    tokens = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(h) - (words - 1))
        several = F.transform(at, lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)]))
        return F.when(F.size(h) >= words, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(h)

    return _with(F.transform(tokens, lambda w: F.xxhash64(w)), shingles)


def _with(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, k: int = SIZE, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, by: list[str], column: str = "fingerprint", k: int = SIZE, ways: int = 64) -> DataFrame:
    """The sketch of each group's parts together: a group's parts are first merged in ``ways`` lots, so none meets in one task."""
    hashes = sketches.select(*by, F.explode(column).alias("hash")).distinct()
    lot = hashes.withColumn("lot", F.pmod(F.xxhash64("hash"), F.lit(ways)))
    least = lambda df, keys: df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("hash"))).where(F.col("nth") <= k)
    few = least(lot, [*by, "lot"])
    return least(few.drop("nth"), by).groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the shingles of either text that both have; two empty sketches are alike."""
    share = lambda both: F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_with(merge(a, b, k), share))


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    place = (F.element_at(a, -1).cast("double") - F.lit(LOWEST)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 0 for an empty ``a``."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def with_next(rows: DataFrame, key: str, columns: list[str], rows_each: int = 2_000) -> DataFrame:
    """Adds ``next_<c>`` for each of ``columns``: that column in the row with the next ``key``; after the last, in the first.

    No task sees all rows: the keys are cut into ranges of about ``rows_each`` rows, and
    each range gets the first row of the range that follows as a guest. What the driver
    holds is two numbers for each range. Equal keys follow each other in an order by
    ``columns``; null keys come before all others.
    """
    cuts = cut_points(rows.select(key), key, rows_each)
    place = F.lit(0)
    if cuts:
        place = F.when(F.col(key).isNull(), F.lit(0)).otherwise(_place(F.lit(np.array(cuts)), F.col(key), len(cuts)))
    ranged = rows.withColumn("_range", place.cast("int")).withColumn("_guest", F.lit(0))
    order = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns]]
    # One row a range: the range before it, which gets its first row.
    ranges = ranged.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("head"))).alias("least"))
    ranges = ranges.select("_range", F.col("least.head").alias("_head"), F.lag("_range").over(W.orderBy("_range")).alias("_before"), F.max("_range").over(W.partitionBy(F.lit(0))).alias("_last"))
    ranges = F.broadcast(ranges.select("_range", "_head", F.coalesce("_before", "_last").alias("_before")))
    first = (
        ranged.join(ranges, "_range").where(F.col(key).eqNullSafe(F.col("_head")))
        .withColumn("_nth", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
        .where("_nth = 1")
        .withColumn("_range", F.col("_before"))
        .withColumn("_guest", F.lit(1))
        .drop("_nth", "_before", "_head")
    )
    along = W.partitionBy("_range").orderBy("_guest", *order)
    return (
        ranged.unionByName(first)
        .withColumns({f"next_{c}": F.lead(c).over(along) for c in columns})
        .where("_guest = 0")
        .drop("_guest", "_range")
    )


def _place(cuts: Column, value: Column, n: int) -> Column:
    """How many of the ascending ``cuts``, ``n`` of them, are at most ``value``, by halving.

    The steps are folded and not nested in one another, and the cuts are one literal:
    the expression stays as small as it is however many cuts there are.
    """
    steps = F.lit(np.array([1 << bit for bit in reversed(range(n.bit_length()))], np.int32))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(F.lit(0)))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many first ones, or all, of ``following``."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - cut), F.left(following, cut))


def as_text(fingerprint: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, 16 digits each, joined."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(spark: SparkSession, docs: DataFrame, k: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document.

    A null text counts as empty; an empty text has an empty sketch, alike to another
    empty one and unlike any other. Repeated rows follow each other as documents of
    their own. An empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    rows = rows.withColumn("fingerprint", sketch(F.col("text"), k))
    rows = with_next(rows, "doc_id", ["text", "fingerprint"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        sketch(F.col("edited"), k).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        resemblance(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"),
        distinct_shingles(F.col("fingerprint"), k).alias("n_shingles"),
    )
