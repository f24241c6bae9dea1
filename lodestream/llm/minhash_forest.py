"""Near duplicates by an LSH forest: sorted orders of MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .components import components
from .shared import doc_column, doc_text, fresh_names, join_counted, materialise, small_batches, tidily
from .shingles import mix, shingle_sets
from .tokens import batched_texts

TREES, DEPTH = 16, 4
#: Depth at which two signatures become neighbours at all; a pair of similarity 0.75 shares it in some tree but for 2 in a million.
FROM_DEPTH = 2
#: A region with more documents is told apart by one more value of the signature.
REGION = 1_000
#: Documents compared with one other in one run.
LOT = 64
#: Signature values, of TREES * DEPTH, that a document must share with other components to be compared once more.
#: Two documents of similarity 0.75 share fewer of 64 in two cases of a hundred million.
SHARED_VALUES = 28
#: Shingles of a block of a crowd; a document weighs LEAST_WEIGHT at least, so that a block has 1,000 documents at most.
BLOCK, LEAST_WEIGHT = 500_000, 500
#: Columns of a block with so many documents are multiplied as a dense matrix, DENSE of them at once; others pair by pair.
HEAVY, DENSE = 24, 2_048
#: Units of a crowd with so few documents are compared all with all, so that the same one of another crowd is known.
SMALL_UNIT = 64
#: Below so many candidates their ids are broadcast (8 bytes each), beyond it they are joined.
BROADCAST_IDS = 500_000
THRESHOLD = 75


def signatures(docs: DataFrame, words: int = 5, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(id, n, set_a, set_b, sig, sketch): set size, 128 bits that tell sets apart, the signature of each document, and a byte of each of its values."""
    k = trees * depth
    rng = np.random.default_rng(20_241)
    flips, factors = rng.integers(0, 1 << 63, k, dtype=np.uint64), rng.integers(0, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    fields = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def signed(batches):
        for batch, texts in batched_texts(batches, 1_000_000):
            sets = shingle_sets(texts, words)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            rows = np.zeros((len(sets), k), np.uint64)
            a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                joined = np.concatenate([sets[i] for i in full])
                first = np.cumsum(n[full]) - n[full]
                for j in range(k):
                    rows[full, j] = np.minimum.reduceat((joined ^ flips[j]) * factors[j], first)
                a[full] = np.add.reduceat(mix(joined), first)
                b[full] = np.add.reduceat(mix(joined ^ flips[0]) * (joined | np.uint64(1)), first)
            offsets = pa.array(np.arange(0, (len(sets) + 1) * k, k, dtype=np.int32))
            sketches = pa.array([r.tobytes() for r in (rows >> np.uint64(24)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(rows.view(np.int64).ravel())), sketches], schema=fields)

    small_batches(docs.sparkSession)
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("id"), doc_text(docs).alias("text"))
    return materialise(rows.mapInArrow(tidily(signed), "id long, n long, set_a long, set_b long, sig array<long>, sketch binary"), "signatures")


def candidates(reps: DataFrame, trees: int = TREES, depth: int = DEPTH, from_depth: int = FROM_DEPTH, region: int = REGION) -> DataFrame:
    """(a, b, votes): neighbours in the sorted orders, a < b, with the number of times they met.

    In each tree documents are sorted by their values. A region holds those that share
    a prefix: of ``from_depth`` values, and of one more for as long as it holds over
    ``region`` documents. Within its region a document meets the two before it in order,
    which share the longest prefixes, and the least document of each prefix that it
    shares, so that the number of pairs follows the number of documents. A region that
    is still too large at full depth is dealt out by hash; its least document is met
    there, too.
    """
    values = [f"v{d}" for d in range(depth)]
    t = reps.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.slice("sig", i * depth + 1, depth))).alias("tree", "part"))
    t = t.select("id", "tree", *[F.element_at("part", d + 1).alias(v) for d, v in enumerate(values)])
    t = t.withColumns({"lot": F.lit(0), "deep": F.lit(from_depth)})
    meets = []
    for d in range(from_depth, depth + 1):
        key = ["tree", *values[:d]]
        # Each region counted here has over ``region`` rows, so few of all are listed; they are joined by broadcast only while small.
        crowded = t.where(F.col("deep") == d).groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("least")).where(F.col("held") > region)
        crowded = materialise(crowded, "crowded-regions")
        n = crowded.count()
        if not n:
            break
        t = t.join(F.broadcast(crowded) if n <= 100_000 else crowded, key, "left")
        meets.append(t.where("held is not null and least < id").select(F.col("least").alias("a"), F.col("id").alias("b")))
        more = F.col("held").isNotNull() & (F.col("deep") == d)
        t = t.withColumns({"lot": F.when(more & F.lit(d == depth), F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / region))).otherwise(F.col("lot")).cast("int"), "deep": F.when(more, F.lit(d + 1)).otherwise(F.col("deep"))}).drop("held", "least")
    place = F.xxhash64(*[F.when(F.col("deep") > d, F.col(v)) for d, v in enumerate(values)], "lot")
    t = t.withColumn("place", place)
    order = [*values[from_depth:], "id"]
    along = W.partitionBy("tree", "place").orderBy(*order)
    least = lambda d: F.min("id").over(W.partitionBy("tree", "place", *values[:d]))
    near = t.withColumns({"p1": F.lag("id", 1).over(along), "p2": F.lag("id", 2).over(along)} | {f"l{d}": least(d) for d in range(from_depth, depth + 1)})
    met = F.array_distinct(F.array("p1", "p2", *[f"l{d}" for d in range(from_depth, depth + 1)]))
    near = near.select("id", F.explode(met).alias("other")).where("other is not null and other != id")
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    for m in meets:
        pairs = pairs.unionByName(m)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


def dealt_runs(dealt: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, lot, b, ``value``): for each (a, lot) of ``dealt`` a's value, with b null, and behind it those of all its b."""
    one = table.select("id", value)
    heads = dealt.select("a", "lot").distinct().join(one, F.col("a") == F.col("id")).select("a", "lot", F.lit(None).cast("long").alias("b"), value)
    tails = dealt.join(one, F.col("b") == F.col("id")).select("a", "lot", "b", value)
    return heads.unionByName(tails).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())


def sketches_of(batch: pa.RecordBatch) -> np.ndarray:
    """A row of bytes for each row of ``batch``."""
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def confirmed(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, words: int = 5, threshold: int = THRESHOLD, lot: int = LOT, least: int = SHARED_VALUES) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have ``100 * intersection >= threshold * union``.

    The sketches of all b go to their a, ``lot`` or so in a run behind a's, and so do the
    texts of those that share ``least`` bytes of it. A task holds one set and a batch of
    texts, and a document that very many are compared with is repeated, not a hot key.
    """
    pairs = materialise(pairs.select("a", "b"), "pairs")
    runs = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("held")), "runs")
    dealt = join_counted(pairs, runs, ["a"], "held", pairs.count())
    dealt = materialise(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("held") / lot)).alias("lot")), "compared-pairs")

    def sketched(batches):
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, heads = sketches_of(batch), batch.column("b").is_null().to_numpy(zero_copy_only=False)
            at = np.cumsum(heads)  # 0: the head of the batch before
            firsts = np.concatenate([rows[:1] if head is None else head, rows[heads]])
            near = ~heads & ((rows == firsts[at]).sum(1) >= least)
            head = firsts[-1:].copy()
            yield batch.filter(pa.array(near)).select(["a", "b", "lot"])

    dealt = materialise(dealt_runs(dealt, sketches, "sketch").mapInArrow(tidily(sketched), "a long, b long, lot long"), "pairs-alike")
    ids = materialise(dealt.select(F.col("a").alias("id")).unionByName(dealt.select(F.col("b").alias("id"))).distinct(), "ids-alike")
    rows = dealt_runs(dealt, only(texts, ids), "text")

    def compared(batches):
        head = None
        for batch, texts in batched_texts(batches, 1_000_000):
            out = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(texts, words), strict=True):
                if b is None:
                    head = s
                else:
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if both and 100 * both >= threshold * (len(head) + len(s) - both):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.mapInArrow(tidily(compared), "a long, b long").distinct()


def alike_elsewhere(reps: DataFrame, at: DataFrame, trees: int = TREES, depth: int = DEPTH, from_depth: int = FROM_DEPTH, least: int = SHARED_VALUES) -> DataFrame:
    """(id, component, n, places, sketch): documents that can still be linked with one of another component (``at``: node, component).

    Such a document shares ``from_depth`` values of a tree with another component, and
    ``least`` single values of its signature. ``places`` are the trees' prefixes that other components share.
    """
    key = lambda i, width: F.xxhash64(i, F.slice("sig", i * width + 1, width if width == 1 else from_depth))

    def met(docs: DataFrame, keys: Column, name: str) -> DataFrame:
        """(id, component, key): the keys of ``docs`` that lie in two components or more."""
        t = materialise(docs.select("id", "component", F.explode(keys).alias("key")), name)
        shared = t.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
        shared = materialise(shared.where("low != high").select("key", "held"), f"{name}-shared")
        if shared.count() <= BROADCAST_IDS:
            return t.join(F.broadcast(shared), "key")
        return join_counted(t, shared, ["key"], "held", t.count())

    at = F.broadcast(at) if at.count() <= BROADCAST_IDS else at
    placed = reps.select("id", "n", "sig", "sketch").join(at, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("component"), "sig", "sketch")
    by_tree = met(placed, F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: key(i, depth)), "tree-places")
    by_tree = materialise(by_tree.groupBy("id").agg(F.collect_list("key").alias("places")), "crowd-documents")
    placed = materialise(only(placed, by_tree).join(by_tree, "id"), "crowd-signatures")
    by_value = met(placed, F.transform(F.sequence(F.lit(0), F.lit(trees * depth - 1)), lambda i: key(i, 1)), "value-places")
    enough = by_value.groupBy("id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("id")
    return materialise(only(placed.drop("sig"), materialise(enough, "ids-apart")).select("id", "component", "n", "places", "sketch"), "documents-apart")


def block_pairs(docs: DataFrame, block: int = BLOCK, weight: int = LEAST_WEIGHT) -> DataFrame:
    """(pair, side, id, component): the documents of a crowd, in blocks of so many shingles, each block against each.

    A crowd is a place that documents of two components or more share. Components larger
    than a block have blocks of their own, which aren't compared with each other.
    """
    placed = docs.select("id", "component", F.greatest("n", F.lit(weight)).alias("weight"), F.explode("places").alias("crowd"))
    held = placed.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("held"), F.sum("weight").alias("weight"))
    crowds = held.groupBy("crowd").agg(F.sum(F.when(F.col("weight") <= block, F.col("weight"))).alias("rest"), F.count(F.lit(1)).alias("components")).where("components > 1")
    own = F.col("weight") > block
    held = materialise(held.join(crowds, "crowd").select("crowd", "component", "held", own.alias("own"), F.ceil(F.when(own, F.col("weight")).otherwise(F.col("rest")) / block).alias("parts")), "crowd-components")
    placed = join_counted(placed.drop("weight"), held, ["crowd", "component"], "held", placed.count())
    owner = F.when(F.col("own"), F.col("component"))
    part = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("id")).otherwise(F.col("component"))), F.col("parts"))
    placed = materialise(placed.select("id", "component", F.xxhash64("crowd", owner, part).alias("block"), "crowd"), "crowd-blocks")
    blocks = placed.groupBy("crowd", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    one, other = (blocks.select("crowd", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")]) for s in "ab")
    pairs = one.join(other, "crowd").where("block_a <= block_b and not (low_a = high_a and low_b = high_b and low_a = low_b)")
    pairs = materialise(pairs.select("crowd", "block_a", "block_b", F.xxhash64("crowd", "block_a", "block_b").alias("pair")), "block-pairs")
    sides = pairs.select("crowd", F.col("block_a").alias("block"), "pair", F.lit(0).alias("side")).unionByName(
        pairs.where("block_a != block_b").select("crowd", F.col("block_b").alias("block"), "pair", F.lit(1).alias("side")))
    return placed.join(sides, ["crowd", "block"]).select("pair", "side", "id", "component")


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the others, or of all with all where ``split`` is their number."""
    n = len(sets)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    cross = split < n
    out = np.zeros((split, n - split if cross else n), np.int32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    light = (count[column] > 1) & (count[column] < HEAVY)
    r, c = rows[light], column[light]
    for d in range(1, HEAVY - 1):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        a, b = r[same], r[same + d]  # ascending within a column
        if cross:
            both = (a < split) & (b >= split)
            np.add.at(out, (a[both], b[both] - split), 1)
        else:
            np.add.at(out, (a, b), 1)
    heavy = count[column] >= HEAVY
    r, c = rows[heavy], column[heavy]
    _, c = np.unique(c, return_inverse=True)
    for low in range(0, int(c.max()) + 1 if len(c) else 0, DENSE):
        first, last = np.searchsorted(c, [low, low + DENSE])
        dense = np.zeros((n, DENSE), np.float32)
        dense[r[first:last], c[first:last] - low] = 1
        out += (dense[:split] @ (dense[split:] if cross else dense).T).astype(np.int32)
    return out


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes each row of ``a`` shares with each of ``b``, in the same places."""
    if len(a) * len(b) * a.shape[1] <= 1_000_000:
        return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.uint8)
    out = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] == y[None, :]
    return out


def units(sides: np.ndarray, ids: np.ndarray, components: np.ndarray, sketches: np.ndarray, least: int = SHARED_VALUES):
    """(name, rows, sides) of what is compared by full sets of one pair of blocks.

    Documents of different components that share ``least`` bytes of their sketches are
    near; a unit is those that are joined by such pairs. Small units have the same name
    in each crowd that holds them.
    """
    split = int((sides == 0).sum())
    cross = split < len(ids)
    a, b = slice(0, split), slice(split if cross else 0, None)
    i, j = np.nonzero((agreements(sketches[a], sketches[b]) >= least) & (components[a][:, None] != components[b][None, :]))
    if not len(i):
        return
    j = j + split if cross else j
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    rows = np.unique(np.concatenate([i, j]))
    rows = rows[np.argsort(label[rows], kind="stable")]
    for unit in np.split(rows, np.flatnonzero(np.diff(label[rows])) + 1):
        side = sides[unit] if len(unit) > SMALL_UNIT else np.zeros(len(unit), np.int32)
        order = np.lexsort((ids[unit], side))
        unit, side = unit[order], side[order]
        name = hashlib.blake2b(ids[unit].tobytes() + side.tobytes(), digest_size=8).digest()
        yield int.from_bytes(name, "little", signed=True), unit, side


def near_units(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair, side, id, component): of the pairs of blocks of ``docs`` those documents that can be linked there, as ``units``, each unit once."""
    rows = block_pairs(docs, block).join(docs.select("id", "sketch"), "id").repartition("pair").sortWithinPartitions("pair", "side")

    def found(group):
        pairs, sides, ids, components, sketches = (np.concatenate(c) for c in zip(*group, strict=True))
        out = []
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        for x, y in zip(first, [*first[1:], len(pairs)], strict=True):
            for name, unit, side in units(sides[x:y], ids[x:y], components[x:y], sketches[x:y]):
                out.append((np.full(len(unit), name, np.int64), side.astype(np.int32), ids[x:y][unit], components[x:y][unit]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["pair", "side", "id", "component"])

    def sketched(batches):
        rest = []  # of the last pair, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [*(batch.column(c).to_numpy() for c in ("pair", "side", "id", "component")), sketches_of(batch)]
            cut = int(np.flatnonzero(np.concatenate([[True], new[0][1:] != new[0][:-1]]))[-1])
            if cut or rest and rest[-1][0][0] != new[0][0]:
                yield from found(rest + [[c[:cut] for c in new]])
                rest = []
            rest.append([c[cut:].copy() for c in new])
        if rest:
            yield from found(rest)

    return rows.mapInArrow(tidily(sketched), "pair long, side int, id long, component long").dropDuplicates(["pair", "side", "id"])


def links_across(docs: DataFrame, texts: DataFrame, words: int = 5, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links between components of ``docs`` (of ``alike_elsewhere``), by full shingle sets; of those that join the same components one."""
    dealt = materialise(near_units(docs, block), "units")
    rows = texts_of(texts, materialise(dealt.select("id").distinct(), "ids-in-units"))

    def shingled(batches):
        for batch, texts in batched_texts(batches, 1_000_000):
            sets = shingle_sets(texts, words)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])

    sets = materialise(rows.mapInArrow(tidily(shingled), "id long, shingles array<long>"), "crowd-sets")
    dealt = dealt.join(sets, "id").repartition("pair").sortWithinPartitions("pair", "side")

    def linked(group):
        """Links of one pair of blocks, as a forest over its components."""
        split = sum(side == 0 for side, *_ in group)
        sets = [s for *_, s in group]
        n, at = np.array([len(s) for s in sets]), np.array([component for _, _, component, _ in group])
        both = overlaps(sets, split)
        a, b = (slice(0, split), slice(split, None) if split < len(group) else slice(0, split))
        near = (100 * both >= threshold * (n[a][:, None] + n[b][None, :] - both)) & (both > 0) & (at[a][:, None] != at[b][None, :])
        i, j = np.nonzero(near)
        ends = np.unique(np.stack([at[a][i], at[b][j]], 1), axis=0) if len(i) else ()
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for x, y in ends:
            x, y = find(int(x)), find(int(y))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield min(x, y), max(x, y)

    def compared(batches):
        pair, group = None, []
        for batch in batches:
            out = []
            shingles = batch.column("shingles")
            flat, ends = shingles.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
            for k, (p, side, id_, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "id", "component")), strict=True)):
                if p != pair:
                    if len(group) > 1:
                        out += linked(group)
                    pair, group = p, []
                group.append((side, id_, component, flat[ends[k]:ends[k + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if len(group) > 1 and (out := list(linked(group))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(tidily(compared), "a long, b long").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of those rows of ``docs`` that ``ids`` names."""
    return only(docs.select(doc_column(docs, "doc_id", "long").alias("id"), doc_text(docs).alias("text")), ids)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows`` whose id ``ids`` has; while these are few they are sent to the rows, which then stay where they are."""
    ids = ids.select("id")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def one_node_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``docs`` with a doc_id of its own for each text, (node, doc) of those that shared one, or None).

    Where all ids differ, which is looked up first, nothing is changed.
    """
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_column(docs, "text", "string").alias("text"))
    shared = materialise(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared-ids")
    n = shared.count()
    if not n:
        return rows, None
    named = rows.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, "doc_id", "left")
    named = materialise(named.select("doc_id", "text", F.when(F.col("held").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(1))).otherwise(F.col("doc_id")).alias("node")), "named-documents")
    return named.select(F.col("node").alias("doc_id"), "text"), named.where("node != doc_id").select("node", F.col("doc_id").alias("doc")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """Groups of documents linked by shingle sets of similarity ``threshold`` / 100 or more, one row per row of ``docs``.

    Words lie between ASCII white space, A-Z lower-cased; a text of fewer than ``words``
    words is one shingle; a null text or one without words has no shingle and no link.
    Rows that share a doc_id are one document with the links of each; rows without a
    doc_id are linked with nothing and kept. An empty table gives an empty result; extra
    columns are ignored. Returns doc_id, n_shingles, component_id, kept.
    """
    docs, shared = one_node_each(docs)
    signed = signatures(docs, words)
    linked = signed.where("n > 0 and id is not null")
    # Equal sets are one node from here on, so copies cost nothing, however many.
    reps = materialise(linked.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("held")), "set-nodes")
    pairs = materialise(candidates(reps), "candidate-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = materialise(ids, "candidate-ids")
    texts = materialise(texts_of(docs, ids), "candidate-texts")
    # First each document against the one it met most often; then what is still apart.
    closest = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")
    edges = materialise(confirmed(closest, texts, reps, words, threshold), "edges")
    at = materialise(components(edges), "groups")
    of = lambda side: at.select(F.col("node").alias(side), F.col("component").alias(f"{side}_at"))
    apart = pairs.join(closest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(F.coalesce("a_at", "a") != F.coalesce("b_at", "b")).select("a", "b")
    # Both tables together give the classes.
    more = confirmed(apart, texts, reps, words, threshold)
    by_set = ["set_a", "set_b", "n"]
    same_id = join_counted(linked.select(*by_set, "id"), reps.select(*by_set, F.col("id").alias("rep"), "held"), by_set, "held", signed.count()).select("id", "rep")
    star = at.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    at = materialise(components(star.unionByName(more)), "classes")
    # What crowds hold beside neighbours: documents of different components, block against block.
    apart = alike_elsewhere(reps, at)
    across = materialise(links_across(apart, docs, words, threshold), "links-across")
    if across.take(1):
        star = at.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        at = materialise(components(star.unionByName(across)), "classes")
    member = same_id.join(at, F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.least(F.coalesce("component", "rep"), F.col("id"))).alias("component_id"))
    if shared is None:
        out = signed.join(member, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    else:  # all nodes of one doc_id are one document, and a class goes by its least doc_id
        every = signed.where("id is not null").select("id").distinct().join(member, "id", "left")
        every = materialise(every.select("id", F.coalesce("component_id", "id").alias("class")).join(shared, F.col("id") == F.col("node"), "left").select("id", "class", F.coalesce("doc", "id").alias("doc")), "document-nodes")
        home = every.groupBy("doc").agg(F.min("class").alias("least"))
        joined = materialise(components(every.join(home, "doc").select(F.col("class").alias("a"), F.col("least").alias("b"))), "joined-classes")
        every = every.join(joined, F.col("class") == F.col("node"), "left").select("id", "doc", F.coalesce("component", "class").alias("class"))
        named = every.join(every.groupBy("class").agg(F.min("doc").alias("component_id")), "class").select("id", "doc", "component_id")
        out = signed.join(named, "id", "left").withColumn("id", F.coalesce("doc", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the least doc_id."""
    name, own = fresh_names(docs, "_gone", "_own")
    gone = near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(own, doc_column(docs, "doc_id", "long")).join(gone, F.col(own) == F.col(name), "left_anti").drop(own)
