"""A Merkle tree over a table: range-sorted leaves, subtrees built where their leaves lie, and a proof for every row."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import doc_column, join_counted, materialise, small_batches, tidily

#: Children of a node.
FAN = 8
#: Leaves of a range: what a task holds at once, some 300 bytes each.
RANGE_ROWS = 50_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def leaf_columns(docs: DataFrame) -> tuple[Column, Column]:
    """(leaf, the leaf after tampering, null where the row isn't tampered with)."""
    value = {c: doc_column(docs, c, "long" if c in ("doc_id", "n_chars") else "string").cast("string") for c in COLUMNS}

    def digest(text: Column) -> Column:
        part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        return F.sha2(F.concat(*[part(value[c]) for c in COLUMNS[:-1]], part(text)), 256)

    tampered = F.crc32(value["doc_id"].cast("binary")) % 3 == 0
    return digest(value["text"]), F.when(tampered, digest(F.translate(value["text"], *_LOWER)))


def in_ranges(leaves: DataFrame, rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``leaves`` sorted by grp, key, leaf with the number of their range; part, grp, first, n).

    ``leaves`` is a written table, so that ranges come out alike when a task runs again.
    ``first`` is the place within its group of the first leaf that a range has of it, and
    ``n`` the group's leaves: sums of the counts by range and group.
    """
    total = leaves.count()
    row = F.monotonically_increasing_id()
    ranged = leaves.withColumn("_row", row).repartitionByRange(max(1, -(-total // rows)), F.asc_nulls_first("grp"), F.asc_nulls_first("key"), "leaf", "_row")
    placed = materialise(ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.asc_nulls_first("grp"), F.asc_nulls_first("key"), "leaf", "_row"), "leaf-ranges")
    counts = materialise(placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("held")), "range-counts")
    # A group's ranges follow each other, so the running sum over them is the offset; one row a range and group.
    along = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    of_group = W.partitionBy("grp")
    return placed, materialise(counts.select("part", "grp", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("first"), F.sum("held").over(of_group).alias("n")), "range-offsets")


def local_levels(hashes: list[str], first: int, n: int) -> list[tuple[int, list[str]]]:
    """Per level (place of the first node, nodes): all nodes whose leaves all lie in [first, first + len(hashes)) of ``n``."""
    size, out = n, [(first, hashes)]
    while size > 1:
        begin, nodes = out[-1]
        end = begin + len(nodes)
        parent = -(-begin // FAN)
        stop = -(-size // FAN) if end == size else end // FAN
        if parent >= stop:
            break
        out.append((parent, [sha256_of(nodes[FAN * j - begin:FAN * (j + 1) - begin]) for j in range(parent, stop)]))
        size = -(-size // FAN)
    return out


def ragged(levels: list[tuple[int, list[str]]], n: int):
    """(level, place, hash) of the nodes whose parent is not complete here."""
    for level, (begin, nodes) in enumerate(levels):
        if level == height(n):
            yield level, begin, nodes[0]
        else:
            above, parents = levels[level + 1] if level + 1 < len(levels) else (0, [])
            for j, h in enumerate(nodes, begin):
                if not above <= j // FAN < above + len(parents):
                    yield level, j, h


def by_part(batches, columns: tuple[str, ...]):
    """(part, rows as dictionaries of ``columns``) of batches sorted by part."""
    rows = (r for batch in batches for r in batch.select(["part", *columns]).to_pylist())
    yield from groupby(rows, key=lambda r: r["part"])


def dealt(placed: DataFrame, *extra: DataFrame) -> DataFrame:
    """Each range's leaves behind what ``extra`` says of it, together in one task."""
    rows = placed.withColumn("what", F.lit(9))
    for df in extra:
        rows = df.unionByName(rows, allowMissingColumns=True)
    return rows.repartition("part").sortWithinPartitions("part", "what", F.asc_nulls_first("grp"), F.asc_nulls_first("key"), "leaf", "_row")


def subtrees(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    """(part, grp, n, level, place, hash): each range's largest complete subtrees."""
    kind = placed.schema["grp"].dataType.simpleString()
    fields = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("hash", pa.string())])

    def built(batches):
        for part, rows in by_part(batches, ("what", "grp", "first", "n", "leaf")):
            at, out = {}, []
            for (what, grp), these in groupby(rows, key=lambda r: (r["what"], r["grp"])):
                if what == 0:
                    at |= {grp: (r["first"], r["n"]) for r in these}
                else:
                    first, n = at[grp]
                    out += [(part, grp, n, *node) for node in ragged(local_levels([r["leaf"] for r in these], first, n), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return dealt(placed, offsets.withColumn("what", F.lit(0))).mapInArrow(tidily(built), f"part int, grp {kind}, n long, level int, place long, hash string")


def upper_levels(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(grp, level, place, children of each node above ``nodes``; grp, root).

    Level by level, nodes meet by the coordinate of their parent; each has eight at most.
    """
    columns = ["grp", "n", "level", "place", "hash"]
    done, tops = [], []
    below = nodes.where("level = 0").select(*columns)
    for level in range(levels + 1):
        size = F.ceil(F.col("n") / F.pow(F.lit(float(FAN)), F.lit(level)))
        tops.append(below.where(size <= 1).select("grp", F.col("hash").alias("root")))
        if level == levels:
            break
        met = below.where(size > 1).groupBy("grp", "n", F.floor(F.col("place") / FAN).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("children"))
        met = materialise(met.select("grp", "n", F.lit(level + 1).alias("level"), "place", F.col("children.hash").alias("children")), "upper-nodes")
        done.append(met.select("grp", "level", "place", "children"))
        made = met.select("grp", "n", "level", "place", F.sha2(F.array_join("children", ""), 256).alias("hash"))
        below = made.unionByName(nodes.where(F.col("level") == level + 1).select(*columns))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    upper = None
    for d in done:
        upper = d if upper is None else upper.unionByName(d)
    if upper is None:
        upper = nodes.select("grp", "level", "place", F.array("hash").alias("children")).where("false")
    return upper, roots


def paths(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """(part, grp, level, place, path) for each of ``nodes``: per level above it, the run of children it lies in and its place there."""
    ancestors = nodes.where(F.col("level") < height_column(F.col("n"))).select(
        "part", "grp", F.col("level").alias("from_level"), F.col("place").alias("from_place"),
        F.posexplode(F.transform(F.sequence(F.col("level") + 1, height_column(F.col("n"))), lambda up: F.struct(up.alias("level"), F.floor(F.col("place") / F.pow(F.lit(float(FAN)), up - F.col("level"))).alias("place")))).alias("up", "at"))
    ancestors = ancestors.select("part", "grp", "from_level", "from_place", "up", F.col("at.level").alias("level"), F.col("at.place").alias("place"),
                                 F.pmod(F.floor(F.col("from_place") / F.pow(F.lit(float(FAN)), F.col("up"))), F.lit(FAN)).cast("int").alias("slot"))
    # Near the root one run stands in the path of every node: its copies are counted, and hot ones broadcast.
    key = ["grp_key", "level", "place"]
    named = ancestors.withColumn("grp_key", group_key(F.col("grp")))
    held = named.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    table = materialise(held.join(upper.withColumn("grp_key", group_key(F.col("grp"))).drop("grp"), key), "upper-runs")
    found = join_counted(materialise(named, "node-ancestors"), table, key, "held", max(1, named.count()))
    step = F.struct("up", "slot", "children")
    return found.groupBy("part", "grp", F.col("from_level").alias("level"), F.col("from_place").alias("place")).agg(F.sort_array(F.collect_list(step)).alias("path"))


def group_key(grp: Column) -> Column:
    """``grp`` as a value that joins with itself when it is null."""
    return F.coalesce(F.concat(F.lit("="), grp.cast("string")), F.lit("-"))


def height_column(n: Column) -> Column:
    """``height`` as a column, for any count of 63 bits: the powers of the fan that lie below it."""
    out = F.lit(0)
    for k in range(21):
        out = out + (n > FAN ** k).cast("int")
    return out


def tree(leaves: DataFrame, rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(leaves by range, offsets, paths of the ranges' nodes, root of each group) of ``leaves`` (grp, key, leaf, ...)."""
    placed, offsets = in_ranges(leaves, rows)
    nodes = materialise(subtrees(placed, offsets), "subtrees")
    levels = height(offsets.agg(F.max("n")).first()[0] or 0)
    upper, roots = upper_levels(nodes, levels)
    return placed, offsets, materialise(paths(nodes, upper), "node-paths"), materialise(roots, "group-roots")


def fold(h: str, runs: list[tuple[int, list[str]]]) -> str:
    """The root that ``h`` leads to along (its place, the run) of each level."""
    for slot, run in runs:
        h = sha256_of([*run[:slot], h, *run[slot + 1:]])
    return h


def manifest(spark: SparkSession, docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Leaf, roots and proof of every row of ``docs``, and what the root would be if some texts were lower-cased.

    A leaf is the digest of doc_id, source, lang, n_chars and text, `-` where null or
    where the table lacks the column. Each language, null and '' apart, is a tree of runs
    of eight over its leaves by doc_id, null first; leaves of one doc_id lie by their
    digest, and of equal rows each has the proof of a place of its own. Subroots, null
    first, then by bytes, make the root. Rows whose doc_id has a crc32 that 3 divides are
    tampered with; one without a doc_id is not. A single leaf is subroot and root, with
    the digest of nothing as its proof. An empty table gives an empty result; extra
    columns are ignored.
    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    small_batches(spark, 10_000)
    leaf, tampered = leaf_columns(docs)
    leaves = materialise(docs.select(doc_column(docs, "lang", "string").alias("grp"), doc_column(docs, "doc_id", "long").alias("key"), leaf.alias("leaf"), tampered.alias("tampered")), "leaves")
    placed, offsets, below, roots = tree(leaves, rows)
    # The languages' roots are the leaves of one more tree.
    tops = materialise(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf")), "subroots")
    top_placed, top_offsets, top_paths, top_root = tree(tops, rows)
    top = proofs(top_placed.withColumn("tampered", F.lit(None).cast("string")), top_offsets, top_paths, None).select(
        group_key(F.col("key")).alias("grp_key"), F.col("leaf").alias("subroot"), F.col("runs").alias("top"))
    root = top_root.select("root").first()
    return proofs(placed, offsets, below, (materialise(top, "subroot-paths"), root and root[0])).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_RUNS = "array<struct<slot:int,run:array<string>>>"


def proofs(placed: DataFrame, offsets: DataFrame, below: DataFrame, above: tuple[DataFrame, str | None] | None) -> DataFrame:
    """One row per leaf: key, leaf and, given ``above`` (subroot and runs by group; the root), its proof and folded root, else the runs on its way up."""
    run_type = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))
    key_kind, ends = dict(placed.dtypes)["key"], above is not None
    key_type = pa.int64() if key_kind == "bigint" else pa.string()
    steps = F.transform("path", lambda s: F.struct(s["slot"].alias("slot"), s["children"].alias("run")))
    nodes = below.select("part", F.lit(1).alias("what"), "grp", "level", "place", steps.alias("runs"))
    first = offsets.select("part", F.lit(0).alias("what"), "grp", "first", "n")
    if above is not None:
        subroots, root = above
        known = first.withColumn("grp_key", group_key(F.col("grp"))).join(subroots, "grp_key")
        first = known.select("part", "what", "grp", "first", "n", F.col("subroot"), F.lit(root).cast("string").alias("root"), F.col("top").cast(_RUNS).alias("top"))
    names = ("what", "grp", "key", "leaf", "tampered", "first", "n", "level", "place", "runs", *(("subroot", "root", "top") if above is not None else ()))
    outer = [("leaf", pa.string()), *([("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())] if above is not None else [("runs", run_type)])]

    def proven(batches):
        for _, rows in by_part(batches, names):
            at, way = {}, {}
            for (what, grp), these in groupby(rows, key=lambda r: (r["what"], r["grp"])):
                if what == 0:
                    at |= {grp: r for r in these}
                elif what == 1:
                    way |= {(grp, r["level"], r["place"]): [(s["slot"], s["run"]) for s in r["runs"]] for r in these}
                else:
                    these = list(these)
                    here = at[grp]
                    top = [(s["slot"], s["run"]) for s in here["top"]] if ends else []
                    levels = local_levels([r["leaf"] for r in these], here["first"], here["n"])
                    out = []
                    for i, r in enumerate(these, here["first"]):
                        runs, level, j = [], 0, i
                        while level + 1 < len(levels):
                            begin, parents = levels[level + 1]
                            if not begin <= j // FAN < begin + len(parents):
                                break
                            low, nodes_ = levels[level]
                            j, slot, level = j // FAN, j % FAN, level + 1
                            runs.append((slot, nodes_[max(0, FAN * j - low):FAN * (j + 1) - low]))
                        runs += way.get((grp, level, j), [])
                        runs += top
                        if not ends:
                            out.append((r["key"], r["leaf"], [{"slot": s, "run": x} for s, x in runs]))
                            continue
                        proof = sha256_of([h for s, x in runs for h in (*x[:s], *x[s + 1:])])
                        out.append((r["key"], r["leaf"], here["subroot"], here["root"], proof, fold(r["tampered"] or r["leaf"], runs)))
                    for k in range(0, len(out), 10_000):
                        columns = list(zip(*out[k:k + 10_000], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], outer, strict=True)]], ["key", *[n for n, _ in outer]])

    schema = f"key {key_kind}, " + ", ".join(f"{n} {_RUNS if n == 'runs' else 'string'}" for n, _ in outer)
    return dealt(placed, nodes, first).mapInArrow(tidily(proven), schema)
