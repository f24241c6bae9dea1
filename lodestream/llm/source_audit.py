"""How far the sources of each language differ in their terms: shards of terms counted and summed by DuckDB, merged by Spark."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import doc_column, join_counted, materialise, small_batches, tidily
from .tokens import slices

#: A kept term lies in so many documents of its language; ranks of terms go so far.
LEAST_DOCS, RANKS = 3, 200
#: Rows that a task hands to one SQL statement, and rows of partial counts that it holds before it lets them go.
LOT, HELD = 200_000, 500_000
#: Up to so many (lang, source) groups their totals are sent to the tasks (some 60 bytes each); beyond, they are joined.
GROUPS_SENT = 50_000
#: Shares are counted in so many parts.
PARTS = 1_000_000_000
_MEMORY = "256MB"

#: Bytes of a term, A-Z as a-z; 0 for those between terms.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[:65] = _TERM[91:97] = _TERM[123:128] = 0


def opened() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": _MEMORY, "preserve_insertion_order": False})


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of its text, term) of every term of ``texts``: runs of A-Z, a-z and all that is not ASCII, A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _TERM[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = raw != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(raw)]
    first[cuts] = inside[cuts]  # a text begins anew, whatever the one before ended with
    begin = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[begin], kept[-1]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return np.searchsorted(ends, begin, side="right") - 1, terms


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within each task as far as memory allows."""
    small_batches(docs.sparkSession)
    fields = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def counted(batches):
        con = opened()
        con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)").fetchall()
        merged = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
        rows = 0
        for batch in slices(batches):
            at, terms = terms_of(batch.column("text"))
            con.register("found", pa.table({"row": at.astype(np.int32), "term": terms}))
            con.register("docs", pa.table({"row": np.arange(batch.num_rows, dtype=np.int32), "lang": batch.column("lang"), "source": batch.column("source")}))
            rows += con.execute("""
                INSERT INTO held SELECT lang, source, term, sum(n), count(*)
                FROM (SELECT row, term, count(*) AS n FROM found GROUP BY ALL) JOIN docs USING (row) GROUP BY ALL""").fetchall()[0][0]
            con.unregister("found")
            con.unregister("docs")
            if rows > HELD:
                con.execute(f"CREATE OR REPLACE TABLE held AS {merged}").fetchall()
                rows = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
                if rows > HELD // 2:
                    yield from con.sql("FROM held").to_arrow_table().cast(fields).to_batches(20_000)
                    con.execute("TRUNCATE held").fetchall()
                    rows = 0
        yield from con.sql(merged).to_arrow_table().cast(fields).to_batches(20_000)
        con.close()

    return grouped_columns(docs).mapInArrow(tidily(counted), "lang string, source string, term string, n long, docs long")


def grouped_columns(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(doc_column(docs, c, "string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text"))


def runs(batches, keys: list[str], most: int, collapse):
    """Tables of about ``most`` rows of batches sorted by ``keys``, none of which parts a key; a key with more rows is collapsed as they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in keys]
        same = np.ones(len(table), bool)
        for k, v in zip(keys, last, strict=True):
            same &= pc.equal(table.column(k), pa.scalar(v, table.schema.field(k).type)).to_numpy(zero_copy_only=False)
        cut = len(table) - int(same.sum())
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        if len(rest) > most // 2:
            rest = collapse(rest)
        held, size = rest.to_batches(), len(rest)
    if size:
        yield pa.Table.from_batches(held)


def kept_terms(partial: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, entries): the terms that lie in ``least`` documents of their language, with the sources that have them.

    Partial counts go to a shard by hash of lang and term; sorted there, a shard is counted by SQL some terms at a time.
    """
    fields = pa.schema([("lang", pa.string()), ("term", pa.string()), ("entries", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
    by_source = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL"

    def counted(batches):
        con = opened()

        def collapse(part):
            con.register("part", part)
            return con.sql(by_source).to_arrow_table().cast(part.schema)

        for part in runs(batches, ["lang", "term"], LOT, collapse):
            con.register("part", part)
            out = con.sql(f"""
                SELECT lang, term, list({{'source': source, 'n': n}}) AS entries FROM ({by_source})
                GROUP BY lang, term HAVING sum(docs) >= {least}""").to_arrow_table()
            con.unregister("part")
            yield from out.cast(fields).to_batches(10_000)
        con.close()

    shards = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(tidily(counted), "lang string, term string, entries array<struct<source:string,n:long>>")


def share(n: str, held: str, v: str) -> Column:
    """1 + floor(PARTS * (n + 1) / (held + v)), exactly, whatever the counts."""
    return F.expr(f"1 + (cast({PARTS} AS decimal(10, 0)) * cast({n} + 1 AS decimal(19, 0))) div cast({held} + {v} AS decimal(20, 0))")


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def sums_by_shard(kept: DataFrame, groups: DataFrame, sent: int = GROUPS_SENT, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value): of each shard the sums of pairs over the terms that both sources have, and its foremost terms.

    A pair's sum here is what such terms add beyond the sums of ``alone``. Totals of
    ``groups`` go to the tasks as a table while there are at most ``sent``, beyond that
    they are joined to the terms' entries and regrouped by term.
    """
    totals = ["source", "held", "v", "all_held"]
    if groups.count() <= sent:
        table = groups.select("lang", *totals).toArrow()
        held = kept.sparkSession.sparkContext.broadcast(table)
    else:
        held = None
        flat = kept.select("lang", "term", F.inline("entries"))
        joined = join_counted(flat, groups.select("lang", *totals, "own"), ["lang", "source"], "own", flat.count())
        kept = joined.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "held", "v", "all_held")).alias("entries"))
    fields = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    part = lambda n, total: f"(1 + {PARTS}::HUGEINT * ({n} + 1) // ({total} + v))::BIGINT"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"

    def summed(batches):
        con = opened()
        if held is not None:
            con.register("totals", held.value)
        lot, size = [], 0

        def run():
            con.register("kept", pa.Table.from_batches(lot))
            con.execute(f"""
                CREATE OR REPLACE TEMP TABLE e AS
                SELECT t, lang, term, source, {part('n', 'held')} AS p, {part('0', 'held')} AS zero, {part('sum(n) OVER (PARTITION BY t)', 'all_held')} AS q
                FROM (SELECT t, lang, term, unnest(entries, recursive := true) FROM (SELECT row_number() OVER () AS t, * FROM kept))
                {'JOIN totals USING (lang, source)' if held is not None else ''}""").fetchall()
            con.unregister("kept")
            yield from con.sql(f"""
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                    sum({f('a.p', 'b.p')} - {f('a.p', 'b.zero')} - {f('a.zero', 'b.p')} + {f('a.zero', 'b.zero')})::BIGINT AS value
                FROM e a JOIN e b ON a.t = b.t AND a.source <> b.source GROUP BY ALL""").to_arrow_table().cast(fields).to_batches(20_000)
            yield from con.sql(f"""
                SELECT lang, source, 'term' AS part, term AS item, {f('p', 'q')} AS value FROM e WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {ranks}""").to_arrow_table().cast(fields).to_batches(20_000)

        for batch in batches:
            lot.append(batch)
            size += len(batch.column("entries").flatten())
            if size >= LOT:
                yield from run()
                lot, size = [], 0
        if lot:
            yield from run()
        con.close()

    return kept.mapInArrow(tidily(summed), "lang string, source string, part string, item string, value long")


def alone(histogram: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): sums of pairs as if no term were in both sources.

    A term that one source has and the other has not adds by its count alone, so
    ``histogram`` (lang, source, n, terms) stands for all terms.
    """
    g = groups.where("v > 0").select("lang", "source", "v", "held", share("0", "held", "v").alias("zero"))
    as_ = lambda df, side: df.select("lang", *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "lang"])
    one, other = as_(g, "a"), as_(g, "b")
    base = one.join(other, "lang").where("source_a != source_b").select("lang", "source_a", "source_b", F.expr(f"v_a * {distance('zero_a', 'zero_b')}").alias("value"))
    h = histogram.join(g, ["lang", "source"]).groupBy("lang", "source", "zero", share("n", "held", "v").alias("p")).agg(F.sum("terms").alias("terms"))
    has = as_(h, "a").join(other, "lang").where("source_a != source_b")
    has = has.groupBy("lang", "source_a", "source_b").agg(F.sum(F.expr(f"terms_a * ({distance('p_a', 'zero_b')} - {distance('zero_a', 'zero_b')})")).alias("value"))
    lacks = as_(h, "b").join(one, "lang").where("source_a != source_b")
    lacks = lacks.groupBy("lang", "source_a", "source_b").agg(F.sum(F.expr(f"terms_b * ({distance('zero_a', 'p_b')} - {distance('zero_a', 'zero_b')})")).alias("value"))
    none = groups.where("v = 0")
    none = none.select("lang", F.col("source").alias("source_a")).join(none.select("lang", F.col("source").alias("source_b")), "lang").where("source_a != source_b").withColumn("value", F.lit(0).cast("long"))
    both = base.unionByName(has).unionByName(lacks).unionByName(none)
    return both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, sent: int = GROUPS_SENT) -> DataFrame:
    """Divergence of each (lang, source) group from the other sources of its language and from the language's terms.

    Null text, lang and source count as ''. Terms are runs of letters A-Z, a-z and of
    anything not ASCII, A-Z lower-cased; a language keeps those in ``least`` of its rows.
    Shares are whole billionths with one added to every count; all sums are exact. Part
    `pair` has every other source of the language, with 0 where no term is kept; part
    `term` the ``ranks`` terms that most exceed the language's share, ties by the term's
    bytes. A source alone in its language has no pairs. Repeated rows count each;
    an empty table gives an empty result; extra columns are ignored.
    Returns lang, source, part, item, value, rank.
    """
    kept = materialise(kept_terms(partial_counts(docs), least), "kept-terms")
    histogram = materialise(kept.select("lang", F.inline("entries")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "term-histogram")
    found = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("held"), F.sum("terms").alias("own"))
    all_of = found.groupBy("lang").agg(F.sum("held").alias("all_held")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang")
    there = grouped_columns(docs).select("lang", "source").distinct()
    groups = materialise(there.join(found, ["lang", "source"], "left").join(all_of, "lang", "left").na.fill(0), "source-totals")
    parts = materialise(sums_by_shard(kept, groups, sent, ranks), "shard-sums")
    pairs = parts.where("part = 'pair'").unionByName(alone(histogram, groups)).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    terms = parts.where("part = 'term'")
    # First among the terms that share a salt, so that no task gets all foremost terms of a group.
    salt = F.pmod(F.xxhash64("item"), F.lit(32))
    terms = terms.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", salt).orderBy(*best))).where(F.col("rank") <= ranks).drop("rank")
    first = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(*best)))
    return first(pairs).unionByName(first(terms).where(F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
