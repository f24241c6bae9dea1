"""Personal data: fixed expressions, and spans that bootstrapped contexts find."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import doc_column, doc_text, join_counted, materialise, small_batches, tidily

KINDS = ("email", "ip", "card", "phone")
#: The base expressions.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
#: IP from the beginning of a run of digits on and without steps back: what it finds is the same, in time linear in the text.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
#: An identifier that no expression knows: groups of digits that belong together, or a run without white space with a digit, @ or # in it.
MARK = re.compile("[0-9@#]")
GROUPS = re.compile(r"\(?[0-9][0-9()-]*(?:[ .][0-9()-]+)+(?![^\s.,;:!?])")
RUN = re.compile(r"\S+")
#: Characters on either side that a context is taken from at most; a word of more counts by those nearest.
REACH = 8_192
#: Characters of contexts that a task puts out at once.
HANDED = 4_000_000
EDGES = ".,;:!?\"'()[]{}<>"
#: Rounds end when no confidence moves by more than MOVED.
MOVED = 0.005
#: Up to so many confident patterns are sent to every task, some 100 bytes each; more are joined.
PATTERNS_SENT = 50_000
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: A pattern counts with so many different seeds in different documents, and from this confidence.
SUPPORT, CONFIDENT = 3, 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As EMAIL finds them, looking only around each @, since most text has none."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base expressions by start, then kind: leftmost and not overlapping within a kind; those that fail a condition go."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP_RUNS.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _words_before(text: str, start: int, n: int = 2) -> list[str]:
    """The last ``n`` whole words before ``start`` in its line, looking back no farther than it takes."""
    least = max(0, start - REACH)
    least = max(least, text.rfind("\n", least, start) + 1)
    back = 64
    while True:
        low = max(least, start - back)
        words = text[low:start].split()
        if low == least or len(words) > n:  # the first may be cut, and isn't taken then
            return words[-n:]
        back *= 4


def _word_after(text: str, end: int) -> str | None:
    most = min(len(text), end + REACH)
    stop = text.find("\n", end, most)
    most = most if stop < 0 else stop
    ahead = 64
    while True:
        high = min(most, end + ahead)
        words = text[end:high].split(maxsplit=1)
        if high == most or len(words) > 1:
            return words[0] if words else None
        ahead *= 4


def handed(rows, names: list[str], kinds: list[pa.DataType]):
    """Record batches of ``rows``, whose last column is text, each of HANDED characters or so."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[-1])
        if size >= HANDED or len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns around a span: the word before it, the two words before, and the words on both sides, within its line and REACH characters."""
    bare = lambda w: w.lower().strip(EDGES) or w
    left = [bare(w) for w in _words_before(text, start)]
    after = _word_after(text, end)
    right = bare(after) if after else "$"
    if not left:
        return [f"^ _ {right}"]
    return [f"{left[-1]} _", *([f"{' '.join(left)} _"] if len(left) > 1 else []), f"{left[-1]} _ {right}"]


def telling(value: str) -> bool:
    """Whether a candidate may be an identifier: four digits or more, or an @ or # with letters or digits behind it."""
    if len(value) < 5:
        return False
    return sum(c.isdigit() for c in value) >= 4 or any(c in "@#" and value[i + 1:i + 2].isalnum() for i, c in enumerate(value))


def occurrences(text: str, base: list[tuple[str, int, int]]):
    """(kind or None, start, end) of base spans and of unknown candidates that touch none."""
    yield from base
    if not DIGIT.search(text) and "@" not in text and "#" not in text:
        return
    i = at = 0
    taken = sorted((a, b) for _, a, b in base)
    while mark := MARK.search(text, at):
        first = mark.start()
        while first > at and not text[first - 1].isspace():
            first -= 1
        m = GROUPS.match(text, first) or RUN.match(text, first)
        a, b = m.span()
        at = b
        while a < b and text[a] in EDGES:
            a += 1
        while b > a and text[b - 1] in EDGES:
            b -= 1
        if m.start() < a and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not (i < len(taken) and taken[i][0] < b) and telling(text[a:b]):
            yield None, a, b


def learn(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind): patterns that mark identifiers of a kind.

    ``found`` has a row per occurrence and pattern: pattern, instance (a hash), kind or
    null. Instances and patterns form a graph. An instance's trust is 1 if it is a seed;
    else the mean confidence of its patterns, so one that also stands where no seed ever
    does stays low. A pattern's confidence is the trust of its instances by their number
    plus one, so rare patterns stay low. Both are re-estimated in turn by grouped sums
    in Spark until no confidence moves by more than MOVED, which they reach since each
    round's moves are means of the one's before; ``rounds`` ends it earlier. Patterns with
    very many instances are broadcast, others are joined. A pattern's kind is that of
    most of its seeds, of equally many the first as listed. Where no pattern has both
    seeds enough and an unknown instance there is nothing to find, and no round.
    """
    graph = materialise(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-graph")
    total = graph.count()
    seeds = [F.count_if(F.col("kind") == k) for k in KINDS]
    of_kind = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, (k, n) in enumerate(zip(KINDS, seeds, strict=True))]))["kind"]
    sums = materialise(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("held"), F.count("kind").alias("seeds"), of_kind.alias("of_kind")), "pii-sums")
    open_ = (F.col("seeds") >= support) & (F.col("held") > F.col("seeds"))
    nothing = sums.where("false").select("pattern", F.col("of_kind").alias("kind"))
    if sums.where(open_).isEmpty():
        return nothing
    score = sums.withColumn("confidence", F.col("seeds") / (F.col("held") + 1))
    done = 0
    while rounds is None or done < rounds:
        rated = join_counted(graph.where("kind is null"), score.select("pattern", "confidence", "held"), ["pattern"], "held", total)
        trust = rated.groupBy("instance").agg(F.avg("confidence").alias("trust"))
        inferred = graph.where("kind is null").join(trust, "instance").groupBy("pattern").agg(F.sum("trust").alias("gained"))
        after = score.select("pattern", "held", "seeds", "of_kind", F.col("confidence").alias("was")).join(inferred, "pattern", "left")
        score = materialise(after.withColumn("confidence", (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("held") + 1)).drop("gained"), "pii-patterns")
        done += 1
        moved = score.agg(F.max(F.abs(F.col("confidence") - F.col("was")))).first()[0]
        if moved is None or moved <= MOVED:
            break
    # A pattern that stands around seeds only has nothing to find.
    return score.where(open_ & (F.col("confidence") >= confident)).select("pattern", F.col("of_kind").alias("kind"))


def patterns(spark: SparkSession, docs: DataFrame, rounds: int | None = None, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind): the confident patterns of ``docs``, as a written table."""
    small_batches(spark)
    rows = docs.select(doc_text(docs).alias("text"))

    def each(batch):
        for text in batch.column("text").to_pylist():
            for kind, a, b in occurrences(text, base_spans(text)):
                instance = int.from_bytes(hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                yield from ((instance, kind, p) for p in contexts(text, a, b))

    def seeds(batches):
        for batch in batches:
            yield from handed(each(batch), ["instance", "kind", "pattern"], [pa.int64(), pa.string(), pa.string()])

    found = rows.where(F.col("text").rlike("[0-9@#]")).mapInArrow(tidily(seeds), "instance long, kind string, pattern string")
    return materialise(learn(found, rounds, support, confident), "confident-patterns")


def unknown(text: str):
    """(start, end) of the candidates of ``text`` that no base span touches."""
    return [(a, b) for kind, a, b in occurrences(text, base_spans(text)) if kind is None]


def added_spans(docs: DataFrame, known: DataFrame, sent: int = PATTERNS_SENT) -> tuple[DataFrame, object]:
    """(``docs`` with a column ``_added`` or null, the kinds of patterns that tasks look up themselves).

    Up to ``sent`` patterns, of REACH characters and a few, are sent to all tasks. Beyond
    that the candidates go to the patterns: each context of a candidate is joined, and the
    first that is confident, in the order of ``contexts``, names the kind.
    """
    spark = docs.sparkSession
    n = known.count()
    if n <= sent:
        return docs.withColumn("_added", F.lit(None).cast(SPANS)), spark.sparkContext.broadcast({r["pattern"]: r["kind"] for r in known.collect()})
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")

    def each(batch):
        for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b in unknown(text or ""):
                yield from ((row, a, b, i, p) for i, p in enumerate(contexts(text, a, b)))

    def candidates(batches):
        for batch in batches:
            yield from handed(each(batch), ["_row", "start", "end", "place", "pattern"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()])

    held = materialise(rows.select("_row", "text").where(F.col("text").rlike("[0-9@#]")).mapInArrow(tidily(candidates), "_row long, start int, end int, place int, pattern string"), "candidate-contexts")
    wanted = known.join(held.groupBy("pattern").agg(F.count(F.lit(1)).alias("held")), "pattern")
    marked = join_counted(held, materialise(wanted, "wanted-patterns"), ["pattern"], "held", held.count())
    spans = marked.groupBy("_row", "start", "end").agg(F.min_by("kind", "place").alias("kind"))
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    spans = spans.select("_row", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("_added"))
    return rows.join(spans, "_row", "left").drop("_row"), None


def spans_of(text: str, known: dict[str, str] | None, added: list[dict] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of a text; ``added`` are those that were joined where no patterns were sent."""
    base = base_spans(text)
    out = [(s["kind"], s["start"], s["end"]) for s in added or ()]
    if known:
        for kind, a, b in occurrences(text, base):
            if kind is None and (k := next((known[p] for p in contexts(text, a, b) if p in known), None)):
                out.append((k, a, b))
    return base, out


def extract(spark: SparkSession, docs: DataFrame, rounds: int | None = None, support: int = SUPPORT, confident: float = CONFIDENT, sent: int = PATTERNS_SENT) -> DataFrame:
    """Personal data of every whole text, one row per row of ``docs``.

    Base spans always stay. Candidates (runs and groups with four digits or more, or an @
    or #, that no base span touches) become spans of a pattern's kind where the pattern around them is confident.
    A null or empty text has no span. Repeated rows are searched each; an empty table
    gives an empty result; extra columns are ignored. Returns doc_id, base and added:
    arrays of (kind, start, end) in code points, by start, then kind as listed.
    """
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    rows, held = added_spans(rows, patterns(spark, docs, rounds, support, confident), sent)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_structs = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def found(batches):
        known = held.value if held else None
        for batch in batches:
            both = [spans_of(t, known, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("_added").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_structs(b) for b, _ in both], span), pa.array([as_structs(a) for _, a in both], span)], ["doc_id", "base", "added"])

    return rows.mapInArrow(tidily(found), f"doc_id long, base {SPANS}, added {SPANS}")


def joined(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span's text replaced by its kind in brackets; of spans that overlap, the first to begin, the longest of those."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(spark: SparkSession, docs: DataFrame, sent: int = PATTERNS_SENT) -> DataFrame:
    """``docs`` with its texts redacted; n_chars, where there is one, follows; a null text stays null."""
    if "text" not in docs.columns:
        return docs
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("_whole"), doc_text(docs).alias("text"))
    rows, held = added_spans(plain, patterns(spark, docs), sent)

    def replaced(batches):
        known = held.value if held else None
        for batch in batches:
            whole = batch.column("_whole")
            columns = dict(zip(names, whole.flatten(), strict=True))
            texts = columns["text"].to_pylist()
            for i, (text, more) in enumerate(zip(texts, batch.column("_added").to_pylist(), strict=True)):
                base, added = spans_of(text, known, more) if text else ([], [])
                if base or added:
                    texts[i] = redact(text, base + added)
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return rows.mapInArrow(tidily(replaced), docs.schema)
