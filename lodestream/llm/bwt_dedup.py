"""Repeated byte strings across documents, by merging the transforms of shards.

The suffixes that take part begin at minimizers: in every string of ``LENGTH`` bytes the
``GRAM`` bytes of least hash. Equal strings have the same one at the same offset, so two
equal strings meet at their sampled suffix: they agree on the bytes before it and on those
behind it.

A shard (some MB of texts within a task) sorts its sampled suffixes and keeps, in that
order, the block of bytes before each: that is its Burrows-Wheeler transform with the
column widened from one byte to a block, since a sampled suffix is followed by the next
sampled one only a block later. Of equal entries it ships the first; the others repeat it
whole. Entries go out in runs, one for each range of first symbols (a symbol is a gram).

An owner task gets the runs of all shards for a range of symbols and merges them by
refining their interleave: it begins with the runs one after another within each symbol,
and each round looks eight bytes further, moves only suffixes that are still tied and
notes, where two part, their common prefix. The same on the column gives the common
endings of what precedes. Runs of common prefix >= d are the repeated intervals of depth d;
a string at offset o is repeated where an interval of depth LENGTH - o (counted with the
gram) and one of preceding depth o share two entries. No suffix is sorted against all others.

A symbol with very many entries is not one task's: the strings around it are compared as
wholes, in lots first (``first_of_each``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import doc_column, doc_text, materialise, small_batches, tidily
from .shingles import _powers, mix

LENGTH = 100
GRAM = 48
#: Bits of the filter of grams met more than once: 16 MB, whatever the corpus; a false hit costs time only.
FILTER_BITS = 27
#: Leading bits of a gram's hash that are counted; two grams with the same ones count as one, which costs time only.
COUNTED_BITS = 40
#: A gram with more entries is dealt out by whole strings, not by itself.
CROWDED = 4_000
#: Texts of a shard; entries that an owner merges at once; entries it holds at most before it deals out its crowded symbols.
SHARD_BYTES, OWNED, HELD = 8_000_000, 60_000, 200_000
#: Entries whose strings an owner compares at once.
AT_ONCE = 8_000
#: Lots in which equal whole strings are told apart before they meet.
LOTS = 64


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Of concatenated texts: (gram hash, place, first string, last string, text) of each sampled suffix."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    nothing = none.astype(np.uint64), none, none, none, none
    if n < length:
        return nothing
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, wide = length - gram + 1, 1
    while wide * 2 <= span:
        least = np.minimum(least[:len(least) - wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[:len(least) - (span - wide)], least[span - wide:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(place)), side="right")
    inside = np.flatnonzero(np.arange(len(place)) + length <= ends[np.minimum(text, len(ends) - 1)])
    if not len(inside):
        return nothing
    p = place[inside]
    cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    last = np.concatenate([cut[1:], [len(p)]]) - 1
    # The least of many hashes are small; mixed once more, they spread over owners and filter alike.
    return mix(h[p[cut]] + np.uint64(1)), p[cut], inside[cut], inside[last], text[inside[cut]]


def _batches(batches, most: int = 1_500_000):
    """(record batch, bytes of its texts end to end, their ends)."""
    for batch in batches:
        coded = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        start = size = 0
        for i in range(len(coded) + 1):
            if i == len(coded) or (size and size + len(coded[i]) > most):
                if i > start:
                    part = coded[start:i]
                    yield batch.slice(start, i - start), np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(c) for c in part])
                start, size = i, 0
            if i < len(coded):
                size += len(coded[i])


def interleave(blocks: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refines the interleave ``order``, whose neighbours of one ``group`` are tied, by ``blocks`` (rows of big-endian words).

    Returns the order and, per neighbour, in how many leading bytes it agrees with the one before (0 across groups).
    """
    n, rounds = blocks.shape
    common = np.zeros(n, np.int64)
    tied = np.concatenate([[False], group[1:] == group[:-1]])
    for r in range(rounds):
        ties = tied | np.concatenate([tied[1:], [False]])
        at = np.flatnonzero(ties)
        if not len(at):
            break
        word = blocks[order[at], r]
        run = np.cumsum(~tied)[at]
        moved = np.lexsort((word, run))
        order[at] = order[at][moved]
        word, run = word[moved], run[moved]
        same = np.concatenate([[False], (run[1:] == run[:-1]) & (word[1:] == word[:-1])])
        parted = np.concatenate([[False], run[1:] == run[:-1]]) & ~same
        differ = np.zeros(len(word), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        lead = np.zeros(len(word), np.int64)
        for k in range(1, 8):  # in integers: a logarithm rounds where one bit differs
            lead[parted] += differ[parted] < np.uint64(1 << 8 * k)
        common[at[parted]] = 8 * r + lead[parted]
        tied[at] = same
    common[tied] = 8 * rounds
    return order, common


def words_of(rows: np.ndarray) -> np.ndarray:
    return rows.view(">u8").astype(np.uint64)


class Entries:
    """Sampled suffixes with the blocks before them, as columns.

    A suffix is its symbol, 96 bits of the gram's bytes (``key`` and ``check``), and the
    bytes behind the gram (``right``). ``left`` is reversed, both sides are padded with zeros.
    """

    NAMES = ("key", "check", "d", "th", "at", "lefts", "rights", "left", "right")

    def __init__(self, *columns: np.ndarray):
        for name, column in zip(self.NAMES, columns, strict=True):
            setattr(self, name, column)

    def __len__(self) -> int:
        return len(self.key)

    def take(self, which: np.ndarray) -> Entries:
        return Entries(*(getattr(self, n)[which] for n in self.NAMES))

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in cls.NAMES))

    def rank(self) -> np.ndarray:
        """Their order in the corpus; the same for one place of a row that is there twice."""
        by = np.lexsort((self.at, self.th, self.d))
        new = np.concatenate([[False], (np.diff(self.d[by]) != 0) | (np.diff(self.th[by]) != 0) | (np.diff(self.at[by]) != 0)])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        return rank

    def by_symbol(self) -> tuple[Entries, np.ndarray]:
        """The entries by symbol, otherwise as they come, and the number of each one's symbol."""
        e = self.take(np.lexsort((self.check, self.key)))
        return e, np.cumsum(np.concatenate([[True], (e.key[1:] != e.key[:-1]) | (e.check[1:] != e.check[:-1])]))

    def strings(self, around: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) place of the strings of each entry; ``around`` bytes of a string aren't its gram's."""
        return self.at - self.lefts, self.at + self.rights - around

    def packed(self) -> bytes:
        """All columns in one compressed piece; of the blocks, the bytes that are there."""
        parts = [self.key, self.check, self.d, self.th, self.at, self.lefts.astype(np.uint16), self.rights.astype(np.uint16),
                 self.left[np.arange(self.left.shape[1]) < self.lefts[:, None]], self.right[np.arange(self.right.shape[1]) < self.rights[:, None]]]
        raw = b"".join(p.tobytes() for p in parts)
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)

    @classmethod
    def unpacked(cls, piece: bytes, n: int, width: int) -> Entries:
        raw = memoryview(pa.Codec("zstd").decompress(piece[8:], int.from_bytes(piece[:8], "little"), asbytes=True))
        columns, at = [], 0
        for kind in (np.uint64, np.uint32, np.int64, np.int64, np.int64, np.uint16, np.uint16):
            size = n * np.dtype(kind).itemsize
            columns.append(np.frombuffer(raw[at:at + size], kind))
            at += size
        columns[5:] = [c.astype(np.int64) for c in columns[5:]]
        for sizes in columns[5:7]:
            block = np.zeros((n, width), np.uint8)
            total = int(sizes.sum())
            block[np.arange(width) < sizes[:, None]] = np.frombuffer(raw[at:at + total], np.uint8)
            columns.append(block)
            at += total
        return cls(*columns)


def width_of(around: int) -> int:
    """Bytes of the blocks before and behind a gram, in whole words."""
    return -(-around // 8) * 8 or 8


def entries_at(raw: np.ndarray, begins: np.ndarray, found, which: np.ndarray, d: np.ndarray, th: np.ndarray, length: int, gram: int) -> Entries:
    """The entries of the sampled suffixes ``which`` of ``found`` (as ``anchors`` gives them)."""
    h, place, first, last, text = (c[which] for c in found)
    width, around = width_of(length - gram), length - gram
    padded = np.concatenate([raw, np.zeros(width + 8, np.uint8)])  # behind the last gram
    lefts, rights = place - first, last + around - place
    check = np.zeros(len(place), np.uint64)
    for k in range(0, gram, 8):
        word = words_of(np.ascontiguousarray(padded[place[:, None] + np.arange(k, k + 8)]))[:, 0]
        check = mix(check ^ mix((word if k + 8 <= gram else word >> np.uint64(8 * (k + 8 - gram))) + np.uint64(k + 3)))
    right = padded[place[:, None] + np.arange(gram, gram + width)]
    right[np.arange(width) >= rights[:, None]] = 0
    left = padded[np.maximum(place[:, None] - 1 - np.arange(width), 0)]
    left[np.arange(width) >= lefts[:, None]] = 0
    return Entries(h, check.astype(np.uint32), d[text], th[text], place - begins[text], lefts, rights, left, right)


def transform(entries: Entries) -> tuple[Entries, Entries]:
    """(the shard's transform: entries by key and suffix, equal ones once; those that repeat an earlier entry of the shard whole)."""
    e, group = entries.by_symbol()
    order, common = interleave(words_of(e.right), np.arange(len(e)), group)
    e, group = e.take(order), group[order]
    group = np.cumsum((common < e.right.shape[1]) | np.concatenate([[True], (np.diff(e.rights) != 0) | (np.diff(group) != 0)]))
    order, common = interleave(words_of(e.left), np.arange(len(e)), group)
    e, group = e.take(order), group[order]
    new = (common < e.left.shape[1]) | np.concatenate([[True], (np.diff(e.lefts) != 0) | (np.diff(group) != 0)])
    run, rank = np.cumsum(new), e.rank()
    by = np.lexsort((rank, run))
    heads = np.flatnonzero(np.concatenate([[True], np.diff(run[by]) != 0]))
    least = rank[by[heads]][run - 1]
    again = rank > least
    return e.take(by[heads]), e.take(np.flatnonzero(again))


def repeated_strings(e: Entries, group: np.ndarray, around: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, string) pairs of those strings of the entries, which come by symbol (``group``), that an entry of lower rank has, too."""
    n = len(e)
    rank = e.rank()
    off_high, off_low = e.lefts, around - e.rights
    alone = np.concatenate([[True], np.diff(group) != 0])
    alone &= np.append(alone[1:], True)
    orders, most = [], []
    for side in (e.right, e.left):
        order, common = interleave(words_of(side), np.arange(n), group)
        orders.append((order, common))
        nearest = np.empty(n, np.int64)
        nearest[order] = np.maximum(common, np.append(common[1:], 0))
        most.append(nearest)
    out_entry, out_string = [], []
    for o in range(int(off_low.min()), int(off_high.max()) + 1):
        has = np.flatnonzero((off_low <= o) & (o <= off_high) & ~alone & (most[0] >= around - o) & (most[1] >= o))
        if len(has) < 2:
            continue
        name = []
        for (order, common), depth in zip(orders, (around - o, o), strict=True):
            interval = np.empty(n, np.int64)
            new = common < depth
            new[0] = True
            new[1:] |= group[order][1:] != group[order][:-1]
            interval[order] = np.cumsum(new)
            name.append(interval[has])
        key = name[0] * (n + 1) + name[1]
        by = np.lexsort((rank[has], key))
        key = key[by]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        least = rank[has[by]][np.flatnonzero(start)][np.cumsum(start) - 1]
        again = by[rank[has[by]] > least]
        out_entry.append(has[again])
        out_string.append(e.at[has[again]] - o)
    if not out_entry:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_entry), np.concatenate(out_string)


_ROW = pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("piece", pa.binary()), ("d", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("name_a", pa.int64()), ("name_b", pa.int64())])
_ROWS = "bucket long, n int, piece binary, d long, th long, first long, last long, name_a long, name_b long"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)


def spread(d: np.ndarray, th: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Owners for rows that any owner may pass on: by place, so that neither copies nor common strings share one."""
    return mix((d ^ th).astype(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def runs_of(d: np.ndarray, th: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch | None:
    """Rows of runs of places; runs of one text that touch become one."""
    if not len(d):
        return None
    by = np.lexsort((first, th, d))
    d, th, first, last = d[by], th[by], first[by], last[by]
    text = np.cumsum(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(th) != 0)]))
    wide = int(last.max()) + 2
    reach = np.maximum.accumulate(last + text * wide) - text * wide
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] > reach[:-1] + 1)]))
    end = np.append(cut[1:], len(d)) - 1
    return _rows(bucket=spread(d[cut], th[cut], first[cut]), d=d[cut], th=th[cut], first=first[cut], last=reach[end])


def whole_strings(e: Entries, around: int, most: int = 500):
    """Rows of the single strings of crowded entries, by 128 bits of each: its gram, its offset and the bytes around the gram."""
    for lo in range(0, len(e), most):
        part = e.take(np.arange(lo, min(lo + most, len(e))))
        n = part.lefts + part.rights - around + 1
        i = np.repeat(np.arange(len(part)), n)
        back = part.lefts[i] - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        both = np.concatenate([part.left[:, ::-1], part.right], 1)
        rows = np.zeros((len(i), width_of(around)), np.uint8)
        rows[:, :around] = both[i[:, None], part.left.shape[1] - back[:, None] + np.arange(around)]
        a, b = mix(part.key[i] + back.astype(np.uint64)), mix((part.key[i] ^ (part.check[i].astype(np.uint64) << np.uint64(20))) * np.uint64(0xA0761D6478BD642F) + back.astype(np.uint64))
        for k, word in enumerate(words_of(rows).T):
            a = mix(a ^ mix(word + np.uint64(k + 1)))
            b = mix(b + mix(word * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k + 7)))
        a, b, q = a.view(np.int64), b.view(np.int64), part.at[i] - back
        yield _rows(bucket=spread(part.d[i], part.th[i], q), d=part.d[i], th=part.th[i], first=q, last=q, name_a=a, name_b=b)


def _gram_filter(spark: SparkSession, rows: DataFrame, length: int, gram: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bits of the grams met more than once, leading bits of the crowded ones in order, entries of repeated grams)."""
    power = max(4, (size // 4_000_000).bit_length())
    drop = np.uint64(64 - COUNTED_BITS)

    def grams(batches):
        held, n = [], 0

        def flush():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            bucket = (value >> np.uint64(COUNTED_BITS - power)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.append(cut[1:], len(value))
            pieces = []
            for a, b in zip(cut.tolist(), end.tolist(), strict=True):
                raw = np.diff(value[a:b], prepend=np.uint64(0)).tobytes() + np.minimum(times[a:b], 65_535).astype(np.uint16).tobytes()
                # Byte planes: of small numbers the upper ones are empty.
                planes = np.frombuffer(raw[:8 * (b - a)], np.uint8).reshape(-1, 8).T.tobytes() + raw[8 * (b - a):]
                pieces.append(pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array((end - cut).astype(np.int32)), pa.array(pieces, pa.binary())], ["bucket", "n", "piece"])

        for _, raw, ends in _batches(batches):
            h, *_ = anchors(raw, ends, length, gram)
            if len(h):
                held.append(h >> drop)
            n += len(raw)
            if n >= SHARD_BYTES and held:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def counted(batches):
        def settle(bucket, parts):
            value, times = (np.concatenate(c) for c in zip(*parts, strict=True))
            value, place = np.unique(value, return_inverse=True)
            times = np.bincount(place, weights=times).astype(np.int64)
            value, times = value[times > 1], times[times > 1]
            slot = np.unique(value >> np.uint64(COUNTED_BITS - FILTER_BITS)).astype(np.int64)
            word = slot >> 6
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), cut) if len(cut) else np.zeros(0, np.uint64)
            many = times > CROWDED
            return (bucket, word[cut].astype(np.int32).tobytes(), bits.tobytes(), int(times.sum()), value[many].astype(np.int64).tolist(), times[many].tolist())

        now, parts, out = None, [], []
        for batch in batches:
            for bucket, n, piece in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "piece")), strict=True):
                if bucket != now and parts:
                    out.append(settle(now, parts))
                    parts = []
                now = bucket
                raw = pa.Codec("zstd").decompress(piece, 10 * n, asbytes=True)
                value = np.cumsum(np.ascontiguousarray(np.frombuffer(raw[:8 * n], np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
                parts.append((value, np.frombuffer(raw[8 * n:], np.uint16)))
        if parts:
            out.append(settle(now, parts))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "words", "bits", "total", "crowded", "times"])

    met = rows.select("text").mapInArrow(tidily(grams), "bucket long, n int, piece binary").repartition("bucket").sortWithinPartitions("bucket")
    met = materialise(met.mapInArrow(tidily(counted), "bucket long, words binary, bits binary, total long, crowded array<long>, times array<long>"), "repeated-grams")
    filter_ = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    total = met.agg(F.sum("total")).first()[0] or 0
    # Together at most the filter's 16 MB, and its words' places.
    for r in met.select("words", "bits").toLocalIterator():
        filter_[np.frombuffer(r["words"], np.int32)] |= np.frombuffer(r["bits"], np.uint64)
    # At most 50,000 grams can have more than a 50,000th of all entries each; what is crowded below that, owners deal out.
    most = met.select(F.explode(F.arrays_zip("crowded", "times")).alias("c")).where(F.col("c.times") > max(CROWDED, total // 50_000))
    crowded = np.sort(np.array([r[0] for r in most.select("c.crowded").collect()], np.uint64))
    return filter_, crowded, total


def repeated_runs(spark: SparkSession, rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, th, first, last): runs of places, in the text of (d, th), at which a string begins that begins earlier, too."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits, crowded, total = _gram_filter(spark, rows, length, gram, size)
    held = spark.sparkContext.broadcast((bits, crowded))
    power = max(3, (total // OWNED).bit_length())
    shard_bytes, most_held, most_entries = SHARD_BYTES, HELD, CROWDED
    around, width = length - gram, width_of(length - gram)

    def shards(batches):
        bits, crowded = held.value

        def flush(parts):
            entries = Entries.joined(parts)
            parts.clear()
            run, again = transform(entries)
            first, last = again.strings(around)
            if (repeats := runs_of(again.d, again.th, first, last)) is not None:
                yield repeats
            many = np.isin(run.key >> np.uint64(64 - COUNTED_BITS), crowded)
            yield from whole_strings(run.take(np.flatnonzero(many)), around)
            run = run.take(np.flatnonzero(~many))
            bucket = (run.key >> np.uint64(64 - power)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(run) else np.zeros(0, np.int64)
            end = np.append(cut[1:], len(run)) if len(run) else cut
            if len(cut):
                pieces = [run.take(np.arange(a, b)).packed() for a, b in zip(cut.tolist(), end.tolist(), strict=True)]
                yield _rows(bucket=bucket[cut], n=(end - cut).astype(np.int32), piece=pieces)

        parts, n = [], 0
        for batch, raw, ends in _batches(batches):
            found = anchors(raw, ends, length, gram)
            slot = found[0] >> np.uint64(64 - FILTER_BITS)
            which = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
            if len(which):
                begins = np.concatenate([[0], ends[:-1]])
                parts.append(entries_at(raw, begins, found, which, batch.column("d").to_numpy(), batch.column("th").to_numpy(), length, gram))
            n += len(raw)
            if n >= shard_bytes and parts:
                yield from flush(parts)
                n = 0
        if parts:
            yield from flush(parts)

    def merged(batches):
        def settle(parts):
            e = Entries.joined(parts)
            parts.clear()
            e, group = e.by_symbol()
            n = np.bincount(group)
            yield from whole_strings(e.take(np.flatnonzero(n[group] > most_entries)), around)
            some = np.flatnonzero((n[group] > 1) & (n[group] <= most_entries))
            # Some symbols at a time, which bounds the pairs of entries and strings.
            part = np.arange(len(some)) // AT_ONCE
            part = part[np.searchsorted(group[some], group[some])]
            for cut in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
                these = e.take(cut)
                entry, string = repeated_strings(these, group[cut], around)
                if (out := runs_of(these.d[entry], these.th[entry], string, string)) is not None:
                    yield out

        now, parts, size, apart = None, [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            through = batch.filter(pc.is_null(batch.column("piece")))
            if through.num_rows:
                yield through
            batch = batch.filter(pc.is_valid(batch.column("piece")))
            for bucket, n, piece in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "piece")), strict=True):
                if bucket != now:
                    if parts:
                        yield from settle(parts)
                    now, parts, size, apart = bucket, [], 0, np.zeros(0, np.uint64)
                e = Entries.unpacked(piece, n, width)
                if len(apart):
                    many = np.isin(e.key, apart)
                    yield from whole_strings(e.take(np.flatnonzero(many)), around)
                    e = e.take(np.flatnonzero(~many))
                parts.append(e)
                size += len(e)
                if size > most_held:  # symbols with too many entries for one task are dealt out by whole strings
                    e = Entries.joined(parts)
                    key, times = np.unique(e.key, return_counts=True)
                    apart = np.union1d(apart, key[times > most_entries])
                    many = np.isin(e.key, apart)
                    yield from whole_strings(e.take(np.flatnonzero(many)), around)
                    parts = [e.take(np.flatnonzero(~many))]
                    size = 0  # looked at again after so many more
        if parts:
            yield from settle(parts)

    owned = rows.mapInArrow(tidily(shards), _ROWS).repartition("bucket").sortWithinPartitions("bucket")
    found = materialise(owned.mapInArrow(tidily(merged), _ROWS), "repeated-runs")
    runs = found.where("name_a is null").select("d", "th", "first", "last")
    wholes = found.where("name_a is not null").select("name_a", "name_b", "d", "th", "first")
    return runs.unionByName(first_of_each(wholes).select("d", "th", "first", F.col("first").alias("last")))


def first_of_each(strings: DataFrame, lots: int = LOTS) -> DataFrame:
    """The places of ``strings`` (name_a, name_b, d, th, first) whose string begins earlier, too.

    Equal strings are ordered within ``lots`` lots first; only the first of each lot go on,
    so no task holds all places of a string.
    """
    place = ["d", "th", "first"]
    lot = F.pmod(F.xxhash64(*place), F.lit(lots))
    rank = lambda by: F.dense_rank().over(W.partitionBy(*by).orderBy(*place))
    dealt = strings.withColumn("lot", lot).withColumn("nth", rank(["name_a", "name_b", "lot"]))
    heads = dealt.where("nth = 1").drop("nth").withColumn("nth", rank(["name_a", "name_b"]))
    return dealt.where("nth > 1").unionByName(heads.where("nth > 1")).select(*place)


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every text without the bytes of strings of ``length`` bytes that also start earlier, one row per row of ``docs``.

    Earlier is a smaller doc_id, or an earlier start in the same text; a null id comes
    before all others. Rows that share a doc_id are ordered by a hash of their texts, and
    of rows equal in both, all but one repeat the other whole. A null text is empty; a
    text of fewer than ``length`` bytes stays whole; an empty table gives an empty result;
    extra columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans, kept (binary).
    """
    small_batches(spark)
    text = doc_text(docs)
    doc_id = doc_column(docs, "doc_id", "long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = repeated_runs(spark, rows.where(F.octet_length("text") >= length), length, gram)
    runs = runs.groupBy("d", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    all_ = rows.join(runs, ["d", "th"], "left").withColumn("copy", F.row_number().over(W.partitionBy("d", "th").orderBy(F.lit(0))))
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, spans, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs", "copy")), strict=True):
                coded = text.encode("utf-8", "surrogatepass")
                if copy > 1 and len(coded) >= length:
                    spans = [{"first": 0, "last": len(coded) - length}]
                kept, at, n_spans = [], 0, 0
                for a, b in sorted((s["first"], s["last"] + length) for s in spans or []):
                    if a > at or not n_spans:
                        n_spans += 1
                        kept.append(coded[at:a])
                    at = max(at, b)
                kept.append(coded[at:])
                kept = b"".join(kept)
                out.append((doc, len(coded), len(coded) - len(kept), n_spans, kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return all_.select("doc_id", "text", "runs", "copy").mapInArrow(tidily(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
