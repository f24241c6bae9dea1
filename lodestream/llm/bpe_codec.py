"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by merging bytes on a heap."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .shared import doc_column, doc_text, small_batches, tidily
from .tokens import JOINED_SPACE, batched_texts

#: Chunks in each of a worker's two tables.
REMEMBERED = 250_000


class PerfectHash:
    """A minimal perfect hash by bucket displacement: n keys have the n slots 0 to n-1.

    Keys fall into buckets; buckets, largest first, get the first displacement at which
    all their keys land in free slots, and a bucket of one key is sent to any free slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.jump = np.zeros(self.buckets, np.int64)
        self.at = [-1] * self.n
        members: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        free = np.ones(self.n, bool)
        order = np.random.default_rng(1).permutation(self.n)
        single, begin = [], 0
        for b, ids in sorted(members.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(ids) == 1:
                single.append((b, ids[0]))
                continue
            first = np.array([(hashes[i] >> 32) % self.n for i in ids])
            second = np.array([(hashes[i] >> 80) % self.n for i in ids])
            for tried in range(1 << 16):
                jump, begin = tried // 64, (begin + 1024) % self.n
                place = (first + jump * second) % self.n
                if len(set(place.tolist())) < len(ids):
                    continue
                # Shifts that send the first key to a free slot; the other keys need one too.
                shifts = order[begin:begin + 1024]
                shifts = (shifts[free[shifts]] - place[0]) % self.n
                fits = free[(place[:, None] + shifts) % self.n].all(0)
                if fits.any():
                    shift = int(shifts[fits.argmax()])
                    break
            else:
                raise ValueError("two keys have one hash")
            slots = (place + shift) % self.n
            free[slots] = False
            self.jump[b], self.shift[b] = jump, shift
            for i, s in zip(ids, slots.tolist(), strict=True):
                self.at[s] = i
        for (b, i), s in zip(single, np.flatnonzero(free).tolist(), strict=False):
            self.shift[b] = (s - (hashes[i] >> 32)) % self.n
            self.at[s] = i
        self.shift, self.jump = self.shift.tolist(), self.jump.tolist()

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        b = h % self.buckets
        return ((h >> 32) + self.shift[b] + self.jump[b] * ((h >> 80) % self.n)) % self.n


class Codec:
    """Encodes as the rank file's library would, without special tokens, and decodes.

    ``ranks`` maps each token's bytes to its id; every single byte must be a token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.hash = PerfectHash(self.tokens)
        most = max(self.ids) + 1
        self.length, self.first = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        at = 0
        for t, i in ranks.items():
            self.length[i], self.first[i] = len(t), at
            at += len(t)
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def lookup(self, word: bytes) -> int:
        """The id of a whole token, or -1."""
        i = self.hash.at[self.hash.slot(word)]
        return self.ids[i] if i >= 0 and self.tokens[i] == word else -1

    def merge(self, word: bytes) -> list[int]:
        """Joins, again and again, the pair of lowest rank, the leftmost of equals.

        Parts are linked by the offsets of their ends and beginnings; the heap holds
        pairs as they arise, and one whose parts have changed since is passed over.
        """
        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return out

    def encode_chunk(self, text: str) -> str:
        """Decimal ids, each followed by a comma."""
        out = []
        for word in self.pattern.findall(text):
            coded = word.encode("utf-8", "replace")
            i = self.lookup(coded)
            out += [i] if i >= 0 else self.merge(coded)
        return "".join([f"{i}," for i in out])

    def encode(self, texts: list[str]) -> list[str]:
        """Per text its decimal ids joined by commas. A chunk after a space is coded once and then remembered."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [None if JOINED_SPACE.search(t) else t.split(" ") for t in texts]
        for c in set().union(*(c[1:] for c in split if c)).difference(known):
            known[c] = older.get(c) or self.encode_chunk(" " + c)
        return [
            (self.encode_chunk(t) if c is None else self.encode_chunk(c[0]) + "".join(map(known.__getitem__, c[1:])))[:-1]
            for t, c in zip(texts, split, strict=True)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        total = int(length.sum())
        at = np.repeat(self.first[ids] - (np.cumsum(length) - length), length) + np.arange(total)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def _open(path: str, pattern: str) -> Codec:
    return Codec.load(path, pattern)


def encode_and_decode(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again, one row per row of ``docs``.

    A null text counts as empty, and an empty text has no ids; repeated rows are coded
    each; an empty table gives an empty result; extra columns are ignored. Returns
    doc_id, ids (decimal, joined by commas), n_tokens and decoded (binary).
    """
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.string()), ("n_tokens", pa.int64()), ("decoded", pa.binary())])

    def coded(batches):
        codec = _open(rank_path, pattern)
        for batch, texts in batched_texts(batches):
            joined = codec.encode(texts)
            ids = [np.fromstring(j, np.int64, sep=",") if j else np.zeros(0, np.int64) for j in joined]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(joined, pa.string()), pa.array([len(i) for i in ids]), pa.array([codec.decode(i) for i in ids], pa.binary())], schema=fields)

    small_batches(spark)
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    return rows.mapInArrow(tidily(coded), "doc_id long, ids string, n_tokens long, decoded binary")


def digests(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The operator's ids and bytes as SHA-256 digests, taken in the task, so that they don't cross to the JVM."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def coded(batches):
        codec = _open(rank_path, pattern)
        for batch, texts in batched_texts(batches):
            joined = codec.encode(texts)
            ids = [np.fromstring(j, np.int64, sep=",") if j else np.zeros(0, np.int64) for j in joined]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) for i in ids]),
                pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined]),
                pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids])], schema=fields)

    small_batches(spark)
    rows = docs.select(doc_column(docs, "doc_id", "long").alias("doc_id"), doc_text(docs).alias("text"))
    return rows.mapInArrow(tidily(coded), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
