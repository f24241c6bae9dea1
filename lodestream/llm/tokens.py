"""Encoding of whole texts with a tokenizer of the ``tokenizers`` library, inside a task.

Words repeat, so a batch's space-delimited chunks are told apart by Arrow, and only those
not met before go to the library, many in one call. Where a text's chunks would not encode
as they do in the text, the library gets the whole text. The table of chunks is per worker
process and bounded.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in a worker's table; when it is full, it is begun anew.
REMEMBERED = 900_000
#: Chunks that the library gets in one text.
JOINED = 500
#: A sign that no joined chunk holds and that is one token.
APART = "~"
#: A mark after a word of letters only is a token of its own for either pre-tokenizer.
MARKS = frozenset(".,;:!?")
#: A space between white spaces, or after one at the end: the pre-tokenizer joins these.
JOINED_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Python and Arrow split at these, the tokenizer doesn't.
SEPARATORS = "[\x1c-\x1f]"
_OPEN: dict[tuple, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts to unsigned 32-bit ids in the machine's order (little-endian where Spark runs), without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A word-end vocabulary drops white space; a byte-level one keeps it with the word that follows.
        self.drops_space = bool(self.tokenizer.model.end_of_word_suffix)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word, or else those that begin with a space
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith("Ġ"))]] = True
        apart = self.tokenizer.encode(APART if self.drops_space else " " + APART, add_special_tokens=False).ids
        self.apart = apart[0] if len(apart) == 1 else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and not self.drops_space else None
        self.closed: dict[str, bool] = {}
        self.forget()

    @classmethod
    def open(cls, path: str) -> ChunkEncoder:
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def forget(self) -> None:
        """Row r of the table is the ids ``pool[first[r]:first[r] + count[r]]``; row 0 is empty."""
        self.known: dict[str, int] = {}
        self.heads: dict[str, int] = {}  # words that begin a line
        self.pool = np.zeros(1 << 16, np.uint32)
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows, self.held = 1, 0
        self.marks = dict(zip(sorted(MARKS), self._put(*self._whole(sorted(MARKS))), strict=True))
        self.marks |= {"": 0, "\n": self._put(*self._whole(["\n"]))[0]}

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text), as the library encodes them one by one."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks without white space that are a pre-token each or begin one, joined into few texts."""
        space = "" if self.drops_space else " "
        lots = [chunks[i:i + JOINED] for i in range(0, len(chunks), JOINED)]
        ids, counts = [], []
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([space + " ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            these = np.array(e.ids, np.uint32)
            edges = np.flatnonzero(self.edge[these])
            if len(edges) == len(lot):
                ids.append(these)
                counts.append(np.diff(edges, prepend=-1) if self.drops_space else np.diff(edges, append=len(these)))
            else:  # a letter for Python that is none for the library
                one = self._whole([space + c for c in lot])
                ids.append(one[0])
                counts.append(one[1])
        return np.concatenate(ids), np.concatenate(counts)

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks of any number of pre-tokens without APART, which is put behind each."""
        space = "" if self.drops_space else " "
        lots = [chunks[i:i + JOINED] for i in range(0, len(chunks), JOINED)]
        ids, counts = [], []
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([space + f" {APART} ".join(lot) + f" {APART}" for lot in lots], add_special_tokens=False), strict=True):
            these = np.array(e.ids, np.uint32)
            apart = these == self.apart
            at = np.flatnonzero(apart)
            ids.append(these[~apart])
            counts.append(np.diff(at, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(counts)

    def _heads(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters without a space before them, a line each: a line's end is a token of its own and in no word."""
        lots = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        ids, counts = [], []
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast(["\n".join(lot) + "\n" for lot in lots], add_special_tokens=False), strict=True):
            these = np.array(e.ids, np.uint32)
            ends = these == self.line
            ids.append(these[~ends])
            counts.append(np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(counts)

    def _put(self, ids: np.ndarray, counts: np.ndarray) -> range:
        """Appends rows to the table."""
        rows = range(self.rows, self.rows + len(counts))
        while self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while rows.stop > len(self.first):
            self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count))
        self.pool[self.held:self.held + len(ids)] = ids
        self.first[rows.start:rows.stop] = self.held + np.cumsum(counts) - counts
        self.count[rows.start:rows.stop] = counts
        self.rows, self.held = rows.stop, self.held + len(ids)
        return rows

    def _closes(self, letter: str) -> bool:
        """Whether a word that ends in ``letter`` ends in a letter when normalised, too; a combining mark there would go with what follows."""
        if letter not in self.closed:
            normal = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
            self.closed[letter] = normal[-1:].isalpha()
        return self.closed[letter]

    def _word(self, chunk: str) -> str:
        """The word of a chunk that is letters, perhaps with a mark behind them; else an empty text."""
        word = chunk[:-1] if chunk[-1:] in MARKS else chunk
        return word if word.isalpha() and (word == chunk or word[-1] < "\x80" or self._closes(word[-1])) else ""

    def _learn(self, new: list[str]) -> None:
        """Gives chunks their rows: alike ones in one call, a word with a mark behind it and words on two lines from their parts."""
        space = "" if self.drops_space else " "
        lined = []
        if self.line is not None:
            for c in new:
                before, end, after = c.partition("\n")
                if end and (last := self._word(before)) and (first := self._word(after)):
                    lined.append((c, last, before[len(last):], first, after[len(first):]))
        if lined:
            new = list({w for _, w, *_ in lined}.difference(self.known).union(new).difference([c for c, *_ in lined]))
            heads = list({w for *_, w, _ in lined}.difference(self.heads))
            if heads:
                self.heads.update(zip(heads, self._put(*self._heads(heads)), strict=True))
        marked = [c for c in new if c[-1:] in MARKS and c[:-1].isalpha() and (c[-2] < "\x80" or self._closes(c[-2]))]
        stems = {c[:-1] for c in marked}.difference(self.known)
        rest = stems.union(new).difference(marked)
        if self.drops_space:
            plain = [c for c in rest if c.isalpha()]
        else:
            plain = [c for c in rest if c.isalpha() or c.split() == [c]]
        odd = rest.difference(plain)
        between = [c for c in odd if c and APART not in c and not c[0].isspace() and not c[-1].isspace()] if self.apart is not None else []
        odd = list(odd.difference(between))
        if between:
            self.known.update(zip(between, self._put(*self._apart(between)), strict=True))
        if plain:
            self.known.update(zip(plain, self._put(*self._together(plain)), strict=True))
        if odd:
            self.known.update(zip(odd, self._put(*self._whole([space + c for c in odd])), strict=True))
        if marked:
            known = self.known
            a = np.array([known[c[:-1]] for c in marked], np.int64)
            b = np.array([self.marks[c[-1]] for c in marked], np.int64)
            both = np.stack([a, b], 1).ravel()
            known.update(zip(marked, self._put(self._ids(both), self.count[a] + self.count[b]), strict=True))
        if lined:
            parts = np.array([(self.known[a], self.marks[m], self.marks["\n"], self.heads[b], self.marks[n]) for _, a, m, b, n in lined], np.int64)
            self.known.update(zip([c for c, *_ in lined], self._put(self._ids(parts.ravel()), self.count[parts].sum(1)), strict=True))

    def _ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of ``rows`` of the table, end to end."""
        n = self.count[rows]
        total = int(n.sum())
        return self.pool[np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(total)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text); a null text has none."""
        if len(self.known) + len(self.heads) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.drops_space:
            whole |= pc.match_substring_regex(texts, SEPARATORS).to_numpy(zero_copy_only=False)
            split = pc.utf8_split_whitespace(texts)
        else:
            split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy()
        chunks = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        names, place = chunks.dictionary.to_numpy(zero_copy_only=False), chunks.indices.to_numpy()
        row_of = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(row_of < 0)
        new = names[missing].tolist()
        if self.drops_space and "" in new:
            self.known[""] = 0
            new.remove("")
        if new:
            self._learn(new)
        row_of[missing] = np.fromiter(map(self.known.__getitem__, names[missing]), np.int64, len(missing))
        kept_rows, kept_held = self.rows, self.held
        rows = row_of[place]
        if not self.drops_space:
            spaced = pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(chunks.dictionary)), pc.binary_length(chunks.dictionary))
            empty = pc.equal(pc.binary_length(chunks.dictionary), 0).to_numpy(zero_copy_only=False)
            starts, ends = empty.copy(), empty.copy()
            for i in np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist():
                starts[i], ends[i] = names[i][0].isspace(), names[i][-1].isspace()
            # White space, a space, then white space or the end: no chunk's own doing.
            before = ends[place]
            before[at[:-1]] &= ~empty[place[at[:-1]]]
            joined = before[:-1] & starts[place[1:]]
            joined[at[1:-1] - 1] = False
            whole[np.searchsorted(at, np.flatnonzero(joined), side="right") - 1] = True
            heads = np.flatnonzero(~whole)
            rows[at[heads]] = self._put(*self._whole([names[i] for i in place[at[heads]]])) if len(heads) else 0
        odd = np.flatnonzero(whole)
        if len(odd):
            put = self._put(*self._whole(texts.take(pa.array(odd)).to_pylist()))
            for t, r in zip(odd.tolist(), put, strict=True):
                rows[at[t]:at[t + 1]] = 0
                rows[at[t]] = r
        total = np.concatenate([[0], np.cumsum(self.count[rows])])
        out = self._ids(rows), np.diff(total[at])
        self.rows, self.held = kept_rows, kept_held  # heads and whole texts aren't kept
        return out

    def encode_with_end(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encode(texts)
        if end_id is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def as_binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array with the little-endian ids of each text."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


def slices(batches, most_bytes: int = 8_000_000):
    """Arrow batches in slices of at most ``most_bytes`` bytes of ``text``, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def batched_texts(batches, most_chars: int = 2_000_000):
    """(record batch, texts) of Arrow batches in slices of at most ``most_chars`` characters, one row at least."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        texts = ["" if t is None else t for t in texts]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most_chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
