"""Simple-8b word-aligned coding of token ids, encoded and decoded by whole arrays."""

from __future__ import annotations

import numpy as np

#: Selector -> (bits of an id, ids in a word). The selector is the word's top four bits.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (0, 240)]
BITS = np.array([b for b, _ in SELECTORS])
COUNTS = np.array([n for _, n in SELECTORS] + [0])
#: Larger ids are escapes: a zero stands in the words, position and id beside them.
ESCAPE_FROM = 1 << 20
_STEPS = COUNTS.astype(np.uint8)
#: Bits of each smaller id.
_LENGTH = np.frexp(np.arange(ESCAPE_FROM, dtype=float))[1].astype(np.uint8)
#: The position of every so manieth word's first id is stored.
STRIDE = 512


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(words, offsets, escapes) of unsigned ids, all little-endian.

    Greedy: each word takes the selector that fits most of the ids that follow. The
    last word may be partly filled; the reader knows the number of ids.
    """
    values = ids.astype(np.uint64)
    large = np.flatnonzero(values >= ESCAPE_FROM)
    escapes = np.stack([large.astype("<u8"), values[large]], 1).astype("<u8").tobytes() if len(large) else b""
    if len(large):
        values = values.copy()
        values[large] = 0
    n = len(values)
    if not n:
        return b"", b"", escapes
    chosen = np.full(n, 2, np.uint8)  # every id below ESCAPE_FROM fits 20 bits
    length = _LENGTH[values]
    widest, held = length, 1  # of each id and the ones behind it, so many in all
    for s in range(3, len(SELECTORS)):
        bits, count = SELECTORS[s]
        if n < count:
            break
        while held < count:  # two overlapping stretches make one of up to twice the length
            ahead = min(held, count - held)
            widest, held = np.maximum(widest[:-ahead], widest[ahead:]), held + ahead
        fits = widest <= bits
        if not fits.any():
            break
        head = chosen[: n - count + 1]
        np.maximum(head, fits.view(np.uint8) * np.uint8(s), out=head)
    step = _STEPS[chosen].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s in np.unique(selectors):
        bits, count = SELECTORS[s]
        if bits:
            at = np.flatnonzero(selectors == s)
            for j in range(count):
                words[at] |= padded[starts[at] + j] << np.uint64(bits * j)
    return words.astype("<u8").tobytes(), starts[::STRIDE].astype("<u4").tobytes(), escapes


def decode(words: bytes, escapes: bytes, n: int, first_word: int = 0, first_id: int = 0) -> np.ndarray:
    """The ``n`` ids that begin at word ``first_word``, whose first id has position ``first_id``."""
    packed = np.frombuffer(words, "<u8")[first_word:]
    selectors = (packed >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint64)
    for s in np.unique(selectors):
        bits, count = SELECTORS[s]
        if bits:
            at = np.flatnonzero(selectors == s)
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                out[starts[at] + j] = (packed[at] >> np.uint64(bits * j)) & mask
    out = out[:n].copy()
    if escapes:
        where = np.frombuffer(escapes, "<u8").reshape(-1, 2)
        at = where[:, 0].astype(np.int64) - first_id
        here = (at >= 0) & (at < len(out))
        out[at[here]] = where[here, 1]
    return out


def decode_range(words: bytes, offsets: bytes, escapes: bytes, n: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the ``n`` of a block; the offsets tell which strides of words hold them."""
    begins = np.frombuffer(offsets, "<u4").astype(np.int64)
    start, stop = max(0, start), min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    a, b = int(np.searchsorted(begins, start, side="right")) - 1, int(np.searchsorted(begins, stop, side="left"))
    first, last = int(begins[a]), n if b == len(begins) else int(begins[b])
    part = words[8 * STRIDE * a:] if b == len(begins) else words[8 * STRIDE * a:8 * STRIDE * b]
    return decode(part, escapes, last - first, first_id=first)[start - first:stop - first]


def decode_by_offsets(words: bytes, offsets: bytes, escapes: bytes, n: int, strides: int = 64) -> np.ndarray:
    """All ``n`` ids of a block, so many strides of words at a time, which bounds the arrays that decoding needs."""
    begins = np.frombuffer(offsets, "<u4").astype(np.int64)
    cuts = [*begins[::strides].tolist(), n]
    return np.concatenate([decode_range(words, offsets, escapes, n, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [np.zeros(0, np.uint64)])
