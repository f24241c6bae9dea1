"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS[0]) < n:
        m = len(_POWERS[0])
        for i, base in enumerate((BASE, INVERSE)):
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(base, m, 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); A-Z lower-cased, words without ASCII white space."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    text_end = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(begin, text_end)]))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Per text the ascending distinct hashes of its shingles; with fewer words than ``words``, of the whole sequence as one."""
    hashes, n = word_hashes(texts)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    sums = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        sums += padded[j:j + len(hashes)] * PLACES[j % len(PLACES)]
    rolled = mix(sums)
    out, at = [], 0
    for k in n.tolist():
        if k >= words:
            out.append(np.unique(rolled[at:at + k - words + 1]))
        elif k:
            out.append(mix((hashes[at:at + k] * PLACES[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out
