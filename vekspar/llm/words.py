"""Words and word shingles of whole texts, as 64-bit hashes, a batch of texts at a time.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text. A shingle is five
words in a row; a text of one to four words has one shingle, made of all of them; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WIDTH = 5
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x100000001B3
_STEP = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)], dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets at which each text's words begin (one more at the end)."""
    enc = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(enc) + b"\n", np.uint8)
    is_word = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(is_word) and is_word[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    text_end = np.cumsum([len(x) + 1 for x in enc])
    offsets = np.r_[0, np.searchsorted(starts, text_end)]
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    letters = buf[is_word].astype(np.uint64) + np.uint64(1)
    at = np.arange(len(letters)) - np.repeat(first, lens)
    return mix(np.add.reduceat(letters * powers(int(lens.max()) + 1)[at], first)), offsets


def shingles(w: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and each text's offsets into them."""
    n = np.diff(offsets)
    total = len(w)
    pad = np.r_[w, np.zeros(width, np.uint64)]
    s = np.zeros(total, np.uint64)
    for j in range(width):
        s += pad[j : j + total] * _STEP[j]
    for i in np.flatnonzero((n > 0) & (n < width)):
        a, b = offsets[i], offsets[i + 1]
        s[a] = (w[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    left = np.repeat(offsets[1:], n) - np.arange(total)
    keep = (left >= width) | (np.arange(total) == np.repeat(offsets[:-1], n)) if total else np.zeros(0, bool)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    return mix(s[keep]), np.r_[0, np.cumsum(count)]


def per_text(x: np.ndarray, offsets: np.ndarray, fn: np.ufunc, empty: int = 0) -> np.ndarray:
    """fn.reduce over each text's part of x."""
    out = np.full(len(offsets) - 1, empty, x.dtype)
    has = np.flatnonzero(np.diff(offsets))
    if len(has):
        out[has] = fn.reduceat(x, offsets[:-1][has])
    return out
