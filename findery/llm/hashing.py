"""Hashes of tokens and windows of many texts at once, as numpy arrays.

Strings are hashed by mixing words of 8 bytes one into another, which has no algebraic structure that texts can share:
a polynomial modulo 2^64 alone gives all Thue-Morse strings and their complements one value. Two different strings
share a hash of 64 bits with a chance of 2^-64; where all of a corpus meets, ``prefix`` and ``window`` give further,
independent bits.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

from .common import is_space_table, lower_table, mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: A random word for each byte, so that no bytes are alike in the low bits.
CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first 0 to 8 bytes of a word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LONG = 128  # longer strings are hashed one by one

SPACE = is_space_table()
LOWER = lower_table()
#: Bytes outside tokens of letters and digits; all beyond ASCII counts as letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a word; zeros beyond the end. One place more than there are bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).astype(np.uint64)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    size = end - start
    at = loads(data)
    h = mix64(size.astype(np.uint64) + np.uint64(_BASE))
    live = np.arange(len(start))
    for k in range(0, _LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            return h
        word = at[start[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]
        h[live] = mix64((h[live] ^ word) * _PAIR)
    for i in live[size[live] > _LONG].tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Spans:
    """Hashes of all stretches of a size, from those of half the size."""

    def __init__(self, data: np.ndarray):
        self.size, self.words, self.have = len(data), loads(data), {}

    def of(self, size: int) -> np.ndarray:
        """One for each start: len(data) - size + 1."""
        places = self.size - size + 1
        if places <= 0:
            return np.zeros(0, np.uint64)
        if size <= 8:
            return mix64(self.words[:places] & _FIRST[size])
        half = 1 << (size - 1).bit_length() - 1
        if size == 2 * half and size in self.have:
            return self.have[size]
        h = self.of(half)
        out = mix64(h[:places] * _PAIR + h[size - half : size - half + places])
        if size == 2 * half:
            self.have[size] = out
        return out


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE, np.uint64), np.full(1 << bits, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which ``window`` takes the hash of any stretch."""
    up, _ = _powers(max(20, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:end], spread over all bits: further bits beside a hash of another kind."""
    _, down = _powers(max(20, int(len(sums) - 1).bit_length()))
    return mix64((sums[end] - sums[start]) * down[start])


def bounds_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all tokens, and the bounds of each text's tokens among them."""
    gap = separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end ends its last token
    solid = ~gap
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        before |= edge[:-1]
        after |= edge[1:]
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, offsets) if len(offsets) > 1 else np.zeros(1, np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts and the bounds of each text's tokens among them."""
    start, end, bounds = bounds_of(data, offsets, separator)
    return strings(LOWER[data] if lower else data, start, end), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words (over the ends of texts too: the caller drops those)."""
    m = max(len(words) - k + 1, 0)
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = mix64(h * _PAIR + words[i : i + m])
    return h
