"""Words and rolling hashes of many documents at once, on their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
M64 = 2**64
#: The odd factors of the hashes.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Bytes that end a word: ASCII white space; or all of ASCII but digits and small letters.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NOT_PLAIN = np.zeros(256, bool)
NOT_PLAIN[[*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def split(data: np.ndarray, offs: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each document (one more entry than documents)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~ends_word[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    start[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


LANE = np.array([(1 << 8 * i) - 1 for i in range(8)] + [M64 - 1], np.uint64)
#: Longer words are hashed by blake2b.
LONG_WORD = 256


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64 bits for each word: eight bytes at a time, all mixed before the next eight; blake2b for very long words."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    size = e - s
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix((lanes[s] & LANE[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * U(BASE)))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG_WORD:
        h[more] = mix(h[more] * U(BASE2) + (lanes[s[more] + at] & LANE[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams(h: np.ndarray, n: int, base: int = BASE2) -> np.ndarray:
    """A hash of every n consecutive values, of their type (64 or 32 bits); not mixed."""
    if n == 1:
        return h
    k = n // 2
    a = grams(h, k, base)
    b = a if n - k == k else grams(h, n - k, base)
    m = max(0, len(h) - n + 1)
    return a[:m] * h.dtype.type(pow(base, n - k, 1 << 8 * h.itemsize)) + b[k : k + m]


def mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def lane_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each data[at:at + size], eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = np.full(len(at), size * BASE % M64, np.uint64)
    for i in range(0, size, 8):
        h = mix(h * U(BASE2) + (lanes[at + i] & LANE[min(8, size - i)]))
    return h


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words (A-Z lowered, split at white space) of each text, and where each text's begin.

    A text of fewer words, but not none, has one: of all its words.
    """
    data = LOWER[data]
    s, e, first = split(data, offs, SPACE)
    h = word_hashes(data, s, e)
    count = np.diff(first)
    g = mix(grams(h, n)) if len(h) >= n else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(h), bool)
    whole[: len(g)] = True
    last = np.repeat(first[1:], count)
    whole &= np.arange(len(h)) + n <= last
    whole[first[short]] = True
    value = np.zeros(len(h), np.uint64)
    value[: len(g)] = g
    for i in range(1, n):
        some = short[count[short] == i]
        if len(some):
            value[first[some]] = mix(grams(h, i)[first[some]] + U(i * BASE % M64))
    at = np.concatenate([[0], np.cumsum(whole)])[first]
    return value[whole], at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    m = max(0, len(x) - w + 1)
    have, size = x, 1
    while 2 * size <= w:
        have, size = np.minimum(have[:-size], have[size:]), 2 * size
    return np.minimum(have[:m], have[w - size : w - size + m]) if size < w else have[:m]
