"""Encoding many texts by their distinct units: each is encoded once, and the ids are gathered by offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import utf8

REMEMBERED, LONGEST_REMEMBERED = 300_000, 40


class Store:
    """Ids of units as little-endian unsigned 32-bit integers: a store of bounded size before ``make``.

    Once it holds ``limit`` units it becomes the old one, which is dropped when the next is full; what is asked for again
    is taken over.
    """

    def __init__(self, make, limit: int = REMEMBERED):
        """make: from a list of units (bytes) to the list of their ids."""
        self.make, self.limit = make, limit
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, units: list[bytes]) -> list[bytes]:
        if len(self.seen) > self.limit:
            self.old, self.seen = self.seen, {}
        seen, old = self.seen, self.old
        got = list(map(seen.get, units))
        missed = [i for i, x in enumerate(got) if x is None]
        fresh = []
        for i in missed:
            x = old.get(units[i])
            if x is None:
                fresh.append(i)
            else:
                got[i] = seen[units[i]] = x
        for i, made in zip(fresh, self.make([units[i] for i in fresh]) if fresh else ()):
            got[i] = made
            if len(units[i]) <= LONGEST_REMEMBERED:
                seen[units[i]] = made
        return got


def spread_out(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, .. (size[i] of them) for each i."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def gathered(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the kept units data[bounds[i]:bounds[i + 1]] one after the other, and where each unit's begin."""
    n = len(bounds) - 1
    units = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    coded = units.filter(pa.array(keep)).dictionary_encode()
    raw, at = utf8(coded.dictionary)
    raw, at = raw.tobytes(), at.tolist()
    made = store.ids([raw[a:b] for a, b in zip(at, at[1:])])
    size = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat = np.frombuffer(b"".join(made), "<u4")
    index = coded.indices.to_numpy()
    count = np.zeros(n, np.int64)
    count[keep] = size[index]
    ids = flat[spread_out((np.cumsum(size) - size)[index], size[index])]
    return ids, np.concatenate([[0], np.cumsum(count)])
