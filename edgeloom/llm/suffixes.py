"""Repeated byte strings: every byte covered by a ``window``-byte string that also starts earlier goes.

Stretches that may hold such strings are found and dealt out by anchors (see ``anchors``). Those of one anchor are the
documents of a collection whose Burrows-Wheeler transform and longest common prefixes are built column by column (see
``column_wise``). Suffixes that are neighbours with a common prefix of ``window`` bytes or more are the repeats.

Null and empty texts have no bytes. Texts of any length are taken whole; long ones are cut with overlap so that each
window is in one part. Of equal windows the first by (doc_id, place) stays. Repeated rows of one doc_id are one document. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import anchors
from . import common as c
from . import repeats as r
from . import tokens as t
from .anchors import PART, PLACE_BITS, parts  # noqa: F401
from .units import spread_out

BYTE32 = t.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


class Bytes:
    """Texts by their bytes; see anchors.marked."""

    def __init__(self, data, offs):
        self.units = self.hashes = data
        self.offs = offs

    @staticmethod
    def seed(units):
        return BYTE32[units]

    def ship(self, at, size):
        return self.units[spread_out(at, size)], size

    @staticmethod
    def groups(units, at, size, window):
        common, string, length = column_wise(units, at, size)
        again = np.zeros(len(common) + 1, bool)
        again[:-1] = common >= window
        alike = np.flatnonzero(again[:-1] | again[1:])
        string = string[alike].astype(np.int64)
        return string, size[string] - length[alike], np.cumsum(common < window)[alike]


def segments(data, offs, window, gram):
    """Row, first window start, windows and anchor hash of each segment."""
    row, at, count, _, value = anchors.anchored(BYTE32[data], data, offs, window, gram)
    return row, at, count, value


def least_between(values, a, b):
    """The least of values[a:b] for each pair; a < b. Minima of runs of 1, 2, 4, .. values are made in turn."""
    out = np.empty(len(a), values.dtype)
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max(initial=-1)) + 2))
    run = values
    for k in range(len(cuts) - 1):
        if k:
            run = np.minimum(run[: -(1 << k - 1)], run[1 << k - 1 :])
        i = order[cuts[k] : cuts[k + 1]]
        if len(i):
            out[i] = np.minimum(run[a[i]], run[b[i] - (1 << k)])
    return out


def column_wise(data, at, size):
    """Burrows-Wheeler transform and common prefixes of the strings data[at[i]:at[i] + size[i]].

    One symbol of each string that has one left is inserted a round, the last one first. Three sequences are kept in the
    order of the suffixes: the symbol before each suffix (the transform), what it has in common with the suffix before it,
    and whose it is. A suffix c + S stands, among the new ones and the old, where S stands among the suffixes that follow a
    c; what it has in common with its neighbours is one more than the least between theirs. Each round reads the sequences
    from end to end and writes them anew with the new suffixes merged in.

    Returns, in the order of all suffixes that are not empty: common prefix with the one before, string, length.
    """
    m = len(at)
    symbols = np.unique(data[spread_out(at, size)])
    code = np.zeros(256, np.uint8 if len(symbols) < 256 else np.uint16)
    code[symbols] = np.arange(1, len(symbols) + 1)
    longest = int(size.max())
    common_type = np.uint8 if longest < 256 else np.uint16
    # The empty suffixes, one for each string, stand first all the time; they are not kept but for their symbols.
    before, common, owner, length = code[data[at + size - 1]], np.zeros(m, common_type), np.arange(m, dtype=np.uint32), np.zeros(m, common_type)
    latest, who = np.arange(m), np.arange(m)  # places of the suffixes inserted last, and whose they are
    for j in range(1, longest + 1):
        order = np.argsort(before, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        done = int((before == 0).sum())
        mine = place[latest]
        # The neighbours that follow the same symbol, and the least common prefix on the way to them.
        symbol = before[latest]
        prior = order[np.maximum(mine - 1, 0)]
        has_prior = (mine > 0) & (before[prior] == symbol)
        after = order[np.minimum(mine + 1, len(order) - 1)]
        has_after = (mine + 1 < len(order)) & (before[after] == symbol)
        with_prior, with_after = np.zeros(len(mine), common_type), np.zeros(len(mine), common_type)
        with_prior[has_prior] = least_between(common, prior[has_prior] + 1, latest[has_prior] + 1) + 1
        with_after[has_after] = least_between(common, latest[has_after] + 1, after[has_after] + 1) + 1
        new = m + mine - done
        total = len(before) + len(new)
        old = np.ones(total, bool)
        old[new] = False
        left = size[who] > j
        symbols_before = np.zeros(len(who), before.dtype)
        symbols_before[left] = code[data[(at + size)[who[left]] - 1 - j]]
        merged = []
        for was, add in ((before, symbols_before), (common, with_prior), (owner, who), (length, j)):
            made = np.empty(total, was.dtype)
            made[old] = was
            made[new] = add
            merged.append(made)
        before, common, owner, length = merged
        follows = new + 1
        inside = (follows < total) & has_after
        common[follows[inside]] = with_after[inside]
        edge = (follows < total) & ~has_after
        common[follows[edge]] = 0
        keep = np.flatnonzero(left)
        latest, who = new[keep], who[keep]
        if not len(who):
            break
    return common[m:], owner[m:], length[m:]


def dedup(docs: DataFrame, window: int = 100, gram: int = 40) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept and kept_sha256; see repeats.rewrite."""
    d = c.documents(docs)
    bins = max(c.partitions(docs.sparkSession), r.size_of(d) // r.BIN_BYTES)
    return r.rewrite(d, anchors.marked(r.at_home(d, bins), window, gram, bins, Bytes), bins, window, False)
