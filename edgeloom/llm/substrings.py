"""Substring dedup over words: every word covered by a ``window``-word window that also starts earlier goes.

Suffixes are split into memory-sized groups by prefixes: a suffix of words takes part only from a place whose first words
(its prefix, ``gram`` of them) are the smallest gram of a window, with the words before it that belong to the same windows;
suffixes whose prefix stands nowhere else go (see ``anchors``), and where prefixes are common a longer one, of two thirds of
a window and more, decides whether a suffix stays. Each group is a subtree: the suffixes of its stretches, sorted word by
word, are the leaves, the number of words that neighbours have in common gives the internal nodes (see ``subtree``), and the
nodes at a depth of ``window`` words or more are the repeats; adjacent ones make up the maximal ones. Words are compared
themselves, by their numbers in a dictionary of the group; hashes only choose groups.

Null and empty texts have no words. Texts with fewer words than a window keep all, texts of any length are taken whole. Of
equal windows the first by (doc_id, place) stays. Repeated rows of one doc_id are one document. An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from . import common as c
from . import repeats as r
from . import tokens as t
from .units import spread_out


class Words:
    """Texts by their words; see anchors.marked. Units are numbers of a dictionary of these texts."""

    def __init__(self, data, offs):
        self.data = data
        self.start, self.end, self.offs = t.split(data, offs, t.SPACE)
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        letters = data[~t.SPACE[data]]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.units = words.indices.to_numpy().astype(np.int32)
        raw, at = c.utf8(words.dictionary)
        self.hashes = t.word_hashes(raw, at[:-1], at[1:])[self.units]

    @staticmethod
    def seed(units):
        return (units >> t.U(32)).astype(np.uint32)

    def ship(self, at, size):
        first = self.start[at]
        length = self.end[at + size - 1] - first
        # A space behind each, so that words of neighbours stay apart.
        out = np.full(int(length.sum()) + len(at), 32, np.uint8)
        begin = np.cumsum(length + 1) - length - 1
        out[spread_out(begin, length)] = self.data[spread_out(first, length)]
        return out, length + 1

    @staticmethod
    def groups(units, at, size, window):
        string, offset, depth = subtree(units, at, size, window)
        again = np.zeros(len(depth) + 1, bool)
        again[:-1] = depth >= window
        alike = np.flatnonzero(again[:-1] | again[1:])
        return string[alike], offset[alike], np.cumsum(depth < window)[alike]


def subtree(units, at, size, window):
    """Leaves and inner nodes of the suffixes units[at[i] + k:] of ``window`` units or more, cut there.

    Returns, in the order of the leaves: stretch, offset k, and the depth of the lowest node above a leaf and the one before
    it (0 for the first).
    """
    count = size - window + 1
    string = np.repeat(np.arange(len(at)), count)
    offset = spread_out(np.zeros(len(at), np.int64), count)
    begin = at[string] + offset
    # Sorted by the last units first, each pass keeping the order of the passes before.
    order = np.arange(len(begin))
    for i in range(window - 1, -1, -1):
        order = order[np.argsort(units[begin[order] + i], kind="stable")]
    depth = np.zeros(len(begin), np.int64)
    x, y = begin[order[1:]], begin[order[:-1]]
    open_ = np.arange(len(x))
    for i in range(window):
        open_ = open_[units[x[open_] + i] == units[y[open_] + i]]
        depth[1 + open_] += 1
    return string[order], offset[order], depth


def marked(docs: DataFrame, window: int, gram: int, bins: int) -> DataFrame:
    return anchors.marked(r.at_home(docs, bins), window, gram, bins, Words)


def dedup(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept and kept_sha256; see repeats.rewrite."""
    d = c.documents(docs)
    bins = bins_of(d)
    return r.rewrite(d, marked(d, window, gram, bins), bins, window, True)


def bins_of(d: DataFrame) -> int:
    return max(c.partitions(d.sparkSession), r.size_of(d) // r.BIN_BYTES)


def clean(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """The documents with all their columns; ``text`` without the repeats. Texts that lose all their words go."""
    d = c.one_row(docs)
    bins = bins_of(d)
    marks = marked(d.select("doc_id", "text"), window, gram, bins)
    names, schema = d.columns, d.schema

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = r.of_documents(right)
        text = left["text"].to_pylist()
        for i, key in enumerate(left["doc_id"].to_pylist()):
            found = gone(key)
            if found is not None:
                text[i] = r.kept_words(text[i].encode(), *found, window)[0].decode()
        some = pa.array([x != "" or gone(key) is None for x, key in zip(text, left["doc_id"].to_pylist())], pa.bool_())
        out = left.set_column(left.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
        return out.select(names).filter(some)

    made = r.at_home(d, bins).groupBy("bin").cogroup(marks.select("bin", "block").groupBy("bin")).applyInArrow(rows, schema)
    return c.own_id(made)
