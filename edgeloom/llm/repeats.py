"""What the two repeat removers share: bins of marked ranges and the rewriting of the documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokens as t

BIN_BYTES = 4 << 20
BLOCK = pa.schema([("kind", pa.int32()), ("bin", pa.int32()), ("block", pa.binary())])
BLOCK_DDL = "kind int, bin int, block binary"


def rows_by_bin(kind: int, bins: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packed block for each bin."""
    order = np.argsort(bins, kind="stable")
    sorted_bins = bins[order]
    cuts = np.flatnonzero(np.diff(sorted_bins)) + 1
    out = [(int(sorted_bins[p[0]]), c.pack(*(a[order[p]] for a in arrays))) for p in np.split(np.arange(len(bins)), cuts) if len(p)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=BLOCK)


def marks(doc: np.ndarray, at: np.ndarray, count: np.ndarray, doc_bins: int) -> pa.RecordBatch:
    """Windows starting at ``at`` .. ``at + count - 1`` of a document are repeats; neighbours are merged."""
    if len(doc):
        order = np.lexsort((at, doc))
        doc, at, count = doc[order], at[order], count[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + count[:-1])])
        heads = np.flatnonzero(new)
        doc, at, count = doc[heads], at[heads], np.add.reduceat(count, heads)
    return rows_by_bin(1, c.bin_of(doc, doc_bins), doc.astype(np.int64), at.astype(np.int32), count.astype(np.int32))


def key(groups: int):
    """Where a row is dealt: blocks to compare (kind 0) by their bin; marks (kind 1) go along and are passed on."""
    return F.expr(f"if(kind = 0, bin, bin % {groups})").alias("group")


def settled(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The marks of a group, as they came, and its blocks to compare."""
    c.tidy()
    kinds = table["kind"].to_numpy()
    return table.select(BLOCK.names).filter(pa.array(kinds == 1)).cast(BLOCK), table.filter(pa.array(kinds == 0))["block"].to_pylist()


def later(values: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where the value stands at a smaller (doc, at) too."""
    order = np.lexsort((at, doc, values))
    out = np.zeros(len(values), bool)
    out[order[1:]] = values[order[1:]] == values[order[:-1]]
    return out


def size_of(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def at_home(docs: DataFrame, doc_bins: int) -> DataFrame:
    """The documents with their bins: one exchange serves all that read them by bin."""
    return docs.withColumn("bin", c.spread(F.col("doc_id"), doc_bins))


def of_documents(marked: pa.Table):
    """From an id to its marks (starts, counts), or None."""
    parts = list(zip(*(c.unpack(b) for b in marked["block"].to_pylist())))
    if not parts:
        return lambda key: None
    doc, at, count = map(np.concatenate, parts)
    order = np.argsort(doc, kind="stable")
    doc, at, count = doc[order], at[order].astype(np.int64), count[order].astype(np.int64)

    def of(key):
        lo, hi = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
        return (at[lo:hi], count[lo:hi]) if hi > lo else None

    return of


def covered(n: int, at: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a marked window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + count + window - 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def kept_words(text: bytes, at: np.ndarray, count: np.ndarray, window: int) -> tuple[bytes, np.ndarray]:
    """The words outside marked windows, joined by spaces, and which words were inside."""
    raw = np.frombuffer(text, np.uint8)
    s, e, _ = t.split(raw, np.array([0, len(raw)]), t.SPACE)
    gone = covered(len(s), at, count, window)
    return b" ".join([text[a:b] for a, b in zip(s[~gone].tolist(), e[~gone].tolist())]), gone


def rewrite(docs: DataFrame, marked: DataFrame, doc_bins: int, window: int, of_words: bool) -> DataFrame:
    """Remove all units (words or bytes) covered by marked windows.

    Columns: doc_id, n_units, n_removed, n_spans, kept (binary) and kept_sha256.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bin_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        marks_of, out = of_documents(right), []
        for key, text in zip(left["doc_id"].to_pylist(), left["text"].cast(pa.large_binary()).to_pylist()):
            text = text or b""
            found = marks_of(key) or nothing
            if of_words:
                kept, gone = kept_words(text, *found, window)
            else:
                gone = covered(len(text), *found, window)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(found[0]) else text
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            out.append((key, len(gone), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        cols = zip(*out) if out else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        c.tidy()
        return pa.Table.from_arrays([pa.array(x, y) for x, y in zip(cols, types)], names=["doc_id", "n_units", "n_removed", "n_spans", "kept", "kept_sha256"])

    left = at_home(docs, doc_bins).groupBy("bin")
    right = marked.select("bin", "block").groupBy("bin")
    return c.own_id(left.cogroup(right).applyInArrow(bin_rows, "doc_id long, n_units long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
