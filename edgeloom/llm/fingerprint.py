"""One-permutation MinHash fingerprints.

Word shingles are hashed once; the high bits choose one of BINS bins, and each bin keeps its least hash. Empty bins are
filled by optimal densification: bin i draws bins from a fixed hash sequence until one that was not empty. The low BITS
bits of every bin are packed into the fingerprint. The likeness of two fingerprints is their share of equal bins with
the chance agreement of 2**-BITS taken out.

Every document's text is compared with an edited one, which takes characters from the next document, in ascending
doc_id. Documents are dealt to bins of neighbouring ids, sorted and streamed; the first document of a bin is also sent to
the bin before, so that texts are exchanged once.

Null is an empty text. A text without words has an empty fingerprint; two such are alike (1), one and another aren't
(0). Texts with fewer words than a shingle are one shingle. A text of any length is taken whole. Equal bins of two
fingerprints count whatever their hashes were (ties are what BITS makes of them). Repeated rows of one doc_id are one
document. An empty table gives an empty table; a single document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokens as t

BINS, BITS = 256, 8
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketch_all(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BINS) packed low bits of each bin, and which texts have any value; values[at[i]:at[i + 1]] are a text's."""
    n = len(at) - 1
    width = t.U(64 - BINS.bit_length() + 1)
    row = np.repeat(np.arange(n), np.diff(at))
    place = row * BINS + (values >> width).astype(np.int64)
    most = np.iinfo(np.uint64).max
    least = np.full(n * BINS, most, np.uint64)
    np.minimum.at(least, place, values & ((t.U(1) << width) - t.U(1)))
    some = np.diff(at) > 0
    open_ = np.flatnonzero((least == most) & np.repeat(some, BINS))
    filled, attempt = least.copy(), 0
    while len(open_):
        attempt += 1
        bins = open_ % BINS
        other = (t.mix(bins.astype(np.uint64) * t.U(t.BASE) + t.U(attempt * t.BASE2 % t.M64)) % t.U(BINS)).astype(np.int64)
        value = least[open_ - bins + other]
        found = value != most
        filled[open_[found]] = value[found]
        open_ = open_[~found]
    return (t.mix(filled) & t.U((1 << BITS) - 1)).astype(np.uint8).reshape(n, BINS), some


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def sketches(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The fingerprint of each text: BINS bytes, or none."""
    data, offs = c.utf8(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in c.slices(offs, 1 << 20):
        made, some = sketch_all(*t.shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words))
        out += [x if y else x[:0] for x, y in zip(made, some)]
    return out


def heads(docs: DataFrame) -> np.ndarray:
    """The first id of each range of neighbouring ids: as many at most as an exchange has partitions."""
    ids = docs.select("doc_id").repartitionByRange(c.partitions(docs.sparkSession), "doc_id")
    found = ids.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("head")).collect()
    return np.array(sorted(r["head"] for r in found), np.int64)


def in_order(docs: DataFrame) -> DataFrame:
    """(bin, doc_id, text, after) by bin and ascending id; the last row of a bin (after: 1) is the next one's first.

    The last bin is followed by the first document of all.
    """
    spark = docs.sparkSession
    found = heads(docs)
    shared = spark.sparkContext.broadcast(found)

    def rows(batches):
        first = shared.value
        for batch in batches:
            ids = c.longs(batch, "doc_id")
            own = np.searchsorted(first, ids, "right") - 1
            again = np.flatnonzero(first[own] == ids)
            for picked, bins, after in ((np.arange(len(ids)), own, 0), (again, (own[again] - 1) % len(first), 1)):
                part = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), c.column(part, "doc_id"), c.column(part, "text"), pa.array(np.full(len(picked), after, np.int32))], names=["bin", "doc_id", "text", "after"])

    dealt = docs.select("doc_id", "text").mapInArrow(rows, "bin long, doc_id long, text string, after int")
    return dealt.repartitionById(max(1, len(found)), F.col("bin").cast("int")).sortWithinPartitions("bin", "after", "doc_id")


def edit(text: str, other: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses."""

    def made(ids, texts, after):
        """Rows of texts[i], followed by texts[i + 1]; only where after[i + 1] says that it is its neighbour."""
        own = sketches(texts, words)
        at = [i for i in range(len(ids)) if not after[i]]
        changed = [edit(texts[i], texts[i + 1]) for i in at]
        new = sketches(changed, words)
        cols = (
            [ids[i] for i in at], [len(texts[i]) for i in at], [hashlib.sha256(x.encode()).hexdigest() for x in changed],
            [own[i].tobytes().hex() for i in at], [x.tobytes().hex() for x in new],
            [likeness(own[i], x) for i, x in zip(at, new)], [likeness(own[i], own[i + 1]) for i in at],
        )
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types)], names=SCHEMA.replace(",", "").split()[::2])

    def rows(batches):
        ids, texts, after, size = [], [], [], 0
        for batch in batches:
            for key, text, late in zip(*(c.column(batch, k).to_pylist() for k in ("doc_id", "text", "after"))):
                ids.append(key)
                texts.append(text or "")
                after.append(late)
                size += len(texts[-1])
                if size >= 1 << 20 and len(ids) > 1:
                    yield made(ids[:-1], texts, after)
                    ids, texts, after, size = ids[-1:], texts[-1:], after[-1:], len(texts[-1])
        if len(ids) > 1:
            yield made(ids[:-1], texts, after)

    return c.own_id(in_order(c.documents(docs)).mapInArrow(rows, SCHEMA))
