"""Repeated windows of units (bytes or words), dealt out by anchors: what the two repeat removers share.

Each window of ``window`` units is anchored at its smallest ``gram``-unit gram (leftmost of equal ones), so equal windows have
equal anchors at equal places. Stretches of windows with one anchor are segments. Anchors are counted over the whole
collection first, and only segments whose anchor stands elsewhere too are dealt out by it; byte-equal ones are settled
by their earliest, and a segment of which no longer stretch around the anchor stands in another one holds no repeat. The
operators compare the rest, each by its own method.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from . import repeats as r
from . import tokens as t
from .units import spread_out

SLICE = 1 << 19
PLACE_BITS = 28
PART = 64 << 20
COLLECTION = 4 << 20


def anchored(seeds, units, offs, window, gram):
    """Row, first window start, windows, anchor place and 64-bit anchor hash of each segment.

    units: all texts' units, any fixed width; seeds: 32 bits for each; offs: where each text's units begin.
    """
    n = len(units)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if n < window:
        return none
    g = t.mix32(t.grams(seeds, gram)).astype(np.uint64) << t.U(PLACE_BITS)
    g |= np.arange(len(g), dtype=np.uint64)
    least = t.sliding_min(g, window - gram + 1)
    valid = np.zeros(len(least) + 2, bool)
    valid[1:-1] = True
    ends = offs[1:]
    late = np.maximum(offs[:-1], ends - window + 1)
    out = spread_out(late, ends - late)
    valid[out[out < len(least)] + 1] = False
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    heads = np.flatnonzero(valid[1:-1] & (new[:-1] | ~valid[:-2]))
    lasts = np.flatnonzero(valid[1:-1] & (new[1:] | ~valid[2:]))
    if not len(heads):
        return none
    anchor = (least[heads] & t.U((1 << PLACE_BITS) - 1)).astype(np.int64)
    return np.searchsorted(offs, heads, "right") - 1, heads, lasts - heads + 1, anchor, stretches(units, anchor, gram)


def stretches(units, at, size: int) -> np.ndarray:
    """64 bits for each units[at:at + size]."""
    w = units.itemsize
    return t.lane_hashes(units.view(np.uint8), at * w, size * w)


def parts(data, offs, window, most):
    """(shift, bytes, offsets) of slices; one text of more bytes is cut so that each window is in one part."""
    if len(offs) > 2 or len(data) < most + window:
        yield 0, data, offs
        return
    for at in range(0, len(data) - window + 1, most):
        part = data[at : at + most + window - 1]
        yield at, part, np.array([0, len(part)])


def all_segments(seed, units, offs, window, gram):
    """anchored() of many texts, some of them long; places are those in units. seed: from units to 32 bits for each."""
    out = [[] for _ in range(5)]
    for lo, hi in c.slices(offs, SLICE):
        for shift, part, bounds in parts(units[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window, PART):
            row, at, count, anchor, value = anchored(seed(part), part, bounds, window, gram)
            for kept, x in zip(out, (row + lo, at + shift + offs[lo], count, anchor + shift + offs[lo], value)):
                kept.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def equal_to(units, at, size, other):
    """Whether units[at[i]:at[i] + size[i]] is what stands at other[i]; sizes are above zero."""
    if not len(at):
        return np.zeros(0, bool)
    same = units[spread_out(at, size)] == units[spread_out(other, size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def copies(units, at, size, value, doc, place):
    """True for a segment that equals one with a smaller (doc, place) and the same anchor value, unit by unit."""
    w = units.itemsize
    whole = t.word_hashes(units.view(np.uint8), at * w, (at + size) * w) ^ value
    order = np.argsort(whole)
    same = whole[order][1:] == whole[order][:-1]
    some = np.zeros(len(at), bool)
    some[1:] |= same
    some[:-1] |= same
    k = order[some]
    k = k[np.lexsort((place[k], doc[k], size[k], value[k], whole[k]))]
    new = np.ones(len(k), bool)
    x, y = k[1:], k[:-1]
    new[1:] = (whole[x] != whole[y]) | (value[x] != value[y]) | (size[x] != size[y])
    first = k[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(at), bool)
    k, first = k[~new], first[~new]
    out[k] = equal_to(units, at[k], size[k], at[first])
    return out


def may_repeat(units, at, size, anchor, gram, window):
    """False where no window can stand in another segment of the same anchor.

    A window that begins a units before its anchor reaches window - gram - a units beyond it; so it holds, around the
    anchor, one of the stretches below whatever a is.
    """
    room = window - gram
    third = room // 3
    out = np.zeros(len(at), bool)
    for before, behind in ((0, room - third), (third, third), (room - third, 0)):
        have = np.flatnonzero((anchor >= before) & (anchor + gram + behind <= size))
        h = stretches(units, at[have] + anchor[have] - before, before + gram + behind)
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        out[have] |= times[which] > 1
    return out


def runs(keys: np.ndarray, weight: np.ndarray, most: int):
    """Index ranges of about that much weight that never cut a run of equal keys."""
    if not len(keys):
        return
    heads = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
    total = np.concatenate([[0], np.cumsum(weight)])[heads]
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield np.arange(heads[i], heads[j])
        i = j


def marked(home: DataFrame, window: int, gram: int, bins: int, kind) -> DataFrame:
    """Marks of the windows that start earlier elsewhere too; see repeats.rewrite.

    kind(data, offs): texts by their units. ``units`` can be compared with each other, ``hashes`` are the same in all
    bins (``seed`` makes 32 bits of each), ``offs`` is where each text's units begin, and ship(at, size) gives the bytes of
    stretches and their lengths, to be read as texts again. kind.groups(units, at, size, window) finds equal windows of
    stretches: (stretch, offset, group), those of one group being equal; windows that equal no other may be left out.
    """

    def prepared(table: pa.Table):
        data, offs = c.utf8(table["text"])
        doc = table["doc_id"].to_numpy().astype(np.int64)
        text = kind(data, offs)
        row, at, count, anchor, value = all_segments(text.seed, text.hashes, text.offs, window, gram)
        return text, doc[row], at, at - text.offs[row], count, anchor, value

    def name(value):
        """An anchor as its bin and 32 more bits."""
        return (value % t.U(bins)).astype(np.int32), (value >> t.U(32)).astype(np.uint32)

    def anchors(table: pa.Table) -> pa.Table:
        """The distinct anchors of a bin of documents, to where they are counted."""
        value = np.unique(prepared(table)[6])
        target, rest = name(value)
        home_bin = np.full(len(value), table["bin"][0].as_py() if table.num_rows else 0, np.int32)
        c.tidy()
        return pa.Table.from_batches([r.rows_by_bin(0, target, rest, home_bin)])

    def several(table: pa.Table) -> pa.Table:
        """The anchors that stand in several bins of documents, back to each of them."""
        rest, home_bin = (np.concatenate(x) for x in zip(*map(c.unpack, table["block"].to_pylist())))
        order = np.argsort(rest, kind="stable")
        same = rest[order][1:] == rest[order][:-1]
        found = np.zeros(len(rest), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        here = np.full(int(found.sum()), table["bin"][0].as_py(), np.int32)
        return pa.Table.from_batches([r.rows_by_bin(0, home_bin[found], rest[found], here)])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        text, doc, at, begin, count, anchor, value = prepared(left)
        blocks = [c.unpack(b) for b in right["block"].to_pylist()]
        if not len(at):
            return pa.Table.from_batches([], schema=r.BLOCK)
        seen = copies(text.units, at, count + window - 1, value, doc, begin)
        out = [r.marks(doc[seen], begin[seen], count[seen], bins)]
        target, rest = name(value)
        mine = target.astype(np.uint64) << t.U(32) | rest
        known = np.concatenate([b[1].astype(np.uint64) << t.U(32) | b[0] for b in blocks]) if blocks else np.zeros(0, np.uint64)
        k = np.flatnonzero(~seen)
        _, which, times = np.unique(mine[k], return_inverse=True, return_counts=True)
        k = k[(times[which] > 1) | np.isin(mine[k], known)]
        k = k[np.argsort(target[k], kind="stable")]
        for p in np.split(k, np.flatnonzero(np.diff(target[k])) + 1):
            if len(p):
                sent, size = text.ship(at[p], count[p] + window - 1)
                block = c.pack(value[p], doc[p], begin[p].astype(np.int32), count[p].astype(np.min_scalar_type(window - gram + 1)), (anchor[p] - at[p]).astype(np.min_scalar_type(window)), size.astype(np.int32), sent)
                out.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([target[p[0]]], pa.int32()), pa.array([block], pa.binary())], schema=r.BLOCK))
        c.tidy()
        return pa.Table.from_batches(out, schema=r.BLOCK)

    def compared(table: pa.Table) -> pa.Table:
        table, blocks = r.settled(table)
        if not blocks:
            return table
        value, doc, begin, count, anchor, bytes_, data = (np.concatenate(x) for x in zip(*map(c.unpack, blocks)))
        begin, count, anchor = begin.astype(np.int64), count.astype(np.int64), anchor.astype(np.int64)
        ends = np.cumsum(bytes_.astype(np.int64))
        units = kind(data, np.concatenate([[0], ends])).units
        size = count + window - 1
        at = np.cumsum(size) - size
        seen = copies(units, at, size, value, doc, begin)
        out = [r.marks(doc[seen], begin[seen], count[seen], bins)]
        k = np.flatnonzero(~seen)
        k = k[may_repeat(units, at[k], size[k], anchor[k], gram, window)]
        k = k[np.argsort(value[k], kind="stable")]
        for part in runs(value[k], size[k], COLLECTION):
            p = k[part]
            if len(p) > 1:
                string, offset, group = kind.groups(units, at[p], size[p], window)
                place = begin[p][string] + offset
                late = r.later(group, doc[p][string], place)
                out.append(r.marks(doc[p][string][late], place[late], np.ones(int(late.sum()), np.int64), bins))
        return pa.concat_tables([table, pa.Table.from_batches(out, schema=r.BLOCK)])

    found = home.groupBy("bin").applyInArrow(anchors, r.BLOCK_DDL).groupBy("bin").applyInArrow(several, r.BLOCK_DDL)
    dealt = home.groupBy("bin").cogroup(found.groupBy("bin")).applyInArrow(deal, r.BLOCK_DDL)
    return dealt.groupBy(r.key(bins)).applyInArrow(compared, r.BLOCK_DDL)
