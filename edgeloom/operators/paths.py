"""Shortest paths of many roots over a grid of edge blocks, relaxed by the executors in files of the shared folder.

Vertices are dealt into blocks by hash. A block has one file of distances, a row for each vertex and a column for each of up
to 64 roots, and one file of the edges that enter it, in sections by the block of their source. A round has a task for each
block: it takes the rows of other blocks that have changed since the round before, relaxes the edges from them and replaces
its own file by rename. No distance is exchanged, and nothing but the files' present state lies on disk. A task may meet
another's file of the round before or of this one: both hold lengths of real paths, and a changed row bears the number of
its round, so that the next round takes it again. That also holds for tasks that run twice.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as g

#: Distances and edges of a block, at most, as far as hashes deal them evenly.
CELLS, EDGES = 4 << 20, 2 << 20
#: The share of the edges of least weight that are relaxed alone at first.
LIGHT = 0.2
#: So many edges of one target in a section are taken apart before the rest are reduced at once.
LAYERS = 8


def local(path: str) -> str | None:
    """The path as executors open it, or None if only Spark's readers can."""
    path = re.sub(r"^file:/+", "/", path)
    return path if path.startswith("/") else None


def shortest(edges: DataFrame, roots: DataFrame, folder: str, degrees: bool = False) -> DataFrame:
    """(root, vertex, dist), and the vertex's out-degree if asked for, over finite non-negative weights; edges are dealt.

    At first only light edges are relaxed until all rests, then all edges: light are those of the least weights, the lightest
    that enter each vertex and those that leave a root, so that nearly all is reached by them. An edge is left out where the distances
    of its ends, less each root's mean distance, show that it shortens no path of any root (see _useful).
    """
    spark = edges.sparkSession
    path = f"{folder}/paths-{uuid.uuid4().hex}"
    os.makedirs(path)
    ids = sorted(r["root"] for r in roots.select("root").distinct().collect())
    words = [ids[i : i + 64] for i in range(0, len(ids), 64)]
    n, most = edges.agg(F.count(F.lit(1)), F.approx_count_distinct("dst")).first()
    blocks = max(1, -(-most * min(64, len(ids)) // CELLS), -(-n // EDGES), min(2 * spark.sparkContext.defaultParallelism, n >> 18))
    at = lambda c: F.expr(f"pmod(hash({c}), {blocks})")
    # A root may have no edge that enters it: a loop of weight 0 puts it into its block.
    loops = spark.createDataFrame([(i,) for i in ids], "src long").selectExpr("src", "src dst", "0D w")
    known = edges.where("src is not null and dst is not null and w is not null").selectExpr("cast(src as long) src", "cast(dst as long) dst", "cast(w as double) w").unionByName(loops)
    light = [r["light"] for r in known.select("src", "dst", "w", at("src").alias("other"), at("dst").alias("block")).groupBy("block").applyInArrow(lambda t: _write_ids(path, t), "light double").collect()]
    light = float(np.median(light)) if light else 0.0
    g._tidy(spark)
    _each(spark, blocks, lambda j: _write_edges(path, j, light, ids))
    if degrees:
        g.out_degree(edges).select("vertex", "degree", at("vertex").alias("block")).groupBy("block").applyInArrow(lambda t: _write_degrees(path, t), "n long").collect()
    for word, its in enumerate(words):
        _each(spark, blocks, lambda j, w=word, r=its: _start(path, w, j, r))
        k, files = 0, ("light",)
        while True:
            k += 1
            if any(x for x, *_ in _each(spark, blocks, lambda j, w=word, r=len(its), k=k, f=files: _relax(path, w, j, r, k, f))):
                continue
            if len(files) > 1:
                break
            sums = np.array(_each(spark, blocks, lambda j, w=word, r=len(its): _sums(path, w, j, r))).sum(0)
            mean = sums[: len(its)] / np.maximum(1, sums[len(its) :])
            _each(spark, blocks, lambda j, w=word, m=mean, k=k: _renew(path, w, j, m, k))
            files = ("light", "heavy")
    columns = "root long, vertex long, dist double" + ", degree long" * degrees
    found = spark.range(0, blocks, 1, blocks).mapInArrow(lambda batches: (x for b in batches for j in b["id"].to_pylist() for x in _rows(path, j, words, degrees)), columns)
    found.scratch_path = path
    return found


def _each(spark, blocks: int, step) -> list[list[float]]:
    """step(block) of each block, run by the executors; what the steps return, if they do."""

    def run(batches):
        for b in batches:
            for j in b["id"].to_pylist():
                yield pa.record_batch({"x": pa.array([[float(x) for x in step(j) or ()]], pa.list_(pa.float64()))})

    return [r["x"] for r in spark.range(0, blocks, 1, blocks).mapInArrow(run, "x array<double>").collect()]


def _replace(path: str, parts) -> None:
    """A file made of the arrays' bytes, there as a whole or not at all."""
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        for x in parts:
            f.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")
    os.replace(made, path)


def _ids(path: str, j: int) -> np.ndarray:
    """The vertices of a block, ascending; a block may have none."""
    return np.fromfile(f"{path}/ids-{j}", np.int64) if os.path.exists(f"{path}/ids-{j}") else np.zeros(0, np.int64)


def _pack(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd", compression_level=1).compress(x.tobytes()), np.uint8)


def _write_sections(file: str, sections) -> None:
    """Sections (block, three arrays): eight-byte numbers for the block, the edges and the arrays' packed sizes, then these."""
    parts = []
    for i, arrays in sections:
        packed = [_pack(x) for x in arrays]
        parts += [np.array([i, len(arrays[0]), *map(len, packed)], np.int64), *packed]
    _replace(file, parts)


def _sections(file: str, kinds, wanted=lambda i: True):
    """(block, its arrays), one section after another; those not wanted are passed over."""
    if not os.path.exists(file):
        return
    with open(file, "rb") as f:
        while head := f.read(40):
            i, n, *sizes = np.frombuffer(head, np.int64).tolist()
            if not wanted(i):
                f.seek(sum(sizes), 1)
                continue
            codec = pa.Codec("zstd")
            yield i, [np.frombuffer(codec.decompress(f.read(size), n * np.dtype(kind).itemsize), kind) for size, kind in zip(sizes, kinds, strict=True)]


def _write_ids(path: str, table: pa.Table) -> pa.Table:
    """The ids of a block and its edges, sources still as ids; returns the weight up to which an edge is light."""
    j = table["block"][0].as_py()
    src, dst, w, other = (table[c].to_numpy() for c in ("src", "dst", "w", "other"))
    ids, to = np.unique(dst, return_inverse=True)
    order = np.argsort(other * np.int64(len(ids)) + to, kind="stable")
    other = other[order]
    cuts = [0, *(np.flatnonzero(other[1:] != other[:-1]) + 1).tolist(), len(other)]
    _write_sections(f"{path}/raw-{j}", ((int(other[a]), (src[order[a:b]], to[order[a:b]].astype(np.uint32), w[order[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False)))
    least = np.full(len(ids), np.inf)
    np.minimum.at(least, to, np.where(src == dst, np.inf, w))
    _replace(f"{path}/least-{j}", [least])
    _replace(f"{path}/ids-{j}", [ids])
    return pa.table({"light": [float(np.quantile(w, LIGHT, method="lower"))]})


def _write_edges(path: str, j: int, light: float, roots: list[int]) -> None:
    """Sources as rows of their blocks; one that no edge enters and that is no root is reached by nothing."""

    def placed(name):
        for i, (src, to, w) in _sections(f"{path}/raw-{j}", (np.int64, np.uint32, np.float64)):
            if len(ids := _ids(path, i)):
                row = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
                first = (w <= light) | (w == least[to]) | np.isin(src, roots)
                there = (ids[row] == src) & (first == (name == "light"))
                if there.any():
                    yield i, (row[there].astype(np.uint32), to[there], w[there])

    if os.path.exists(f"{path}/raw-{j}"):
        least = np.fromfile(f"{path}/least-{j}", np.float64)
        for name in ("light", "heavy"):
            _write_sections(f"{path}/{name}-{j}", placed(name))
        os.remove(f"{path}/raw-{j}")


def _write_degrees(path: str, table: pa.Table) -> pa.Table:
    j = table["block"][0].as_py()
    ids, vertex = _ids(path, j), table["vertex"].to_numpy()
    out = np.zeros(len(ids), np.int64)
    if len(ids):
        row = np.minimum(np.searchsorted(ids, vertex), len(ids) - 1)
        there = ids[row] == vertex
        out[row[there]] = table["degree"].to_numpy()[there]
    _replace(f"{path}/degrees-{j}", [out])
    return pa.table({"n": [len(out)]})


class _State:
    """The distances of a block, and for each row the round of its last change, what has reached it and its bounds."""

    def __init__(self, path: str, word: int, j: int, width: int, n: int | None = None):
        self.path, n = f"{path}/state-{word}-{j}", len(_ids(path, j)) if n is None else n
        self.n = n
        data = np.memmap(self.path, np.uint8, "r") if n and os.path.exists(self.path) else np.zeros(0, np.uint8)
        if not len(data):
            self.dist, self.stamp = np.full((n, width), np.inf), np.full(n, -2, np.int64)
            self.low, self.high, self.mask = np.full(n, np.inf), np.zeros(n), np.zeros(n, np.uint64)
            self.mean = np.zeros(width)
            return
        a = n * width * 8
        self.dist = data[:a].view(np.float64).reshape(n, width)
        self.stamp, self.low, self.high = (data[a + i * n * 8 : a + (i + 1) * n * 8].view(t) for i, t in enumerate((np.int64, np.float64, np.float64)))
        self.mask = data[a + 3 * n * 8 : a + 4 * n * 8].view(np.uint64)
        self.mean = np.array(data[a + 4 * n * 8 :].view(np.float64))

    def own(self) -> _State:
        for name in ("dist", "stamp", "low", "high", "mask"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def bound(self, rows: np.ndarray) -> None:
        """low and high: the least and greatest distance of a row, less the roots' means, among the roots that reach it."""
        for a in range(0, len(rows), 4096):
            at = rows[a : a + 4096]
            d = self.dist[at]
            there = np.isfinite(d)
            d -= self.mean
            self.low[at] = np.where(there, d, np.inf).min(1)
            self.high[at] = np.where(there.any(1), np.where(there, d, -np.inf).max(1), 0)
            bits = np.zeros((len(at), 64), bool)
            bits[:, : d.shape[1]] = there
            self.mask[at] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]

    def write(self) -> None:
        _replace(self.path, [self.dist, self.stamp, self.low, self.high, self.mask, self.mean])


def _start(path: str, word: int, j: int, roots: list[int]) -> None:
    ids = _ids(path, j)
    s = _State(path, word, j, len(roots), len(ids))
    if len(ids):
        row = np.minimum(np.searchsorted(ids, roots), len(ids) - 1)
        column = np.flatnonzero(ids[row] == roots)
        s.dist[row[column], column] = 0
        s.stamp[row[column]] = 0
        s.bound(row[column])
        s.write()


def _useful(there: _State, here: _State, src, dst, w) -> np.ndarray:
    """False where d(src) + w < d(dst) holds for no root.

    That is so if every root that reaches src reaches dst, and low(src) + w is at least high(dst): both bounds have the same
    mean taken off, root by root. The margin covers the rounding of these differences; the sums of paths are not touched.
    """
    low, high = there.low[src], here.high[dst]
    return ((there.mask[src] & ~here.mask[dst]) != 0) | (low + w < high + 1e-12 * (np.abs(low) + np.abs(high) + w))


def _lower(dist, changed, source, src, dst, w) -> None:
    """dist[dst] = min(dist[dst], source[src] + w), dst ascending: first edges of all targets, then second ones, at last the rest."""
    first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
    rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    for r in range(min(LAYERS, int(rank.max())) + 1):
        at = np.flatnonzero(rank == r if r < LAYERS else rank >= r)
        to = dst[at]
        new = np.take(source, src[at], axis=0)
        new += w[at, None]
        if r == LAYERS:
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            new, to = np.minimum.reduceat(new, first, axis=0), to[first]
        old = np.take(dist, to, axis=0)
        less = new < old
        hit = np.flatnonzero(np.packbits(less).view(np.uint64) if less.shape[1] == 64 else less.any(1))
        if len(hit) < len(to):
            new, old, to = new[hit], old[hit], to[hit]
        dist[to] = np.minimum(new, old, out=new)
        changed[to] = True


def _relax(path: str, word: int, j: int, width: int, k: int, files: tuple[str, ...]) -> list[int]:
    """One round of a block; the number of rows that have changed in it."""
    here = _State(path, word, j, width)
    seen: dict[int, _State] = {}

    def wanted(i):
        seen.clear()
        seen[i] = _State(path, word, i, width)
        return bool((seen[i].stamp >= k - 1).any())

    changed, chunk = np.zeros(here.n, bool), (1 << 17) // width
    for i, (src, dst, w) in (x for name in files for x in _sections(f"{path}/{name}-{j}", (np.uint32, np.uint32, np.float64), wanted)):
        there = seen[i]
        use = np.flatnonzero((there.stamp >= k - 1)[src])
        src, dst, w = src[use], dst[use], w[use]
        use = np.flatnonzero(_useful(there, here, src, dst, w))
        src, dst, w = src[use], dst[use], w[use]
        if len(src) and not here.dist.flags.writeable:
            here.own()
        for a in range(0, len(src), chunk):
            _lower(here.dist, changed, there.dist, src[a : a + chunk], dst[a : a + chunk], w[a : a + chunk])
    if changed.any():
        here.stamp[changed] = k
        here.bound(np.flatnonzero(changed))
        here.write()
    return [int((here.stamp == k).sum())]


def _sums(path: str, word: int, j: int, width: int) -> list[float]:
    s = _State(path, word, j, width)
    total, count = np.zeros(width), np.zeros(width)
    for a in range(0, s.n, 4096):
        d = s.dist[a : a + 4096]
        there = np.isfinite(d)
        total += np.where(there, d, 0).sum(0)
        count += there.sum(0)
    return [*total, *count]


def _renew(path: str, word: int, j: int, mean: np.ndarray, k: int) -> None:
    """Bounds by other means; all rows that something has reached count as changed."""
    s = _State(path, word, j, len(mean)).own()
    if s.n:
        s.mean = mean
        s.bound(np.arange(s.n))
        s.stamp[s.mask != 0] = k
        s.write()


def _rows(path: str, j: int, words: list[list[int]], degrees: bool):
    ids = _ids(path, j)
    degree = np.fromfile(f"{path}/degrees-{j}", np.int64) if degrees and os.path.exists(f"{path}/degrees-{j}") else np.zeros(len(ids), np.int64)
    for word, roots in enumerate(words):
        s = _State(path, word, j, len(roots), len(ids))
        step = max(1, (1 << 17) // len(roots))
        for a in range(0, len(ids), step):
            d = s.dist[a : a + step]
            row, column = np.nonzero(np.isfinite(d))
            out = {"root": np.array(roots, np.int64)[column], "vertex": ids[a + row], "dist": d[row, column]}
            yield pa.record_batch(out | ({"degree": degree[a + row]} if degrees else {}))
