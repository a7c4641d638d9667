"""Graph files: binary and text compressed sparse row, npz, edge lists.

A file of one of the first three kinds is one sequence of arrays. It is written as a stream: executors make blocks of
bytes in order, the driver passes one partition's blocks on at a time, so that no array has to fit into it; the stream goes
to a temporary name on any file system that Spark knows, which becomes the file only when all is written. Binary files,
text rows and uncompressed npz are read in row ranges by the executors, from a path that they can open; of text, the
numbers in each part of the file are counted first. The driver reads compressed npz: use it for graphs that fit it.

Files begin with eight bytes of the reader's and writer's choice (``magic``). The default is this library's own; give the
other program's to exchange files with it.
"""

from __future__ import annotations

import contextlib
import os
import struct
import tempfile
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.operators.graph import _cut, _partitions, _tidy
from edgeloom.operators.search import row_pointers

HEADER = "<8s4Q"  # fixed values: magic, vertices, entries, weighted, reserved
MAGIC = b"EDGELOOM"
HEADER_BYTES = struct.calcsize(HEADER)
EDGES = "src long, dst long, w double"


class _Stream:
    """A file under a temporary name, as an object that zipfile can write to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.target = jvm.org.apache.hadoop.fs.Path(path)
        self.made = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        self.fs = self.target.getFileSystem(spark._jsc.hadoopConfiguration())
        self.out = self.fs.create(self.made, True)

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


@contextlib.contextmanager
def _written(spark: SparkSession, path: str):
    """A stream that becomes the file at the end; after an error there is none."""
    stream = _Stream(spark, path)
    try:
        yield stream
        stream.out.close()
        if stream.fs.exists(stream.target):
            stream.fs.delete(stream.target, False)
        if not stream.fs.rename(stream.made, stream.target):
            raise OSError(f"cannot write {path}")
    except BaseException:
        with contextlib.suppress(Exception):
            stream.out.close()
        stream.fs.delete(stream.made, False)
        raise


def _blocks(ordered: DataFrame, column: str, to_bytes):
    """The column's values as blocks of bytes, in the order of the frame."""

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_bytes(b.column(0).to_numpy(zero_copy_only=False))], pa.binary())], names=["block"])

    for r in ordered.select(column).mapInArrow(rows, "block binary").toLocalIterator():
        yield bytes(r["block"])


def _raw(kind: str):
    return lambda x: x.astype(kind).tobytes()


def _checked(edges: DataFrame, vertices_n: int, **kinds):
    """(blocks, number) of the entries in row order: blocks(column) gives its bytes; ValueError if a vertex is out of bounds.

    The blocks of all columns are made and compressed in one pass, then read in order.
    """
    n, lo, hi = edges.agg(F.count(F.lit(1)), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if n and (lo < 0 or hi >= vertices_n):
        raise ValueError(f"vertices from {lo} to {hi} in a graph of {vertices_n}")

    def rows(batches):
        for b in batches:
            made = [zlib.compress(f(x.to_numpy(zero_copy_only=False)), 1) for f, x in zip(kinds.values(), b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=list(kinds))

    ordered = edges.select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w")).orderBy("src", "dst", "w")
    packed = _cut(ordered.select(*kinds).mapInArrow(rows, ", ".join(f"{x} binary" for x in kinds)))
    del ordered
    _tidy(packed.sparkSession)  # the sorted rows' shuffle files
    return (lambda column: (zlib.decompress(r[0]) for r in packed.select(column).toLocalIterator())), n


def write_binary(edges: DataFrame, vertices_n: int, path: str, weighted: bool = True, magic: bytes = MAGIC) -> None:
    spark = edges.sparkSession
    entries, m = _checked(edges, vertices_n, dst=_raw("<u8"), **({"w": _raw("<f8")} if weighted else {}))
    with _written(spark, path) as out:
        out.write(struct.pack(HEADER, magic, vertices_n, m, int(weighted), 0))
        for block in _blocks(row_pointers(edges, vertices_n).orderBy("vertex"), "indptr", _raw("<u8")):
            out.write(block)
        for column in ("dst", "w")[: 2 if weighted else 1]:
            for block in entries(column):
                out.write(block)


def read_header(path: str, magic: bytes = MAGIC) -> tuple[int, int, bool]:
    """(vertices, entries, weighted); ValueError if the file is cut, its pointers don't end at its entries, or it is no such file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES:
        raise ValueError(f"{path}: cut in its header")
    found, n, m, weighted, _ = struct.unpack(HEADER, head)
    if found != magic:
        raise ValueError(f"{path}: not a binary graph")
    if size < HEADER_BYTES + 8 * (n + 1) + 8 * m * (2 if weighted else 1):
        raise ValueError(f"{path}: cut")
    ends = [int(np.fromfile(path, "<i8", 1, offset=HEADER_BYTES + 8 * i)[0]) for i in (0, n)]
    if ends != [0, m]:
        raise ValueError(f"{path}: row pointers from {ends[0]} to {ends[1]} for {m} entries")
    return n, m, bool(weighted)


def _row_ranges(spark: SparkSession, path: str, n: int, rows: int, pointers, targets, weights) -> DataFrame:
    """The entries of rows in ranges; the functions read k values of an array from place a on."""

    def read(batches):
        for b in batches:
            for lo in b.column(0).to_pylist():
                hi = min(lo + rows, n)
                ptr = pointers(lo, hi - lo + 1)
                if len(ptr) < hi - lo + 1 or (np.diff(ptr) < 0).any():
                    raise ValueError(f"{path}: row pointers {lo} to {hi} are cut or fall")
                a, k = int(ptr[0]), int(ptr[-1] - ptr[0])
                dst = targets(a, k)
                w = np.ones(k) if weights is None else weights(a, k)
                if len(dst) < k or len(w) < k:
                    raise ValueError(f"{path}: entries of rows {lo} to {hi} are cut")
                yield pa.RecordBatch.from_pydict({"src": np.repeat(np.arange(lo, hi), np.diff(ptr)), "dst": dst, "w": w})

    return spark.range(0, n, rows, numPartitions=max(1, -(-n // rows))).mapInArrow(read, EDGES)


def _ranges(spark: SparkSession, path: str, n: int, pointers_at: int, indices_at: int, weights_at: int | None, rows: int) -> DataFrame:
    """The entries of rows in ranges, each read from its places in the file."""
    of = lambda kind, at: lambda a, k: np.fromfile(path, kind, k, offset=at + 8 * a)
    return _row_ranges(spark, path, n, rows, of("<i8", pointers_at), of("<i8", indices_at), None if weights_at is None else of("<f8", weights_at))


def read_binary(spark: SparkSession, path: str, rows: int = 1 << 16, magic: bytes = MAGIC) -> DataFrame:
    n, m, weighted = read_header(path, magic)
    indices = HEADER_BYTES + 8 * (n + 1)
    return _ranges(spark, path, n, HEADER_BYTES, indices, indices + 8 * m if weighted else None, rows)


def write_npz(edges: DataFrame, vertices_n: int, path: str, weighted: bool = True) -> None:
    spark = edges.sparkSession
    weights = _raw("<f8") if weighted else (lambda x: np.ones(len(x)).tobytes())
    entries, m = _checked(edges, vertices_n, dst=_raw("<i8"), w=weights)

    def member(z, name, kind, shape, blocks):
        with z.open(f"{name}.npy", "w", force_zip64=True) as f:
            np.lib.format.write_array_header_1_0(f, {"descr": kind, "fortran_order": False, "shape": shape})
            for block in blocks:
                f.write(block)

    with _written(spark, path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        member(z, "indptr", "<i8", (vertices_n + 1,), _blocks(row_pointers(edges, vertices_n).orderBy("vertex"), "indptr", _raw("<i8")))
        member(z, "indices", "<i8", (m,), entries("dst"))
        member(z, "data", "<f8", (m,), entries("w"))
        member(z, "shape", "<i8", (2,), [np.array([vertices_n, vertices_n], "<i8").tobytes()])


def _stored(path: str, kinds: dict[str, str]) -> dict[str, tuple[int, tuple]] | None:
    """Where the arrays of an uncompressed npz begin and their shapes; None if they can't be read in place."""
    out = {}
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if info.compress_type != zipfile.ZIP_STORED:
                return None
            f.seek(info.header_offset + 26)
            a, b = struct.unpack("<HH", f.read(4))
            f.seek(a + b, os.SEEK_CUR)
            if np.lib.format.read_magic(f) != (1, 0):
                return None
            shape, _, kind = np.lib.format.read_array_header_1_0(f)
            if name in kinds and kind != np.dtype(kinds[name]):
                return None
            out[name] = (f.tell(), shape)
    return out


def read_npz(spark: SparkSession, path: str, rows: int = 1 << 16) -> tuple[DataFrame, int]:
    """(edges, vertices); entries without weights weigh 1."""
    try:
        places = _stored(path, {"indptr": "<i8", "indices": "<i8", "data": "<f8"})
        with np.load(path) as z:
            names = set(z.files)
            shape = z["shape"] if "shape" in names else None
            if not {"indptr", "indices"} <= names:
                raise ValueError(f"{path}: indptr or indices missing")
            if places is None:
                got = {k: z[k] for k in names}
    except (OSError, zipfile.BadZipFile) as e:
        raise OSError(f"cannot open {path}") from e
    if places is None:
        n = int(shape[0]) if shape is not None else len(got["indptr"]) - 1
        return _frame(spark, got["indptr"], got["indices"], got.get("data")), n
    n = int(shape[0]) if shape is not None else places["indptr"][1][0] - 1
    return _ranges(spark, path, places["indptr"][1][0] - 1, places["indptr"][0], places["indices"][0], places["data"][0] if "data" in places else None, rows), n


def _frame(spark, indptr, indices, data) -> DataFrame:
    src = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    w = np.ones(len(src)) if data is None else np.asarray(data, float)
    return spark.createDataFrame(pa.table({"src": src.astype(np.int64), "dst": np.asarray(indices, np.int64), "w": w}))


def write_csr_text(edges: DataFrame, vertices_n: int, path: str, weighted: bool = True) -> None:
    spark = edges.sparkSession
    whole = lambda x: " ".join(map(str, x.tolist())).encode()
    texts = {"dst": whole} | ({"w": lambda x: " ".join(f"{v:.6f}" for v in x.tolist()).encode()} if weighted else {})
    entries, m = _checked(edges, vertices_n, **texts)
    with _written(spark, path) as out:
        out.write(f"{vertices_n} {m}\n".encode())
        for blocks in (_blocks(row_pointers(edges, vertices_n).orderBy("vertex"), "indptr", whole), *map(entries, texts)):
            gap = b""
            for block in blocks:
                out.write(gap + block if block else b"")
                gap = b" " if block or gap else b""
            out.write(b"\n")


def _numbers(spark: SparkSession, path: str, part: int, lines: int = 4):
    """(counts, take): how many words each of the first lines has; take(line, a, k) reads k of them from the a-th on, anywhere.

    Executors count the words that begin in each part of the file; the driver keeps a few numbers for each part.
    """
    size = os.path.getsize(path)

    def count(batches):
        for b in batches:
            for lo in b.column(0).to_pylist():
                raw = np.fromfile(path, np.uint8, part + (lo > 0), offset=max(0, lo - 1))
                blank = raw <= 32
                first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if lo == 0 else np.flatnonzero(~blank[1:] & blank[:-1])
                ends = np.flatnonzero(raw[int(lo > 0) :] == 10)
                words = np.diff(np.searchsorted(first, ends), prepend=0, append=len(first))
                yield pa.RecordBatch.from_pydict({"lo": [lo], "ends": [(ends[:lines] + lo).tolist()], "words": [words[: lines + 1].tolist()]}, schema=kind)

    kind = pa.schema([("lo", pa.int64()), ("ends", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
    parts = -(-size // part)
    found = spark.range(0, size, part, numPartitions=max(1, min(parts, _partitions(spark)))).mapInArrow(count, "lo long, ends array<long>, words array<long>").collect()
    at, before, total, begin, line = [[] for _ in range(lines)], [[] for _ in range(lines)], [0] * lines, [0], 0
    for r in sorted(found, key=lambda r: r["lo"]):
        for i, n in enumerate(r["words"]):
            if line < lines:
                at[line].append(max(r["lo"], begin[line]))
                before[line].append(total[line])
                total[line] += n
            if i < len(r["ends"]):
                line += 1
                begin.append(r["ends"][i] + 1)
    begin += [size] * (lines + 1 - len(begin))
    at, before = [np.array(x, np.int64) for x in at], [np.array(x, np.int64) for x in before]

    def take(line, a, k):
        if not k:
            return []
        i, j = np.searchsorted(before[line], [a, a + k - 1], "right") - 1
        lo, hi, end = int(at[line][i]), int(at[line][j]) + part + 64, begin[line + 1]
        with open(path, "rb") as f:
            f.seek(max(0, lo - 1))
            inside = lo > begin[line] and not f.read(1).isspace()
            f.seek(lo)
            raw = f.read(min(hi, end) - lo)
            while hi < end and not raw[-1:].isspace():
                raw, hi = raw + f.read(min(64, end - hi)), hi + 64
        inside = inside and not raw[:1].isspace()
        return raw.split()[inside:][a - before[line][i] :][:k]

    return total, take


def read_csr_text(spark: SparkSession, path: str, rows: int = 1 << 15, part: int = 1 << 20) -> tuple[DataFrame, int]:
    with open(path) as f:
        n, m = map(int, f.readline(1 << 10).split())
    counts, take = _numbers(spark, path, part)
    weighted = counts[3] > 0
    if counts[1] != n + 1 or counts[2] != m or (weighted and counts[3] != m):
        raise ValueError(f"{path}: cut")
    ends = [int(take(1, i, 1)[0]) for i in (0, n)]
    if ends != [0, m]:
        raise ValueError(f"{path}: row pointers from {ends[0]} to {ends[1]} for {m} entries")
    of = lambda line, kind: lambda a, k: np.array(take(line, a, k)).astype(kind)
    return _row_ranges(spark, path, n, rows, of(1, np.int64), of(2, np.int64), of(3, float) if weighted else None), n


def edge_lines(edges: DataFrame, weighted: bool = True) -> DataFrame:
    w = (F.format_string("%.6f", "w"),) if weighted else ()
    return edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), *w).alias("line"))


def write_edge_list(edges: DataFrame, path: str, weighted: bool = True) -> None:
    edge_lines(edges.orderBy("src", "dst", "w"), weighted).write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).option("sep", "\t").csv(path).withColumn("w", F.coalesce("w", F.lit(1.0)))


def positions(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    """(pos, src, dst, w): where each entry stands in the arrays ordered by row and target."""
    slot = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    placed = edges.join(pointers.selectExpr("vertex src", "indptr"), "src")
    return placed.select((F.col("indptr") + slot).alias("pos"), "src", "dst", "w")


def scratch_file(spark: SparkSession, form: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="edgeloom-")
    folder = folder.removeprefix("file://").rstrip("/")
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return f"{folder}/graph-{uuid.uuid4().hex}.{form}"


def save(edges: DataFrame, vertices_n: int, path: str, form: str = "bin", weighted: bool = True, magic: bytes = MAGIC) -> str:
    """Write in the form that the path's ending asks for, else in ``form``; returns the form."""
    if form == "npz" or path.endswith(".npz"):
        write_npz(edges, vertices_n, path, weighted)
        return "npz"
    if form == "edgelist" or ".edgelist" in path:
        write_edge_list(edges, path, weighted)
        return "edgelist"
    if form == "csr" or path.endswith(".csr"):
        write_csr_text(edges, vertices_n, path, weighted)
        return "csr"
    write_binary(edges, vertices_n, path, weighted, magic)
    return "bin"


def load(spark: SparkSession, path: str, form: str | None = None, magic: bytes = MAGIC) -> tuple[DataFrame, int]:
    """(edges, vertices) of a file in any of the forms."""
    if form == "npz" or path.endswith(".npz"):
        return read_npz(spark, path)
    if form == "csr" or path.endswith(".csr"):
        return read_csr_text(spark, path)
    if form == "edgelist" or ".edgelist" in path:
        edges = read_edge_list(spark, path)
        return edges, edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]
    return read_binary(spark, path, magic=magic), read_header(path, magic)[0]


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts, ws): the entries of each row, in the order of their targets."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("e")).selectExpr("src", "e.dst dsts", "e.w ws")


def expand(adjacency: DataFrame) -> DataFrame:
    """(src, dst, w) from (src, dsts, ws), one row for each vertex."""
    return adjacency.select("src", F.explode(F.arrays_zip("dsts", "ws")).alias("e")).selectExpr("src", "e.dsts dst", "e.ws w")
