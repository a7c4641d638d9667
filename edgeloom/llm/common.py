"""What the text operators share: tables, scratch folders, partition counts, packed blocks.

Conventions that hold for every operator of this subpackage:

* Only ``doc_id`` and ``text`` (or the columns an operator names) are read, by selecting them
  first, so extra columns of any name do no harm.
* A null text counts as an empty one unless an operator says otherwise.
* A null ``doc_id`` is the id of one document that sorts before all others; it comes back as null.
* A ``doc_id`` on several rows is one document with the greatest of its texts; it comes back once.
* Scratch tables go to ``spark.checkpoint.dir`` and are deleted after their last reader; a folder is made up only in a local
  session where that is unset.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one; a local session without that setting gets a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="edgeloom-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/edgeloom/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    Most tables hold hashes and packed blocks, which a codec makes no smaller; its native buffers stay with the executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete tables of through_table() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the whole corpus gets: the session's setting, which grows with the data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession) -> None:
    """Let no batch that Python gets be much larger than BATCH_BYTES, however long the texts, unless the session says more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, str(BATCH_BYTES))


def tidy() -> None:
    """Give freed memory back to the system: the worker may wait beside others for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each id and no null id (see the conventions above)."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return d.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else d


def one_row(docs: DataFrame) -> DataFrame:
    """All columns, one row for each id (that of the greatest text, then of the greatest other columns) and no null id."""
    bounded_batches(docs.sparkSession)
    d = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    if not d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return d
    rest = [x for x in d.columns if x not in ("doc_id", "text")]
    return d.groupBy("doc_id").agg(F.max(F.struct("text", *rest)).alias("x")).select(*(F.col("x")[n].alias(n) if n != "doc_id" else F.col(n) for n in d.columns))


def own_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Give the document without an id its null back."""
    return df.withColumn(name, F.when(F.col(name) != NO_ID, F.col(name)))


def spread(doc_id, n: int):
    """A column that deals ids into n bins, the same as bin_of()."""
    x = doc_id.bitwiseXOR(F.shiftrightunsigned(doc_id, 31)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.pmod(F.shiftright(x * F.lit(2654435761), 15), F.lit(n)).cast("int")


def bin_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    u = doc_id.astype(np.int64).view(np.uint64)
    x = (u ^ (u >> np.uint64(31))) & np.uint64(0x7FFFFFFF)
    return (((x * np.uint64(2654435761)) >> np.uint64(15)) % np.uint64(n)).astype(np.int32)


_CODEC = None


def codec() -> pa.Codec:
    global _CODEC
    if _CODEC is None:
        _CODEC = pa.Codec("zstd", compression_level=1)
    return _CODEC


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block: the bytes of each by significance, then compressed."""
    head, raw = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.kind), a.itemsize, len(a)]
        raw.append(a.tobytes() if a.itemsize == 1 else a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    body = b"".join(raw)
    return np.array([*head, len(body)], "<i8").tobytes() + codec().compress(body, asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    head = np.frombuffer(block, "<i8", 2 + 3 * n)
    body = codec().decompress(block[8 * len(head) :], decompressed_size=int(head[-1]), asbytes=True)
    out, at = [], 0
    for kind, size, count in head[1:-1].reshape(n, 3).tolist():
        part = np.frombuffer(body, np.uint8, size * count, at)
        at += size * count
        if size > 1:
            part = np.ascontiguousarray(part.reshape(size, count).T).reshape(-1)
        out.append(part.view(f"{chr(kind)}{size}"))
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int):
    """Row ranges (lo, hi) of at most that many bytes each, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def joined(batches, most: int):
    """Neighbouring batches put together until they have that many bytes."""
    have, size = [], 0
    for batch in batches:
        have.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(have)
            have, size = [], 0
    if have:
        yield pa.concat_batches(have)


def text_slices(batches, most: int = 1 << 21, text: str = "text"):
    """(batch, lo, hi, bytes, offsets) over Arrow batches, bounded in bytes whatever the batch size."""
    for batch in batches:
        data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in slices(offs, most):
            yield batch, lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
    tidy()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)
