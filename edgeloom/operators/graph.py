"""Edge lists (src, dst, w): cleaning, degrees, statistics, breadth-first search and shortest paths."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def post_process(edges: DataFrame, remove_self_loops: bool = True, symmetrize: bool = True, collapse_duplicates: bool = True) -> DataFrame:
    if remove_self_loops:
        edges = edges.where("src <> dst")
    both = F.explode(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    if remove_self_loops and symmetrize and collapse_duplicates:  # both directions have the same least weight
        pairs = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))
        return pairs.select(both.alias("e")).select("e.*")
    if symmetrize:
        edges = edges.select(both.alias("e")).select("e.*")
    return edges.groupBy("src", "dst").agg(F.min("w").alias("w")) if collapse_duplicates else edges


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def active_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def top_degree_root(edges: DataFrame) -> DataFrame:
    return out_degree(edges).orderBy(F.desc("degree"), "vertex").limit(1)


def bfs(edges: DataFrame, root: int) -> DataFrame:
    """(vertex, depth, parent) of what root reaches; the parent is the least vertex of the level above."""
    from .search import bfs_multi

    return bfs_multi(edges, _one(edges, root)).select("vertex", "depth", "parent")


def sssp(edges: DataFrame, root: int, delta: float | None = None) -> DataFrame:
    """(vertex, dist) over non-negative weights; see search.sssp_multi."""
    from .search import sssp_multi

    return sssp_multi(edges, _one(edges, root), delta).select("vertex", "dist")


def _one(edges: DataFrame, root: int) -> DataFrame:
    if root < 0:
        raise ValueError("a root is a vertex id of 0 or more")
    return edges.sparkSession.range(root, root + 1).selectExpr("id root")


def _folder(spark) -> str:
    """The folder that driver and executors share; without spark.checkpoint.dir a local session makes one up."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _stored(df: DataFrame, *old: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder; then the tables ``old``, which only df has read, go, and shuffle files that nothing needs."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/graph-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    for x in old:
        _delete(spark, x.scratch_path)
    _tidy(spark)
    return made


def _delete(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _tidy(spark) -> None:
    """Shuffle files stay until the driver collects its garbage, which is too late for rounds that write some each."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def dealt(edges: DataFrame, *columns: str):
    """The edges' columns as a table of buckets by source, made once: joins on src and counts by src exchange none of them.

    At the end the table goes: no result may still read it. Edges that are dealt already stay as they are.
    """
    if hasattr(edges, "dealt"):
        yield edges
        return
    spark, n = edges.sparkSession, _partitions(edges.sparkSession)
    name = f"edgeloom_{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{name}"
    try:
        edges.select(*columns).repartition(n, "src").write.format("parquet").bucketBy(n, "src").option("path", path).saveAsTable(name)
        _tidy(spark)
        table = spark.table(name)
        table.dealt = n
        yield table
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("total_edges"), F.countDistinct("src").alias("active_sources"), F.countDistinct("dst").alias("unique_targets"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"), F.min("w").alias("min_weight"), F.max("w").alias("max_weight"), F.round(F.avg("w"), 6).alias("avg_weight"))
