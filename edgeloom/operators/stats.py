"""Records, summaries, histograms and quantiles of graphs and searches; every one is a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import out_degree
from .search import at_ranks, histogram


def graph_record(edges: DataFrame, vertices_n: int) -> DataFrame:
    """One row of counts, density, degrees and weights; a graph without edges has zeros and a sparsity of 1.

    Edges are summed up by (src, dst) first, then by vertex: two exchanges, each after partial sums, whatever the hubs.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("total"))
    ends = F.array(
        F.struct(F.col("src").alias("vertex"), F.col("n").alias("out"), F.lit(1).cast("long").alias("pairs"), F.lit(0).cast("long").alias("into"), F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0).alias("loops"), "lo", "hi", "total"),
        F.struct(F.col("dst").alias("vertex"), F.lit(0).cast("long").alias("out"), F.lit(0).cast("long").alias("pairs"), F.col("n").alias("into"), F.lit(0).cast("long").alias("loops"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0.0).alias("total")),
    )
    by_vertex = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("vertex").agg(
        F.sum("out").alias("out"), F.sum("pairs").alias("pairs"), F.sum("into").alias("into"), F.sum("loops").alias("loops"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"),
    )
    cells = float(vertices_n) * vertices_n or 1.0
    return by_vertex.agg(
        F.count(F.lit(1)).alias("active_vertices"), F.coalesce(F.sum("out"), F.lit(0)).alias("total_edges"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("unique_edges"),
        F.coalesce(F.sum("loops"), F.lit(0)).alias("self_loops"), F.count_if(F.col("out") > 0).alias("active_sources"), F.count_if(F.col("into") > 0).alias("unique_targets"),
        F.coalesce(F.max("out"), F.lit(0)).alias("max_degree"), F.coalesce(F.min("lo"), F.lit(0.0)).alias("min_weight"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("max_weight"),
        F.coalesce(F.round(F.sum("total") / F.sum("out"), 6), F.lit(0.0)).alias("avg_weight"),
    ).selectExpr(
        f"{vertices_n}L num_vertices", "active_vertices", "total_edges", "unique_edges", "self_loops", "active_sources", "unique_targets",
        f"total_edges / {cells}D matrix_density", f"1 - total_edges / {cells}D matrix_sparsity", f"100 * (1 - total_edges / {cells}D) matrix_sparsity_pct",
        f"round(total_edges / {max(vertices_n, 1)}D, 6) avg_degree", "max_degree", "min_weight", "avg_weight", "max_weight",
    )


def binary_report(edges: DataFrame, vertices_n: int) -> DataFrame:
    """The report on a binary file: sources and targets with their shares in percent, degrees, density in percent, weights."""
    n = max(vertices_n, 1)
    return graph_record(edges, vertices_n).selectExpr(
        "num_vertices", "total_edges", "active_sources", f"round(100D * active_sources / {n}, 6) sources_pct", "unique_targets", f"round(100D * unique_targets / {n}, 6) targets_pct",
        "avg_degree", "max_degree", "round(100 * matrix_density, 9) density_pct", "min_weight", "avg_weight", "max_weight",
    )


def with_rate(df: DataFrame, edges: str = "traversed", seconds: str = "seconds") -> DataFrame:
    """Adds ``teps``: edges in a second, 0 without time."""
    return df.withColumn("teps", F.expr(f"case when {seconds} > 0 then {edges} / {seconds} else 0D end"))


def search_summary(edges: DataFrame, found: DataFrame, value: str, vertices_n: int) -> DataFrame:
    """One row for (vertex, value): reached, share of all vertices in percent, traversed edges, greatest, mean and least positive value."""
    x = F.col(value).cast("double")
    totals = found.join(out_degree(edges), "vertex", "left").agg(
        F.count(F.lit(1)).alias("reached"), F.coalesce(F.sum("degree"), F.lit(0)).alias("traversed"), F.coalesce(F.max(x), F.lit(0.0)).alias("greatest"),
        F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.min(F.when(x > 0, x)), F.lit(0.0)).alias("least_positive"),
    )
    return totals.selectExpr("reached", f"round(100D * reached / {max(vertices_n, 1)}, 6) coverage_pct", "traversed", "greatest", "mean", "least_positive")


def quantiles(values: DataFrame, column: str, at=(0.25, 0.5, 0.75)) -> DataFrame:
    """(q, value) by linear interpolation between exact ranks, with the least (0) and the greatest (1)."""
    points = sorted({0.0, *at, 1.0})
    ranks = {}
    for i, q in enumerate(points):
        ranks[f"a{i}"], ranks[f"b{i}"], ranks[f"m{i}"] = f"floor({q}D * (m - 1))", f"ceil({q}D * (m - 1))", "0"
    found = at_ranks(values, column, {k: v for k, v in ranks.items() if k[0] != "m"}, also_count=True)
    rows = ", ".join(f"({q}D, a{i} + (b{i} - a{i}) * ({q}D * (m - 1) - floor({q}D * (m - 1))))" for i, q in enumerate(points))
    return found.where("m is not null").selectExpr(f"inline(array({rows})) as (q, value)").selectExpr("q", "round(value, 9) value")


def edge_bins(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count): histogram() with the ends of each bin."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return values.sparkSession.createDataFrame([], "bin long, low double, high double, count long")
    lo, hi = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    width = (hi - lo) / bins
    return histogram(values, column, bins).selectExpr("bin", f"round({lo}D + bin * {width}D, 6) low", f"round({lo}D + (bin + 1) * {width}D, 6) high", "count")


def bins_from_zero(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, count) of equal width from 0 to the greatest value; nothing if that is 0."""
    top = values.agg(F.max(column)).first()[0]
    if not top or top <= 0:
        return values.sparkSession.createDataFrame([], "bin long, count long")
    counted = values.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(column) / F.lit(top / bins))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(bins).selectExpr("id bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))


def histogram_lines(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, line): a text histogram, the longest bar 40 signs long."""
    made = edge_bins(values, column, bins)
    top = F.max("count").over(Window.partitionBy(F.lit(0)))  # one row for each bin
    bar = F.expr("repeat('#', least(40, cast(floor(count / top * 40) as int)))")
    return made.withColumn("top", top).select("bin", F.format_string("[%.4f - %.4f] : %d vertices  %s", "low", "high", "count", bar).alias("line"))


def level_bars(found: DataFrame) -> DataFrame:
    """(depth, frontier_size, next_frontier_size, discovered, bar) of each level of (vertex, depth)."""
    sizes = found.groupBy("depth").agg(F.count(F.lit(1)).alias("frontier_size"))
    by_depth = Window.partitionBy(F.lit(0)).orderBy("depth")  # one row for each level
    made = sizes.select(
        "depth", "frontier_size", F.coalesce(F.lead("frontier_size").over(by_depth), F.lit(0)).alias("next_frontier_size"),
        F.sum("frontier_size").over(by_depth).alias("discovered"), F.sum("frontier_size").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    return made.selectExpr("depth", "frontier_size", "next_frontier_size", "discovered", "repeat('#', least(40, cast(floor(frontier_size / total * 40) as int))) bar")


def grid(edges: DataFrame, vertices_n: int, cells: int = 1024) -> DataFrame:
    """(row_bin, col_bin, cnt, max_w) of the matrix in at most cells x cells squares: what a plot shows. Small graphs: one each."""
    g = max(1, min(cells, vertices_n)) if vertices_n > 256 else max(1, vertices_n)
    n = max(1, vertices_n)
    return edges.groupBy(F.expr(f"src * {g}L div {n}").alias("row_bin"), F.expr(f"dst * {g}L div {n}").alias("col_bin")).agg(F.count(F.lit(1)).alias("cnt"), F.max("w").alias("max_w"))


def dense(spark, found: DataFrame, vertices_n: int, kind: str) -> DataFrame:
    """A row for every vertex: depth and parent -1, or dist infinite, where found has none."""
    ids = spark.range(vertices_n).selectExpr("id vertex").join(found, "vertex", "left")
    if kind == "bfs":
        return ids.selectExpr("vertex", "coalesce(depth, -1) depth", "coalesce(parent, -1L) parent")
    parent = "coalesce(parent, -1L) parent" if "parent" in found.columns else "cast(null as long) parent"
    return ids.selectExpr("vertex", "coalesce(dist, cast('infinity' as double)) dist", parent)


def first_errors(errors: DataFrame, shown: int = 5) -> tuple[bool, list[str]]:
    """(valid, lines): the first errors by kind and vertex, then how many more there are."""
    n = errors.count()
    lines = [f"{r['kind']}: vertex {r['vertex']} of root {r['root']}" for r in errors.orderBy("kind", "root", "vertex").limit(shown).collect()]
    return n == 0, lines + ([f"... and {n - shown} more"] if n > shown else [])
