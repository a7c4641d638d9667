"""Command line: python -m edgeloom.cli generate | bfs | sssp | plot [options].

Graph files are taken in any form that ``sources.files`` reads. A source or root below zero means the vertex of highest
degree; none means a random one for ``--source`` and the highest degree for ``--root``. ``--bench`` searches from 64 roots one
by one and reports rates. Figures are printed as plain lines, plots are written as tables of squares or bins (Parquet),
since nothing here draws.
"""

from __future__ import annotations

import argparse
import json
import random
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import generate as gen
from edgeloom.operators import graph, search, stats
from edgeloom.sources import files


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="edgeloom", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    kinds = top.add_subparsers(dest="command", required=True)
    made = kinds.add_parser("generate", help="a synthetic graph")
    made.add_argument("-s", "--scale", type=int, default=10)
    made.add_argument("-ef", "--edge-factor", "--edges-per-vertex", type=int, default=16)
    made.add_argument("-a", "--initiator", nargs=4, type=float, default=list(gen.INITIATOR))
    made.add_argument("-o", "--output")
    made.add_argument("--format", choices=["bin", "csr", "npz", "edgelist"], default="bin")
    made.add_argument("--seed", type=int)
    made.add_argument("--mode", choices=["stochastic", "exact"], default="stochastic")
    made.add_argument("--scramble", nargs="?", const="bijective", choices=list(gen.SCRAMBLES))
    for flag in ("--unweighted", "--keep-self-loops", "--no-symmetrize", "--allow-duplicates", "--stats"):
        made.add_argument(flag, action="store_true")
    made.add_argument("--plot-matrix", "--plot", nargs="?", const="adjacency_matrix.parquet")
    for name, what in (("bfs", "breadth-first search"), ("sssp", "shortest paths")):
        p = kinds.add_parser(name, help=what)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-src", "--source", type=int)
        p.add_argument("-r", "--root", type=int)
        p.add_argument("--seed", type=int)
        for flag in ("--validate", "--stats", "--bench"):
            p.add_argument(flag, action="store_true")
        p.add_argument("--searches", type=int, default=64)
        if name == "bfs":
            p.add_argument("--alpha", type=float, default=14.0)
            p.add_argument("--beta", type=float, default=24.0)
        else:
            p.add_argument("--delta", type=float, default=0.1)
            p.add_argument("--plot-histogram", nargs="?", const="sssp_histogram.parquet")
    p = kinds.add_parser("plot", help="the squares of an adjacency plot")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", default="adjacency_matrix.parquet")
    p.add_argument("--grid-size", type=int, default=1024)
    p.add_argument("--stats", action="store_true")
    for p in kinds.choices.values():
        p.add_argument("--magic", default=files.MAGIC.decode(), help="the eight bytes that binary files begin with")
    return top


def show(df: DataFrame, say) -> None:
    for name, value in df.first().asDict().items():
        say(f"{name}: {value}")


def generate(spark: SparkSession, a, say) -> DataFrame:
    seed = random.randrange(1 << 31) if a.seed is None else a.seed
    n = 1 << a.scale
    began = time.time()
    if a.mode == "exact":
        sampled = gen.exact(spark, a.scale, a.initiator, seed, a.scramble)
    else:
        sampled = gen.stochastic(spark, a.scale, a.edge_factor, a.initiator, seed, a.scramble)
    edges = graph.post_process(sampled, not a.keep_self_loops, not a.no_symmetrize, not a.allow_duplicates).persist()
    say(f"seed: {seed}\nvertices: {n}\nentries: {edges.count()}\nseconds: {time.time() - began:.3f}")
    if a.stats or not a.output:
        show(stats.graph_record(edges, n), say)
    if a.output:
        say(f"written: {a.output} ({files.save(edges, n, a.output, a.format, not a.unweighted, a.magic.encode())})")
    else:
        for r in edges.orderBy("src", "dst", "w").limit(10).collect():
            say(f"{r['src']} -> {r['dst']}: {r['w']:.6f}")
    if a.plot_matrix:
        stats.grid(edges, n).write.mode("overwrite").parquet(a.plot_matrix)
    return edges


def chosen(edges: DataFrame, n: int, a) -> int:
    given = a.source if a.source is not None else a.root
    if given is None and a.root is None and a.source is None and a.seed is not None:
        return search.random_root(edges.sparkSession, n, a.seed).first()["root"]
    if given is None or given < 0:
        top = graph.top_degree_root(edges).first()
        if top is None:
            raise ValueError("a graph without edges has no vertex of highest degree")
        return top["vertex"]
    if given >= n:
        raise ValueError(f"vertex {given} in a graph of {n}")
    return given


def traverse(spark: SparkSession, a, say) -> DataFrame:
    edges, n = files.load(spark, a.input, magic=a.magic.encode())
    edges = edges.persist()
    is_bfs, log = a.command == "bfs", []
    run = (lambda e, r: search.bfs_multi(e, r, a.alpha, a.beta)) if is_bfs else (lambda e, r: search.sssp_multi(e, r, a.delta, log))
    if a.bench:
        roots = [r["root"] for r in search.sample_roots(edges, a.searches, 42 if a.seed is None else a.seed).collect()]
        done = search.timed(edges, roots, run).persist()
        say(f"searches: {len(roots)}")
        if a.stats:
            for r in done.orderBy("search").collect():
                say(json.dumps(r.asDict()))
        show(search.rate_stats(done), say)
        return done
    root = chosen(edges, n, a)
    one = spark.createDataFrame([(root,)], "root long")
    began = time.time()
    found = (search.bfs_multi(edges, one, a.alpha, a.beta, log) if is_bfs else run(edges, one)).persist()
    value = "depth" if is_bfs else "dist"
    summary = stats.search_summary(edges, found.select("vertex", value), value, n).withColumn("seconds", F.lit(time.time() - began))
    say(f"root: {root}")
    if a.validate:
        errors = search.validate_bfs(edges, found) if is_bfs else search.validate_sssp(edges, search.with_parents(edges, found))
        valid, lines = stats.first_errors(errors)
        say("valid" if valid else "\n".join(["not valid", *lines]))
    if a.stats or not a.validate:
        show(stats.with_rate(summary), say)
        if is_bfs:
            for r in stats.level_bars(found).orderBy("depth").collect():
                say(f"depth {r['depth']}: {r['frontier_size']} {r['bar']}")
            for level, size, volume, up in log:
                say(f"level {level}: {'bottom-up' if up else 'top-down'}, {size} vertices, {volume} edges")
        else:
            say(f"rounds: {len(log)}, heavy: {sum(kind == 'heavy' for _, kind in log)}")
            for r in stats.quantiles(found, "dist").orderBy("q").collect():
                say(f"quantile {r['q']}: {r['value']:.6f}")
            for r in stats.histogram_lines(found, "dist").orderBy("bin").collect():
                say(r["line"])
    if not is_bfs and a.plot_histogram:
        stats.edge_bins(found, "dist", 30).write.mode("overwrite").parquet(a.plot_histogram)
    return found


def plot(spark: SparkSession, a, say) -> DataFrame:
    edges, n = files.load(spark, a.input, magic=a.magic.encode())
    if a.stats:
        show(stats.binary_report(edges, n), say)
    squares = stats.grid(edges, n, a.grid_size)
    squares.write.mode("overwrite").parquet(a.output)
    say(f"written: {a.output}")
    return squares


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say=print) -> DataFrame:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("edgeloom").getOrCreate()
    return {"generate": generate, "bfs": traverse, "sssp": traverse, "plot": plot}[a.command](spark, a, say)


if __name__ == "__main__":
    main()
