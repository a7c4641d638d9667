"""Breadth-first search and shortest paths, for any number of roots at once, their validators and statistics.

State rows are keyed by (root, vertex). Each round unions the relaxed rows to the state and keeps the least of each key:
the edges are dealt by source once, a round exchanges its relaxed rows and the state and replaces one table by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, paths
from .graph import _cut, _partitions, _stored, dealt, out_degree

COMPACT = 16


def sample_roots(edges: DataFrame, n: int = 64, seed: int = 42) -> DataFrame:
    """n vertices of degree one or more, or all if there are fewer, by a hash of the id."""
    return out_degree(edges).orderBy(F.expr(f"((vertex & 4294967295) * -1640531535 + {seed * 40503 & 4294967295}) & 4294967295"), "vertex").limit(n).select(F.col("vertex").alias("root"))


def use_bottom_up(before: bool, volume: int, edges_n: int, size: int, vertices_n: int, alpha: float, beta: float) -> bool:
    return size >= vertices_n / beta if before else volume > edges_n / alpha


def bfs_multi(edges: DataFrame, roots: DataFrame, alpha: float = 14, beta: float = 24, log: list | None = None) -> DataFrame:
    """(root, vertex, depth, parent); the parent is the least vertex of the level above.

    The edges are dealt by source once. Each level is a table of its own: only new candidates are exchanged and taken
    against the levels before, and no level is written twice but when COMPACT of them are put together. A level of large
    edge volume is expanded from the unvisited side: vertices that no search has reached yet look for a neighbour in the
    frontier, for any number of roots (``log`` gets level, size, volume, direction).
    """
    spark = edges.sparkSession
    by_source = edges.select("src", "dst").repartition(_partitions(spark), "src").persist()
    by_target = None
    vertices = _cut(edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("one")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("one")))).alias("e")).groupBy("e.vertex").agg(F.sum("e.one").alias("degree")))
    vertices_n, edges_n = vertices.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    front = _cut(roots.selectExpr("root", "root vertex", "0 depth", "root parent").distinct().join(vertices, "vertex", "left").selectExpr("root", "vertex", "depth", "parent", "coalesce(degree, 0L) degree"))
    levels, level, up, searches = [], 0, False, None
    while True:
        size, volume = front.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
        searches = size if searches is None else searches
        if not size:
            by_source.unpersist()
            if by_target is not None:
                by_target.unpersist()
            return _union([*levels, front]).select("root", "vertex", "depth", "parent")
        up = use_bottom_up(up, volume, edges_n * searches, size, vertices_n * searches, alpha, beta)
        if log is not None:
            log.append((level, size, volume, int(up)))
        levels.append(front)
        if len(levels) > COMPACT:
            levels = [_cut(_union(levels))]
        known = _union([x.select("root", "vertex") for x in levels])
        here = front.select("root", F.col("vertex").alias("src"))
        if up:
            by_target = by_target if by_target is not None else edges.select("src", "dst").repartition(_partitions(spark), "dst").persist()
            # Vertices that some search has yet to reach, once each, whatever the number of searches.
            full = known.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= searches).select(F.col("vertex").alias("dst"))
            step = by_target.join(full, "dst", "left_anti").join(here, "src")
        else:
            step = here.join(by_source, "src")
        fresh = step.groupBy("root", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent")).join(known, ["root", "vertex"], "left_anti")
        front = _cut(fresh.join(vertices, "vertex").select("root", "vertex", F.lit(level + 1).alias("depth"), "parent", "degree"))
        level += 1


def bfs_words(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, vertex, depth, mask), (word, roots)): the levels of up to 64 searches in one number.

    Bit i of a mask stands for roots[i] of its word. A level is expanded once for all searches of a word: an edge sends one
    number, whatever the number of searches that cross it, and only first arrivals stay. The roots' ids go to the driver.
    """
    spark = edges.sparkSession
    ids = sorted(r["root"] for r in roots.select("root").distinct().collect())
    words = spark.createDataFrame([(i // 64, ids[i : i + 64]) for i in range(0, len(ids), 64)], "word int, roots array<long>")
    start = words.selectExpr("word", "posexplode(roots) as (i, vertex)").selectExpr("word", "vertex", "0 depth", "shiftleft(1L, i) mask")
    with dealt(edges, "src", "dst") as by_source:
        levels, depth = [front := _stored(start)], 0
        while front.limit(1).count():
            depth += 1
            if len(levels) > COMPACT:
                levels = [_stored(_union(levels), *levels[:-1])]
            here = front.selectExpr("word", "vertex src", "mask").hint("shuffle_hash")
            step = here.join(by_source.select("src", "dst"), "src").selectExpr("word", "dst vertex", "mask new", "0L old")
            known = _union(levels).selectExpr("word", "vertex", "0L new", "mask old")
            met = step.unionByName(known).groupBy("word", "vertex").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
            fresh = met.selectExpr("word", "vertex", f"{depth} depth", "new & ~old mask").where("mask <> 0")
            levels.append(front := _stored(fresh))
    return _union(levels), words


def _searches_of(found: DataFrame, words: DataFrame) -> DataFrame:
    """One row for each search of each mask: root in place of word and mask."""
    one = F.expr("explode(filter(roots, (r, i) -> shiftright(mask, i) & 1L = 1L))").alias("root")
    return found.join(F.broadcast(words), "word").select(one, *(c for c in found.columns if c not in ("word", "mask")))


def bfs_depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, vertex, depth); parents need bfs_multi."""
    return _searches_of(*bfs_words(edges, roots)).select("root", "vertex", "depth")


def bfs_searches(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """searches() of breadth-first searches; degrees meet the masks, not every search's row."""
    with dealt(edges, "src", "dst") as e:
        found, words = bfs_words(e, roots)
        return _stored(searches(e, _searches_of(found.join(out_degree(e), "vertex", "left"), words)))


def in_discovery_order(edges: DataFrame, root: int) -> DataFrame:
    """(vertex, depth, parent, place) where each level is scanned in the order of its discovery.

    A vertex's parent is the first of the level above, in that order, with an edge to it, and a level's order is that of its
    parents, then of the ids.
    """
    by_source = edges.select("src", "dst").persist()
    front = _cut(edges.sparkSession.range(root, root + 1).selectExpr("id vertex", "0 depth", "id parent", "0L place"))
    levels, depth = [front], 0
    while True:
        known = _union([x.select("vertex") for x in levels])
        step = front.selectExpr("vertex src", "place above").join(by_source, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min(F.struct("above", "src")).alias("x"))
        depth += 1
        fresh = _cut(step.join(known, "vertex", "left_anti").orderBy("x.above", "vertex").select("vertex", F.lit(depth).alias("depth"), F.col("x.src").alias("parent"), F.monotonically_increasing_id().alias("place")))
        if not fresh.limit(1).count():
            by_source.unpersist()
            return _union(levels)
        levels.append(fresh)
        if len(levels) > COMPACT:
            levels = [_cut(_union(levels))]
        front = fresh


def random_root(spark, vertices_n: int, seed: int = 42) -> DataFrame:
    """(root): one of all ids below vertices_n, also one without edges; by a hash of the id."""
    order = F.expr(f"((id & 4294967295) * -1640531535 + {seed * 40503 & 4294967295}) & 4294967295")
    return spark.range(vertices_n).orderBy(order, "id").limit(1).selectExpr("id root")


def timed(edges: DataFrame, roots: list[int], search) -> DataFrame:
    """(search, root, degree, reached, traversed, seconds, teps): the roots one by one, search(edges, root frame) timed."""
    import time

    spark, rows = edges.sparkSession, []
    for i, root in enumerate(roots):
        began = time.time()
        found = search(edges, spark.createDataFrame([(root,)], "root long"))
        r = searches(edges, found).first()
        seconds = time.time() - began
        rows.append((i, root, r["degree"], r["reached"], r["traversed"], seconds, r["traversed"] / seconds if seconds > 0 else 0.0))
    return spark.createDataFrame(rows, "search int, root long, degree long, reached long, traversed long, seconds double, teps double")


def sssp_multi(edges: DataFrame, roots: DataFrame, delta: float | None = None, log: list | None = None, degrees: bool = False) -> DataFrame:
    """(root, vertex, dist) over finite non-negative weights; with ``degrees`` also each vertex's out-degree.

    Without ``delta`` and ``log`` the executors relax blocks of files (paths.shortest), if they can open the shared folder.
    Otherwise rows are joined: without ``delta`` all improved vertices relax in each round. With it vertices are settled in buckets of that width:
    edges up to delta until the bucket rests, then the heavier ones once from all vertices of the bucket. ``log`` gets
    (bucket, light or heavy) of each round. It ends when no vertex is left to relax, so no limit on rounds is needed.
    """
    folder = paths.local(graph._folder(edges.sparkSession))
    if folder and delta is None and log is None:
        with dealt(edges, "src", "dst", "w") as e:
            return paths.shortest(e, roots, folder, degrees)
    with dealt(edges, "src", "dst", "w") as by_source:
        state = _stored(roots.selectExpr("root", "root vertex", "cast(0 as double) dist", "true light", "true heavy").distinct())
        while True:
            bucket = F.floor(F.col("dist") / delta) if delta else F.lit(0)
            least, any_light = state.where("light or heavy").groupBy(bucket.alias("b")).agg(F.max("light").alias("l")).agg(F.min("b"), F.min_by("l", "b")).first()
            if least is None:
                if not degrees:
                    return state.select("root", "vertex", "dist")
                return _stored(state.join(out_degree(by_source), "vertex", "left").selectExpr("root", "vertex", "dist", "coalesce(degree, 0L) degree"), state)
            kind = "light" if any_light or not delta else "heavy"
            if log is not None:
                log.append((least, kind))
            chosen = (bucket == least) & F.col(kind)
            use = by_source.select("src", "dst", "w")
            use = use if not delta else use.where((F.col("w") <= delta) if kind == "light" else (F.col("w") > delta))
            here = state.where(chosen).select("root", F.col("vertex").alias("src"), "dist").hint("shuffle_hash")
            step = here.join(use, "src").groupBy("root", F.col("dst").alias("vertex")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
            rested = state.withColumn(kind, F.col(kind) & ~chosen).withColumn("old", F.col("dist"))
            if not delta:
                rested = rested.withColumn("heavy", F.lit(False))
            no = F.lit(False)
            met = rested.unionByName(step.select("root", "vertex", "dist", no.alias("light"), no.alias("heavy"), F.lit(None).cast("double").alias("old")))
            best = met.groupBy("root", "vertex").agg(F.min("dist").alias("dist"), F.min("old").alias("old"), F.max("light").alias("light"), F.max("heavy").alias("heavy"))
            better = F.col("old").isNull() | (F.col("dist") < F.col("old"))
            state = _stored(best.select("root", "vertex", "dist", (F.col("light") | better).alias("light"), (F.col("heavy") | better if delta else no).alias("heavy")), state)


def with_parents(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(root, vertex, dist, parent): the tight predecessor of least (dist, hops, id); no cycles even at weight zero."""
    u, v = dist.selectExpr("root", "vertex src", "dist du"), dist.selectExpr("root", "vertex dst", "dist dv")
    tight = _cut(edges.join(u, "src").join(v, ["root", "dst"]).where("du + w = dv").select("root", "src", "dst", "du"))
    state, hop = _cut(dist.where("root = vertex").selectExpr("root", "vertex", "0 hops")), 0
    while True:
        step = state.where(F.col("hops") == hop).withColumnRenamed("vertex", "src").join(tight, ["root", "src"]).selectExpr("root", "dst vertex", f"{hop + 1} hops")
        state = _cut(state.unionByName(step).groupBy("root", "vertex").agg(F.min("hops").alias("hops")))
        hop += 1
        if not state.where(F.col("hops") == hop).limit(1).count():
            break
    best = tight.join(state.withColumnRenamed("vertex", "src"), ["root", "src"]).where("dst <> root").groupBy("root", F.col("dst").alias("vertex")).agg(F.min(F.struct("du", "hops", "src")).alias("x"))
    return dist.join(best, ["root", "vertex"], "left").select("root", "vertex", "dist", F.when(F.col("root") == F.col("vertex"), F.col("root")).otherwise(F.col("x.src")).alias("parent"))


def validate_bfs(edges: DataFrame, found: DataFrame, strict: bool = False) -> DataFrame:
    """Error rows (kind, root, vertex) of (root, vertex, depth, parent); no row: valid."""
    tree = found.where("vertex <> root and parent is not null")
    above = found.selectExpr("root", "vertex parent", "depth above")
    out = [
        found.where("vertex = root and (parent is null or parent <> root or depth <> 0)").selectExpr("'root' kind", "root", "vertex"),
        found.where("vertex <> root and parent is null").selectExpr("'no parent' kind", "root", "vertex"),
        tree.join(edges.selectExpr("src parent", "dst vertex"), ["parent", "vertex"], "left_anti").selectExpr("'no such edge' kind", "root", "vertex"),
        tree.join(above, ["root", "parent"], "left").where("above is null or depth <> above + 1").selectExpr("'depth' kind", "root", "vertex"),
    ]
    if strict:
        left, right = found.selectExpr("root", "vertex src", "depth du"), found.selectExpr("root", "vertex dst", "depth dv")
        out.append(edges.select("src", "dst").join(left, "src").join(right, ["root", "dst"], "left").where("dv is null or dv > du + 1").selectExpr("'edge spans levels' kind", "root", "dst vertex"))
    return _union(out)


def validate_sssp(edges: DataFrame, found: DataFrame, root_tolerance: float = 1e-9, tolerance: float = 1e-7) -> DataFrame:
    """Error rows (kind, root, vertex) of (root, vertex, dist, parent)."""
    tree = found.where("vertex <> root and parent is not null")
    link = tree.join(edges.selectExpr("src parent", "dst vertex", "w").groupBy("parent", "vertex").agg(F.min("w").alias("w")), ["parent", "vertex"], "left")
    above = found.selectExpr("root", "vertex parent", "dist above")
    left, right = found.selectExpr("root", "vertex src", "dist du"), found.selectExpr("root", "vertex dst", "dist dv")
    return _union([
        found.where(f"vertex = root and (parent is null or parent <> root or abs(dist) > {root_tolerance})").selectExpr("'root' kind", "root", "vertex"),
        found.where("vertex <> root and parent is null").selectExpr("'no parent' kind", "root", "vertex"),
        link.where("w is null").selectExpr("'no such edge' kind", "root", "vertex"),
        link.join(above, ["root", "parent"], "left").where(f"above is null or abs(dist - (above + w)) > {tolerance}").selectExpr("'distance' kind", "root", "vertex"),
        edges.join(left, "src").join(right, ["root", "dst"], "left").where(f"dv is null or dv > du + w + {tolerance}").selectExpr("'triangle' kind", "root", "dst vertex"),
    ])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def searches(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(root, degree, reached, traversed) of each root; traversed is the sum of the reached vertices' degrees, which found may have."""
    d = out_degree(edges)
    known = found if "degree" in found.columns else found.join(d, "vertex", "left")
    per = known.groupBy("root").agg(F.count(F.lit(1)).alias("reached"), F.coalesce(F.sum("degree"), F.lit(0)).alias("traversed"))
    return per.join(d.selectExpr("vertex root", "degree"), "root", "left").select("root", F.coalesce("degree", F.lit(0)).alias("degree"), "reached", "traversed")


def at_ranks(values: DataFrame, column: str, ranks: dict[str, str], also_count: bool = False) -> DataFrame:
    """One row: for each name the value at a rank (from 0, an expression of the count ``m``) of the ascending values.

    Exact, and no task holds all values: distinct values with their counts are dealt by ranges, then running sums are
    taken inside the ranges; only one sum a range goes through the window without a partition.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    dealt = _cut(counted.repartitionByRange("x").select("x", "n", F.spark_partition_id().alias("part")))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("x")) - F.col("n")
    placed = dealt.withColumn("inside", inside).join(F.broadcast(before), "part").crossJoin(F.broadcast(sums.agg(F.sum("total").alias("m")))).selectExpr("x", "n", "m", "before + inside below")
    return placed.agg(*(F.expr(f"max(case when below <= {rank} and {rank} < below + n then x end)").alias(name) for name, rank in ranks.items()), *([F.max("m").alias("m")] if also_count else []))


def rate_stats(rates: DataFrame) -> DataFrame:
    """Statistics of a column ``teps``, of any length. The harmonic mean lets values <= 0 add nothing."""
    ranks = {"q1": "floor(0.25D * (m - 1))", "low": "(m - 1) div 2", "high": "m div 2", "q3": "floor(0.75D * (m - 1))"}
    rest = rates.selectExpr("teps", "case when teps > 0 then 1 / teps else 0D end inv").agg(
        F.min("teps").alias("min"), F.max("teps").alias("max"), F.round(F.avg("teps"), 6).alias("mean"), F.round(F.stddev_pop("teps"), 6).alias("sd"),
        F.round(F.expr("case when sum(inv) > 0 then count(teps) / sum(inv) else 0D end"), 6).alias("harmonic"),
    )
    both = rest.crossJoin(at_ranks(rates, "teps", ranks))
    return both.selectExpr("min", "q1", "0.5D * low + 0.5D * high median", "q3", "max", "mean", "sd", "harmonic")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, count) of equal width from the least to the greatest value, the last bin closed, empty bins as 0."""
    x = F.col(column)
    lo, hi = values.agg(F.min(x), F.max(x)).first()
    if lo is None:
        counted = values.selectExpr("0L bin", "0L n").limit(0)
    else:
        lo, hi = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
        counted = values.groupBy(F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) / bins))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(bins).selectExpr("id bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))


def vertices_n(edges: DataFrame) -> int:
    """The greatest vertex id + 1, or 0 if there are no edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]


def row_pointers(edges: DataFrame, vertices_n: int, block: int = 1 << 16) -> DataFrame:
    """(vertex, indptr) for 0 .. vertices_n: sums of id blocks, their running sum, then running sums inside the blocks."""
    ids = edges.sparkSession.range(vertices_n + 1).selectExpr("id vertex").join(out_degree(edges), "vertex", "left").selectExpr("vertex", "coalesce(degree, 0) degree", f"vertex div {block} block")
    sums = ids.groupBy("block").agg(F.sum("degree").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("degree").over(Window.partitionBy("block").orderBy("vertex")) - F.col("degree")
    return ids.withColumn("inside", inside).join(before, "block").selectExpr("vertex", "before + inside indptr")
