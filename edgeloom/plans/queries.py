"""The registered queries over the graph derived from orders and lineitem, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from edgeloom.operators import generate as k
from edgeloom.operators import graph as g
from edgeloom.operators import search as h
from edgeloom.sources import files


THIN = 3


def raw(spark, d, most=THIN):
    """One edge for each line of an order: the thinned graph of lines of at most that quantity, or all with None."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    li = li if most is None else li.where(F.col("l_quantity") <= most)
    li = li.selectExpr("l_orderkey", "2*l_partkey+1 AS dst", "l_discount + l_tax + l_quantity/1000 AS w")
    return o.join(li, F.expr("o_orderkey = l_orderkey")).selectExpr("2*o_custkey AS src", "dst", "w")


def edges(spark, d, most=THIN):
    return g.post_process(raw(spark, d, most))


def _root(e):
    return g.top_degree_root(e).first()["vertex"]


RAW = "b AS (SELECT 2*o_custkey AS src, 2*l_partkey+1 AS dst, l_discount + l_tax + l_quantity/1000 AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity <= 3), s AS (SELECT src, dst, w FROM b WHERE src <> dst UNION ALL SELECT dst, src, w FROM b WHERE src <> dst)"
E = f"WITH RECURSIVE {RAW}, e AS (SELECT src, dst, min(w) AS w FROM s GROUP BY src, dst)"
DEG = "deg AS (SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src)"
TOP = f"{DEG}, top AS (SELECT vertex, degree FROM deg ORDER BY degree DESC, vertex LIMIT 1)"
BFS = f"{TOP}, r(vertex, d) AS (SELECT vertex, 0 FROM top UNION SELECT dst, d + 1 FROM r JOIN e ON src = vertex WHERE d < 30), l AS (SELECT vertex, min(d) AS depth FROM r GROUP BY vertex)"

QUERIES = {
    "symmetrize": lambda s, d, most=THIN: g.post_process(raw(s, d, most), collapse_duplicates=False),
    "collapse_min": edges,
    "no_self_loops": lambda s, d, most=THIN: g.post_process(raw(s, d, most), True, False, False),
    "out_degree": lambda s, d, most=THIN: g.out_degree(edges(s, d, most)),
    "active_vertices": lambda s, d, most=THIN: g.active_vertices(edges(s, d, most)),
    "top_degree_root": lambda s, d, most=THIN: g.top_degree_root(edges(s, d, most)),
    "graph_stats": lambda s, d, most=THIN: g.graph_stats(edges(s, d, most)),
    "light_heavy_split": lambda s, d, most=THIN: edges(s, d, most).select("src", "dst", (F.col("w") <= 0.1).alias("light")),
    "bfs_levels": lambda s, d, most=THIN: g.bfs(e := edges(s, d, most), _root(e)).groupBy("depth").agg(F.count(F.lit(1)).alias("frontier_size")),
    "sssp_dist": lambda s, d, most=THIN: g.sssp(e := edges(s, d, most), _root(e)),
}
ORACLE = {
    "symmetrize": f"WITH {RAW} SELECT src, dst, w FROM s",
    "collapse_min": f"{E} SELECT src, dst, w FROM e",
    "no_self_loops": f"WITH {RAW} SELECT src, dst, w FROM b WHERE src <> dst",
    "out_degree": f"{E}, {DEG} SELECT vertex, degree FROM deg",
    "active_vertices": f"{E} SELECT src AS vertex FROM e UNION SELECT dst FROM e",
    "top_degree_root": f"{E}, {TOP} SELECT vertex, degree FROM top",
    "graph_stats": f"{E} SELECT count(*) AS total_edges, count(DISTINCT src) AS active_sources, count(DISTINCT dst) AS unique_targets, count(CASE WHEN src = dst THEN 1 END) AS self_loops, min(w) AS min_weight, max(w) AS max_weight, round(avg(w), 6) AS avg_weight FROM e",
    "light_heavy_split": f"{E} SELECT src, dst, w <= 0.1 AS light FROM e",
    "bfs_levels": f"{E}, {BFS} SELECT depth, count(*) AS frontier_size FROM l GROUP BY depth",
}


def _csr_entries(s, d, most=THIN):
    from pyspark.sql import Window

    return edges(s, d, most).select("src", F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("long").alias("slot"), "dst", "w")


QUERIES |= {
    "csr_entries": _csr_entries,
    "adj_grid": lambda s, d, most=THIN: edges(s, d, most).groupBy(F.expr("src div 100").alias("row_bin"), F.expr("dst div 100").alias("col_bin")).agg(F.count(F.lit(1)).alias("cnt"), F.max("w").alias("max_w")),
    "edge_head10": lambda s, d, most=THIN: edges(s, d, most).orderBy("src", "dst").limit(10),
    "top10_degree": lambda s, d, most=THIN: g.out_degree(edges(s, d, most)).orderBy(F.desc("degree"), "vertex").limit(10),
    "adj_binary": lambda s, d, most=THIN: edges(s, d, most).select("src", "dst", F.when(F.col("w") > 0, 1.0).otherwise(0.0).alias("present")),
    "degree_histogram": lambda s, d, most=THIN: g.out_degree(edges(s, d, most)).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices")),
}
ORACLE |= {
    "csr_entries": f"{E} SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) AS slot, dst, w FROM e",
    "adj_grid": f"{E} SELECT src // 100 AS row_bin, dst // 100 AS col_bin, count(*) AS cnt, max(w) AS max_w FROM e GROUP BY 1, 2",
    "edge_head10": f"{E} SELECT src, dst, w FROM e ORDER BY src, dst LIMIT 10",
    "top10_degree": f"{E}, {DEG} SELECT vertex, degree FROM deg ORDER BY degree DESC, vertex LIMIT 10",
    "adj_binary": f"{E} SELECT src, dst, CASE WHEN w > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS present FROM e",
    "degree_histogram": f"{E}, {DEG} SELECT degree, count(*) AS vertices FROM deg GROUP BY degree",
}


def _top(e):
    return g.top_degree_root(e).selectExpr("vertex root")


def _directions(s, d, most=THIN):
    e, log = edges(s, d, most), []
    h.bfs_multi(e, _top(e), log=log)
    return s.createDataFrame(log, "level int, size long, volume long, bottom_up int")


def _tree(s, d, most=THIN):
    return h.bfs_multi(e := edges(s, d, most), _top(e))


def _searches(s, d, most=THIN):
    with g.dealt(edges(s, d, most), "src", "dst") as e:
        return h.bfs_searches(e, h.sample_roots(e))


def _indptr(s, d, most=THIN):
    e = edges(s, d, most)
    return h.row_pointers(e, h.vertices_n(e), 512)


def _paths(s, d, most=THIN):
    e = edges(s, d, most)
    return e, h.with_parents(e, h.sssp_multi(e, _top(e), 0.1))


SCALE = 10
QUERIES |= {
    "rmat_edges": lambda s, d: k.stochastic(s, SCALE),
    "kron_prob": lambda s, d: k.cell_probabilities(s, 5).selectExpr("src", "dst", "round(p, 12) p"),
    "exact_edges": lambda s, d: k.exact(s, 5),
    "scramble_compatible": lambda s, d: s.range(1 << SCALE).selectExpr("id vertex", f"{k.compatible_sql('id', SCALE)} scrambled"),
    "csr_indptr": _indptr,
    "bfs_tree": lambda s, d, most=THIN: _tree(s, d, most).select("vertex", "depth", "parent"),
    "bfs_directions": _directions,
    "validate_bfs": lambda s, d, most=THIN: h.validate_bfs(edges(s, d, most), _tree(s, d, most), strict=True),
    "validate_sssp": lambda s, d, most=THIN: h.validate_sssp(*_paths(s, d, most)),
    "bench_roots": lambda s, d, most=THIN: h.sample_roots(edges(s, d, most)),
    "bench_searches": _searches,
    "edgelist_lines": lambda s, d, most=THIN: files.edge_lines(edges(s, d, most)),
    "teps_stats": lambda s, d, most=THIN: h.rate_stats(g.out_degree(edges(s, d, most)).selectExpr("cast(degree as double) teps")),
    "degree_bins": lambda s, d, most=THIN: h.histogram(g.out_degree(edges(s, d, most)).selectExpr("cast(degree as double) x"), "x", 5),
}
_MIX = "SELECT id, l, xor(x, x >> 16) / 4294967296.0::DOUBLE AS r FROM (SELECT id, l, (xor(x, x >> 15) * -2073254261) & 4294967295 AS x FROM (SELECT id, l, (xor(x, x >> 16) * 2146121005) & 4294967295 AS x FROM (SELECT id, l, ((((id * 64 + l) & 4294967295) * -1640531535) + 1701126) & 4294967295 AS x FROM {})))"
_LEVELS = f"(SELECT id, l FROM range({16 << SCALE}) t(id), (SELECT range AS l FROM range({SCALE}) UNION ALL SELECT 63))"
_CELL = "SELECT id, id >> 5 AS src, id & 31 AS dst, pow(0.57, 5 - bit_count((id >> 5) | (id & 31))) * pow(0.19, bit_count(xor(id >> 5, id & 31))) * pow(0.05, bit_count((id >> 5) & (id & 31))) AS p FROM range(1024) t(id)"
ORACLE |= {
    "rmat_edges": f"WITH r AS ({_MIX.format(_LEVELS)}), q AS (SELECT id, l, r, CASE WHEN r < 0.57::DOUBLE THEN 0 WHEN r < 0.57::DOUBLE + 0.19::DOUBLE THEN 1 WHEN r < 0.57::DOUBLE + 0.19::DOUBLE + 0.19::DOUBLE THEN 2 ELSE 3 END AS q FROM r) SELECT cast(sum(CASE WHEN l < {SCALE} THEN (q >> 1) * (1 << cast({SCALE - 1} - l AS INT)) END) AS BIGINT) AS src, cast(sum(CASE WHEN l < {SCALE} THEN (q & 1) * (1 << cast({SCALE - 1} - l AS INT)) END) AS BIGINT) AS dst, max(CASE WHEN l = 63 THEN r END) AS w FROM q GROUP BY id".replace(f"{SCALE - 1} - l AS", f"greatest({SCALE - 1} - l, 0) AS"),
    "kron_prob": f"SELECT src, dst, round(p, 12) AS p FROM ({_CELL})",
    "exact_edges": f"WITH r AS ({_MIX.format('(SELECT id, l FROM range(1024) t(id), (VALUES (62), (63)) v(l))')}) SELECT c.src, c.dst, b.r AS w FROM ({_CELL}) c JOIN r a ON a.id = c.id AND a.l = 62 JOIN r b ON b.id = c.id AND b.l = 63 WHERE a.r < p",
    "scramble_compatible": f"SELECT id AS vertex, xor(x, x >> {SCALE}) & {(1 << SCALE) - 1} AS scrambled FROM (SELECT id, (id * 2654435761 + ((42::BIGINT * 1013904223) & 4294967295)) & 4294967295 AS x FROM range({1 << SCALE}) t(id))",
    "csr_indptr": f"{E}, {DEG} SELECT v.id AS vertex, cast(coalesce(sum(coalesce(degree, 0)) OVER (ORDER BY v.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM range(5001) v(id) LEFT JOIN deg ON deg.vertex = v.id",
    "bfs_tree": f"{E}, {BFS} SELECT c.vertex, c.depth, coalesce(min(e.src) FILTER (WHERE p.vertex IS NOT NULL), c.vertex) AS parent FROM l c LEFT JOIN e ON e.dst = c.vertex LEFT JOIN l p ON p.vertex = e.src AND p.depth = c.depth - 1 GROUP BY c.vertex, c.depth",
    "validate_bfs": "SELECT '' AS kind, 0::BIGINT AS root, 0::BIGINT AS vertex WHERE false",
    "validate_sssp": "SELECT '' AS kind, 0::BIGINT AS root, 0::BIGINT AS vertex WHERE false",
    "bench_roots": f"{E}, {DEG} SELECT vertex AS root FROM deg ORDER BY (vertex * 2654435761 + 1701126) & 4294967295, vertex LIMIT 64",
    "edgelist_lines": f"{E} SELECT concat(src, chr(9), dst, chr(9), printf('%.6f', w)) AS line FROM e",
    "teps_stats": f"{E}, {DEG}, t AS (SELECT cast(degree AS DOUBLE) AS x FROM deg WHERE vertex < 200), n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () - 1 AS m FROM t) SELECT min(x) AS min, max(CASE WHEN i = floor(0.25 * m) THEN x END) AS q1, median(x) AS median, max(CASE WHEN i = floor(0.75 * m) THEN x END) AS q3, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(count(*) / sum(1 / x), 6) AS harmonic FROM n",
}

#: The same queries over all of lineitem; no SQL where that of the thinned graph is bound to its ids.
WHOLE = [name for name in QUERIES if name not in ("rmat_edges", "kron_prob", "exact_edges", "scramble_compatible")]
QUERIES |= {f"{name}_whole": partial(QUERIES[name], most=None) for name in WHOLE}
ORACLE |= {f"{name}_whole": ORACLE[name].replace(" WHERE l_quantity <= 3", "") for name in WHOLE if name in ORACLE and name not in ("csr_indptr", "teps_stats")}
