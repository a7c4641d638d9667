"""The queries registered with the driver: those of ``queries`` over all of lineitem, single steps, reports and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.operators import generate as k
from edgeloom.operators import graph as g
from edgeloom.operators import search as h
from edgeloom.operators import stats as st
from edgeloom.sources import files

from . import queries as q

RAW = q.RAW.replace(" WHERE l_quantity <= 3", "")
E = f"WITH RECURSIVE {RAW}, e AS (SELECT src, dst, min(w) AS w FROM s GROUP BY src, dst)"
DEG, TOP, BFS = q.DEG, q.TOP, q.BFS
N = "n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)"
SSSP = f"{TOP}, sp(vertex, dist) USING KEY (vertex) AS (SELECT vertex, 0.0::DOUBLE FROM top UNION SELECT x.vertex, x.dist FROM (SELECT e.dst AS vertex, min(sp.dist + e.w) AS dist FROM sp JOIN e ON e.src = sp.vertex GROUP BY e.dst) x LEFT JOIN recurring.sp o ON o.vertex = x.vertex WHERE o.dist IS NULL OR x.dist < o.dist)"
ROOTS = "roots AS (SELECT vertex AS root FROM deg ORDER BY (vertex * 2654435761 + 1701126) & 4294967295, vertex LIMIT 64)"
MULTI_BFS = f"{DEG}, {ROOTS}, r(root, vertex, depth) USING KEY (root, vertex) AS (SELECT root, root, 0 FROM roots UNION SELECT x.root, x.vertex, x.depth FROM (SELECT DISTINCT r.root, e.dst AS vertex, r.depth + 1 AS depth FROM r JOIN e ON e.src = r.vertex) x LEFT JOIN recurring.r o ON o.root = x.root AND o.vertex = x.vertex WHERE o.vertex IS NULL)"
MULTI_SSSP = f"{DEG}, {ROOTS}, r(root, vertex, dist) USING KEY (root, vertex) AS (SELECT root, root, 0.0::DOUBLE FROM roots UNION SELECT x.root, x.vertex, x.dist FROM (SELECT r.root, e.dst AS vertex, min(r.dist + e.w) AS dist FROM r JOIN e ON e.src = r.vertex GROUP BY ALL) x LEFT JOIN recurring.r o ON o.root = x.root AND o.vertex = x.vertex WHERE o.dist IS NULL OR x.dist < o.dist)"
LEVELS = f"{BFS}, lv AS (SELECT depth, count(*) AS size, sum(degree) AS volume FROM l JOIN deg USING (vertex) GROUP BY depth), all_n AS (SELECT count(*) AS n FROM deg), all_m AS (SELECT count(*) AS m FROM e)"


def edges(s, d):
    return q.edges(s, d, None)


def _tree(e):
    return h.bfs_multi(e, q._top(e))


def _dist(e, delta=None):
    return h.sssp_multi(e, q._top(e), delta)


def _around(e):
    """The frontier of depth 1 of the top root and what is visited by then."""
    found = _tree(e).select("vertex", "depth")
    return found.where("depth = 1").select("vertex"), found.where("depth <= 1").select("vertex")


def expand_once(s, d):
    e = edges(s, d)
    front, _ = _around(e)
    return front.withColumnRenamed("vertex", "src").join(e, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))


def unvisited_anti(s, d):
    e = edges(s, d)
    _, seen = _around(e)
    return g.active_vertices(e).join(seen, "vertex", "left_anti")


def bottom_up_once(s, d):
    e = edges(s, d)
    front, seen = _around(e)
    left = e.join(seen.withColumnRenamed("vertex", "dst"), "dst", "left_anti").join(front.withColumnRenamed("vertex", "src"), "src")
    return left.groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))


def relax_once(s, d):
    """From the top root: distances after one relaxation of its neighbours' edges, where they improve."""
    e = edges(s, d)
    now = q._top(e).selectExpr("root src").join(e, "src").selectExpr("dst vertex", "w dist")
    new = now.withColumnRenamed("vertex", "src").join(e, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    return new.join(now.withColumnRenamed("dist", "old"), "vertex", "left").where("old is null or dist < old").select("vertex", "dist")


def frontier_volume(s, d):
    e = edges(s, d)
    return _tree(e).join(g.out_degree(e), "vertex").groupBy("depth").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("volume"))


def traversed_edges(s, d):
    e = edges(s, d)
    return _tree(e).join(g.out_degree(e), "vertex").agg(F.count(F.lit(1)).alias("reached"), F.sum("degree").alias("traversed"))


def bfs_dense(s, d):
    e = edges(s, d)
    return st.dense(s, _tree(e).select("vertex", "depth", "parent"), h.vertices_n(e), "bfs")


def sssp_dense(s, d):
    with g.dealt(edges(s, d), "src", "dst", "w") as e:
        return st.dense(s, _dist(e).select("vertex", "dist"), h.vertices_n(e), "sssp").select("vertex", "dist")


def sssp_buckets(s, d):
    return _dist(edges(s, d)).groupBy(F.floor(F.col("dist") / 0.1).alias("bucket")).agg(F.count(F.lit(1)).alias("vertices"))


def sssp_summary(s, d):
    e = edges(s, d)
    return st.search_summary(e, _dist(e), "dist", h.vertices_n(e))


def bfs_summary(s, d):
    e = edges(s, d)
    return st.search_summary(e, _tree(e), "depth", h.vertices_n(e))


def csr_positions(s, d):
    """Each entry's place in the row-ordered arrays."""
    e = edges(s, d)
    return files.positions(e, h.row_pointers(e, h.vertices_n(e)))


def run_heads(s, d):
    """The first of each run of equal (src, dst) among the uncollapsed entries in order."""
    from pyspark.sql import Window

    raw = g.post_process(q.raw(s, d, None), collapse_duplicates=False)
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("w"))
    return raw.withColumn("nth", nth).where("nth = 1").select("src", "dst", "w")


def postprocess_all(s, d):
    """Number of entries and least weight for each of the eight settings."""
    raw, out = q.raw(s, d, None), []
    for loops in (True, False):
        for both in (True, False):
            for once in (True, False):
                made = g.post_process(raw, loops, both, once).agg(F.count(F.lit(1)).alias("entries"), F.min("w").alias("least"))
                out.append(made.select(F.lit(int(loops)).alias("no_loops"), F.lit(int(both)).alias("symmetric"), F.lit(int(once)).alias("collapsed"), "entries", "least"))
    return h._union(out)


def _damaged_tree(e):
    """The tree with a wrong depth, a missing parent, a parent that is no neighbour and a wrong root: at fixed remainders of ids."""
    return _tree(e).selectExpr(
        "root", "vertex", "case when vertex % 97 = 5 then depth + 1 when vertex = root then 1 else depth end depth",
        "case when vertex % 101 = 7 then null when vertex % 103 = 9 then vertex else parent end parent",
    )


def validate_bfs_damaged(s, d):
    e = edges(s, d)
    return h.validate_bfs(e, _damaged_tree(e)).groupBy("kind", "vertex").agg(F.count(F.lit(1)).alias("errors"))


def _paths(e):
    """Distances of the top root with the least tight predecessor."""
    dist = _dist(e)
    u, v = dist.selectExpr("vertex src", "dist du"), dist.selectExpr("root", "vertex dst", "dist dv")
    tight = e.join(u, "src").join(v, "dst").where("du + w = dv").groupBy("root", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
    return dist.join(tight, ["root", "vertex"], "left").selectExpr("root", "vertex", "dist", "case when vertex = root then root else parent end parent")


def validate_sssp_damaged(s, d):
    e = edges(s, d)
    bad = _paths(e).selectExpr("root", "vertex", "case when vertex % 97 = 5 then dist + 0.5D else dist end dist", "case when vertex % 101 = 7 then null when vertex % 103 = 9 then vertex else parent end parent")
    return h.validate_sssp(e, bad).groupBy("kind", "vertex").agg(F.count(F.lit(1)).alias("errors"))


def _round_trip(form):
    def query(s, d):
        e = g._stored(edges(s, d))
        path = files.scratch_file(s, form)
        files.save(e, h.vertices_n(e), path, form)
        g._delete(s, e.scratch_path)
        return files.load(s, path, form)[0]

    return query


def multi_bfs(s, d):
    with g.dealt(edges(s, d), "src", "dst") as e:
        return h.bfs_depths(e, h.sample_roots(e))


def multi_sssp(s, d):
    with g.dealt(edges(s, d), "src", "dst", "w") as e:
        return h.sssp_multi(e, h.sample_roots(e))


def sssp_searches(s, d):
    with g.dealt(edges(s, d), "src", "dst", "w") as e:
        found = h.sssp_multi(e, h.sample_roots(e), degrees=True)
        return g._stored(h.searches(e, found), found)


def discovery(s, d):
    e = edges(s, d)
    return h.in_discovery_order(e, q._top(e).first()["root"]).select("vertex", "depth")


SCALE = 10
#: Over all of lineitem under the plain names; the thinned graph stays a fixture of ``queries``.
QUERIES = {name: q.QUERIES[f"{name}_whole"] for name in q.WHOLE} | {name: q.QUERIES[name] for name in q.QUERIES if name not in q.WHOLE and not name.endswith("_whole")}
ORACLE = {name: sql.replace(" WHERE l_quantity <= 3", "") for name, sql in q.ORACLE.items() if not name.endswith("_whole")}

QUERIES |= {
    "graph_stats": lambda s, d: st.graph_record(e := edges(s, d), h.vertices_n(e)),
    "binary_stats": lambda s, d: st.binary_report(e := edges(s, d), h.vertices_n(e)),
    "adj_grid": lambda s, d: st.grid(e := edges(s, d), h.vertices_n(e)),
    "initiator_norm": lambda s, d: s.createDataFrame([(i, x) for i, x in enumerate(k.normalize_initiator([57, 19, 19, 5]))], "cell int, p double"),
    "rmat_uniforms": lambda s, d: s.range(16 << SCALE).select("id", F.explode(F.expr(k.uniforms_sql("id", "array(0L, 62L, 63L)", 42))).alias("r")),
    "scramble_bijective": lambda s, d: k.scramble_bijective(s, SCALE),
    "bfs_expand_once": expand_once,
    "unvisited_anti": unvisited_anti,
    "bfs_bottom_up_once": bottom_up_once,
    "relax_once": relax_once,
    "frontier_volume": frontier_volume,
    "traversed_edges": traversed_edges,
    "bfs_dense": bfs_dense,
    "sssp_dense": sssp_dense,
    "bfs_level_bars": lambda s, d: st.level_bars(_tree(edges(s, d))),
    "bfs_summary": bfs_summary,
    "bfs_discovery": discovery,
    "sssp_buckets": sssp_buckets,
    "sssp_delta": lambda s, d: _dist(edges(s, d), 0.1).select("vertex", "dist"),
    "sssp_summary": sssp_summary,
    "sssp_quantiles": lambda s, d: st.quantiles(_dist(edges(s, d)), "dist"),
    "sssp_hist": lambda s, d: st.edge_bins(_dist(edges(s, d)), "dist", 30),
    "sssp_bins": lambda s, d: st.bins_from_zero(_dist(edges(s, d)), "dist"),
    "ascii_hist": lambda s, d: st.histogram_lines(_dist(edges(s, d)), "dist"),
    "csr_positions": csr_positions,
    "csr_expand": lambda s, d: files.expand(files.adjacency(edges(s, d))),
    "run_heads_lag": run_heads,
    "edges_sorted": lambda s, d: q.raw(s, d, None).orderBy("src", "dst", "w"),
    "postprocess_all": postprocess_all,
    "random_root": lambda s, d: h.random_root(s, h.vertices_n(edges(s, d))),
    "teps_expr": lambda s, d: st.with_rate(g.out_degree(edges(s, d)).selectExpr("vertex", "degree traversed", "cast(vertex % 5 as double) / 4 seconds")).select("vertex", "teps"),
    "bfs_multi64": multi_bfs,
    "sssp_multi64": multi_sssp,
    "sssp_searches": sssp_searches,
    "validate_bfs_damaged": validate_bfs_damaged,
    "validate_sssp_damaged": validate_sssp_damaged,
    "npz_roundtrip": _round_trip("npz"),
    "bin_roundtrip": _round_trip("bin"),
    "csr_text": _round_trip("csr"),
    "edgelist_roundtrip": _round_trip("edgelist"),
}

_ALL_E = "SELECT src, dst, w FROM e"
_ROUNDED = "SELECT src, dst, cast(printf('%.6f', w) AS DOUBLE) AS w FROM e"
_RECORD = "(SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS active_vertices, count(*) AS total_edges, count(DISTINCT (src, dst)) AS unique_edges, count(CASE WHEN src = dst THEN 1 END) AS self_loops, count(DISTINCT src) AS active_sources, count(DISTINCT dst) AS unique_targets"
_HIST = "ends AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {t}), wd AS (SELECT lo, (hi - lo) / {n} AS w FROM ends), c AS (SELECT cast(least({n} - 1, floor(({x} - lo) / w)) AS BIGINT) AS bin, count(*) AS n FROM {t}, wd GROUP BY 1)"
_AROUND = f"{BFS}, f AS (SELECT vertex FROM l WHERE depth = 1), v AS (SELECT vertex FROM l WHERE depth <= 1)"
_TREE = f"{BFS}, t AS (SELECT c.vertex, c.depth, coalesce(min(e.src) FILTER (WHERE p.vertex IS NOT NULL), c.vertex) AS parent FROM l c LEFT JOIN e ON e.dst = c.vertex LEFT JOIN l p ON p.vertex = e.src AND p.depth = c.depth - 1 GROUP BY c.vertex, c.depth)"
_SPT = f"{SSSP}, t AS (SELECT c.vertex, c.dist, CASE WHEN c.vertex = (SELECT vertex FROM top) THEN c.vertex ELSE min(e.src) FILTER (WHERE p.dist + e.w = c.dist) END AS parent FROM sp c LEFT JOIN e ON e.dst = c.vertex LEFT JOIN sp p ON p.vertex = e.src GROUP BY c.vertex, c.dist)"
_DAMAGE = "CASE WHEN vertex % 101 = 7 THEN NULL WHEN vertex % 103 = 9 THEN vertex ELSE parent END AS parent"
_POST = " UNION ALL ".join(
    f"SELECT {a} AS no_loops, {b} AS symmetric, {c} AS collapsed, count(*) AS entries, min(w) AS least FROM (SELECT src, dst, {'min(w) AS w' if c else 'w'} FROM (SELECT src, dst, w FROM b{' WHERE src <> dst' if a else ''}{' UNION ALL SELECT dst, src, w FROM b' + (' WHERE src <> dst' if a else '') if b else ''}){' GROUP BY src, dst' if c else ''})"
    for a in (1, 0) for b in (1, 0) for c in (1, 0)
)
ORACLE |= {
    "graph_stats": f"{E}, {N} SELECT any_value(n.n) AS num_vertices, {_RECORD}, count(*) / any_value(n.n * n.n::DOUBLE) AS matrix_density, 1 - count(*) / any_value(n.n * n.n::DOUBLE) AS matrix_sparsity, 100 * (1 - count(*) / any_value(n.n * n.n::DOUBLE)) AS matrix_sparsity_pct, round(count(*) / any_value(n.n), 6) AS avg_degree, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src)) AS max_degree, min(w) AS min_weight, round(avg(w), 6) AS avg_weight, max(w) AS max_weight FROM e, n",
    "binary_stats": f"{E}, {N} SELECT any_value(n.n) AS num_vertices, count(*) AS total_edges, count(DISTINCT src) AS active_sources, round(100.0 * count(DISTINCT src) / any_value(n.n), 6) AS sources_pct, count(DISTINCT dst) AS unique_targets, round(100.0 * count(DISTINCT dst) / any_value(n.n), 6) AS targets_pct, round(count(*) / any_value(n.n), 6) AS avg_degree, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src)) AS max_degree, round(100 * (count(*) / any_value(n.n * n.n::DOUBLE)), 9) AS density_pct, min(w) AS min_weight, round(avg(w), 6) AS avg_weight, max(w) AS max_weight FROM e, n",
    "adj_grid": f"{E}, {N} SELECT src * least(1024, n) // n AS row_bin, dst * least(1024, n) // n AS col_bin, count(*) AS cnt, max(w) AS max_w FROM e, n GROUP BY 1, 2",
    "initiator_norm": "SELECT i AS cell, x / 100.0::DOUBLE AS p FROM (VALUES (0, 57.0::DOUBLE), (1, 19.0::DOUBLE), (2, 19.0::DOUBLE), (3, 5.0::DOUBLE)) t(i, x)",
    "rmat_uniforms": f"SELECT id, r FROM ({q._MIX.format(f'(SELECT id, l FROM range({16 << SCALE}) t(id), (VALUES (0), (62), (63)) v(l))')})",
    "scramble_bijective": f"SELECT id AS vertex, (xor(x, x >> 5) * 2146121005) & {(1 << SCALE) - 1} AS scrambled FROM (SELECT id, (id * 2654435761) & {(1 << SCALE) - 1} AS x FROM range({1 << SCALE}) t(id))",
    "bfs_expand_once": f"{E}, {_AROUND} SELECT dst AS vertex, min(src) AS parent FROM f JOIN e ON src = vertex GROUP BY dst",
    "unvisited_anti": f"{E}, {_AROUND} SELECT vertex FROM deg ANTI JOIN v USING (vertex)",
    "bfs_bottom_up_once": f"{E}, {_AROUND} SELECT dst AS vertex, min(src) AS parent FROM e JOIN f ON f.vertex = src WHERE dst NOT IN (SELECT vertex FROM v) GROUP BY dst",
    "relax_once": f"{E}, {TOP}, o AS (SELECT dst AS vertex, w AS dist FROM e JOIN top ON src = vertex), x AS (SELECT dst AS vertex, min(dist + w) AS dist FROM o JOIN e ON src = vertex GROUP BY dst) SELECT x.vertex, x.dist FROM x LEFT JOIN o USING (vertex) WHERE o.dist IS NULL OR x.dist < o.dist",
    "frontier_volume": f"{E}, {LEVELS} SELECT depth, size, cast(volume AS BIGINT) AS volume FROM lv",
    "traversed_edges": f"{E}, {BFS} SELECT count(*) AS reached, cast(sum(degree) AS BIGINT) AS traversed FROM l JOIN deg USING (vertex)",
    "bfs_dense": f"{E}, {_TREE}, {N} SELECT i AS vertex, coalesce(depth, -1) AS depth, coalesce(parent, -1) AS parent FROM (SELECT unnest(range(n)) AS i FROM n) LEFT JOIN t ON t.vertex = i",
    "sssp_dense": f"{E}, {SSSP}, {N} SELECT i AS vertex, coalesce(dist, 'infinity'::DOUBLE) AS dist FROM (SELECT unnest(range(n)) AS i FROM n) LEFT JOIN sp ON sp.vertex = i",
    "bfs_level_bars": f"{E}, {BFS}, z AS (SELECT depth, count(*) AS n FROM l GROUP BY depth) SELECT depth, n AS frontier_size, coalesce(lead(n) OVER (ORDER BY depth), 0) AS next_frontier_size, cast(sum(n) OVER (ORDER BY depth) AS BIGINT) AS discovered, repeat('#', cast(least(40, floor(n / sum(n) OVER () * 40)) AS INT)) AS bar FROM z",
    "bfs_summary": f"{E}, {BFS}, {N} SELECT count(*) AS reached, round(100.0 * count(*) / any_value(n.n), 6) AS coverage_pct, cast(sum(degree) AS BIGINT) AS traversed, cast(max(depth) AS DOUBLE) AS greatest, round(avg(depth), 6) AS mean, cast(min(CASE WHEN depth > 0 THEN depth END) AS DOUBLE) AS least_positive FROM n, l JOIN deg USING (vertex)",
    "bfs_discovery": f"{E}, {BFS} SELECT vertex, depth FROM l",
    "sssp_dist": f"{E}, {SSSP} SELECT vertex, dist FROM sp",
    "sssp_delta": f"{E}, {SSSP} SELECT vertex, dist FROM sp",
    "sssp_buckets": f"{E}, {SSSP} SELECT cast(floor(dist / 0.1::DOUBLE) AS BIGINT) AS bucket, count(*) AS vertices FROM sp GROUP BY 1",
    "sssp_summary": f"{E}, {SSSP}, {N} SELECT count(*) AS reached, round(100.0 * count(*) / any_value(n.n), 6) AS coverage_pct, cast(sum(degree) AS BIGINT) AS traversed, max(dist) AS greatest, round(avg(dist), 6) AS mean, min(CASE WHEN dist > 0 THEN dist END) AS least_positive FROM n, sp JOIN deg USING (vertex)",
    "sssp_quantiles": f"{E}, {SSSP} SELECT x AS q, round(v, 9) AS value FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x, unnest(quantile_cont(dist, [0.0, 0.25, 0.5, 0.75, 1.0])) AS v FROM sp)",
    "sssp_hist": f"{E}, {SSSP}, {_HIST.format(x='dist', t='sp', n=30)} SELECT i AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS count FROM wd, range(30) r(i) LEFT JOIN c ON bin = i",
    "sssp_bins": f"{E}, {SSSP}, m AS (SELECT max(dist) / 10 AS w FROM sp), c AS (SELECT cast(least(9, floor(dist / w)) AS BIGINT) AS bin, count(*) AS n FROM sp, m GROUP BY 1) SELECT i AS bin, coalesce(n, 0) AS count FROM range(10) r(i) LEFT JOIN c ON bin = i",
    "ascii_hist": f"{E}, {SSSP}, {_HIST.format(x='dist', t='sp', n=10)}, z AS (SELECT i AS bin, lo + i * w AS low, lo + (i + 1) * w AS high, coalesce(n, 0) AS n FROM wd, range(10) r(i) LEFT JOIN c ON bin = i) SELECT bin, concat(printf('[%.4f - %.4f] : %d vertices  ', low, high, n), repeat('#', cast(least(40, floor(n / max(n) OVER () * 40)) AS INT))) AS line FROM z",
    "csr_positions": f"{E} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst, w FROM e",
    "csr_expand": f"{E} {_ALL_E}",
    "run_heads_lag": f"WITH {RAW} SELECT src, dst, w FROM (SELECT src, dst, w, lag(src) OVER o AS a, lag(dst) OVER o AS c FROM s WINDOW o AS (ORDER BY src, dst, w)) WHERE a IS NULL OR a <> src OR c <> dst",
    "edges_sorted": f"WITH {RAW} SELECT src, dst, w FROM b",
    "postprocess_all": f"WITH {RAW} {_POST}",
    "random_root": f"{E}, {N} SELECT i AS root FROM (SELECT unnest(range(n)) AS i FROM n) ORDER BY (i * -1640531535 + 1701126) & 4294967295, i LIMIT 1",
    "teps_expr": f"{E}, {DEG} SELECT vertex, CASE WHEN vertex % 5 > 0 THEN degree / ((vertex % 5) / 4.0::DOUBLE) ELSE 0.0::DOUBLE END AS teps FROM deg",
    "bfs_multi64": f"{E}, {MULTI_BFS} SELECT root, vertex, depth FROM r",
    "sssp_multi64": f"{E}, {MULTI_SSSP} SELECT root, vertex, dist FROM r",
    "bench_searches": f"{E}, {MULTI_BFS} SELECT root, any_value(o.degree) AS degree, count(*) AS reached, cast(sum(deg.degree) AS BIGINT) AS traversed FROM r JOIN deg ON deg.vertex = r.vertex JOIN deg o ON o.vertex = root GROUP BY root",
    "sssp_searches": f"{E}, {MULTI_SSSP} SELECT root, any_value(o.degree) AS degree, count(*) AS reached, cast(sum(deg.degree) AS BIGINT) AS traversed FROM r JOIN deg ON deg.vertex = r.vertex JOIN deg o ON o.vertex = root GROUP BY root",
    "bfs_directions": f"{E}, {LEVELS}, u(level, up) AS (SELECT 0, cast(volume > m / 14 AS INT) FROM lv, all_m WHERE depth = 0 UNION ALL SELECT lv.depth, CASE WHEN up = 1 THEN cast(size >= n / 24 AS INT) ELSE cast(volume > m / 14 AS INT) END FROM u JOIN lv ON lv.depth = level + 1, all_m, all_n) SELECT level, size, cast(volume AS BIGINT) AS volume, up AS bottom_up FROM u JOIN lv ON depth = level",
    "degree_bins": f"{E}, {DEG}, {_HIST.format(x='degree', t='deg', n=5)} SELECT i AS bin, coalesce(n, 0) AS count FROM range(5) r(i) LEFT JOIN c ON bin = i",
    "csr_indptr": f"{E}, {DEG}, {N}, i AS (SELECT unnest(range(n + 1)) AS id FROM n) SELECT id AS vertex, cast(coalesce(sum(coalesce(degree, 0)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM i LEFT JOIN deg ON vertex = id",
    "teps_stats": q.ORACLE["teps_stats"].replace(" WHERE l_quantity <= 3", "").replace(" WHERE vertex < 200", ""),
    "validate_bfs_damaged": f"""{E}, {_TREE}, x AS (SELECT vertex, CASE WHEN vertex % 97 = 5 THEN depth + 1 WHEN vertex = (SELECT vertex FROM top) THEN 1 ELSE depth END AS depth, {_DAMAGE} FROM t), y AS (
SELECT 'root' AS kind, vertex FROM x WHERE vertex = (SELECT vertex FROM top) AND (parent IS NULL OR parent <> vertex OR depth <> 0)
UNION ALL SELECT 'no parent', vertex FROM x WHERE vertex <> (SELECT vertex FROM top) AND parent IS NULL
UNION ALL SELECT 'no such edge', vertex FROM x WHERE vertex <> (SELECT vertex FROM top) AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.parent AND e.dst = x.vertex)
UNION ALL SELECT 'depth', x.vertex FROM x LEFT JOIN x p ON p.vertex = x.parent WHERE x.vertex <> (SELECT vertex FROM top) AND x.parent IS NOT NULL AND (p.vertex IS NULL OR x.depth <> p.depth + 1)) SELECT kind, vertex, count(*) AS errors FROM y GROUP BY ALL""",
    "validate_sssp_damaged": f"""{E}, {_SPT}, x AS (SELECT vertex, CASE WHEN vertex % 97 = 5 THEN dist + 0.5 ELSE dist END AS dist, {_DAMAGE} FROM t), y AS (
SELECT 'root' AS kind, vertex FROM x WHERE vertex = (SELECT vertex FROM top) AND (parent IS NULL OR parent <> vertex OR abs(dist) > 1e-9)
UNION ALL SELECT 'no parent', vertex FROM x WHERE vertex <> (SELECT vertex FROM top) AND parent IS NULL
UNION ALL SELECT 'no such edge', vertex FROM x WHERE vertex <> (SELECT vertex FROM top) AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.parent AND e.dst = x.vertex)
UNION ALL SELECT 'distance', x.vertex FROM x LEFT JOIN e ON e.src = x.parent AND e.dst = x.vertex LEFT JOIN x p ON p.vertex = x.parent WHERE x.vertex <> (SELECT vertex FROM top) AND x.parent IS NOT NULL AND (p.vertex IS NULL OR abs(x.dist - (p.dist + e.w)) > 1e-7)
UNION ALL SELECT 'triangle', e.dst FROM e JOIN x u ON u.vertex = e.src LEFT JOIN x v ON v.vertex = e.dst WHERE v.vertex IS NULL OR v.dist > u.dist + e.w + 1e-7) SELECT kind, vertex, count(*) AS errors FROM y GROUP BY ALL""",
    "npz_roundtrip": f"{E} {_ALL_E}",
    "bin_roundtrip": f"{E} {_ALL_E}",
    "csr_text": f"{E} {_ROUNDED}",
    "edgelist_roundtrip": f"{E} {_ROUNDED}",
}
