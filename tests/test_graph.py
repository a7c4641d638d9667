import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
from edgeloom.operators import graph as g
from edgeloom.plans.queries import QUERIES


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_levels_of_the_derived_graph(spark):
    rows = sorted(tuple(r) for r in QUERIES["bfs_levels"](spark, "/root/testdata/sf0.001").collect())
    assert len(rows) == 16 and sum(n for _, n in rows) == 303


def test_heavy_edges_are_relaxed(spark):
    e = g.post_process(spark.createDataFrame([(0, 1, 0.05), (0, 2, 0.5)], "src long, dst long, w double"))
    assert {r["vertex"]: r["dist"] for r in g.sssp(e, 0).collect()} == {0: 0.0, 1: 0.05, 2: 0.5}


def test_scramble_merges_no_vertices(spark):
    from edgeloom.operators.generate import scramble_bijective

    for scale in (1, 4, 10):
        assert scramble_bijective(spark, scale).select("scrambled").distinct().count() == 1 << scale


def test_distances_of_the_derived_graph(spark):
    dist = [r["dist"] for r in QUERIES["sssp_dist"](spark, "/root/testdata/sf0.001").collect()]
    assert len(dist) == 303 and round(max(dist), 6) == 1.128 and round(sum(dist) / 303, 6) == 0.416089


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    """(src, dst) -> least weight over all lines, by plain loops."""
    import pyarrow.parquet as pq

    customer = {r["o_orderkey"]: r["o_custkey"] for r in pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()}
    out = {}
    for r in pq.read_table(f"{SF}/lineitem.parquet").to_pylist():
        if r["l_orderkey"] in customer:
            a, b, w = 2 * customer[r["l_orderkey"]], 2 * r["l_partkey"] + 1, r["l_discount"] + r["l_tax"] + r["l_quantity"] / 1000
            for edge in ((a, b), (b, a)):
                out[edge] = min(w, out.get(edge, w))
    return out


def test_edges_and_row_pointers_of_all_lines(spark, whole):
    got = {(r["src"], r["dst"]): r["w"] for r in QUERIES["collapse_min_whole"](spark, SF).collect()}
    assert got == whole and len(got) > 3 * QUERIES["collapse_min"](spark, SF).count()
    last = QUERIES["csr_indptr_whole"](spark, SF).orderBy("vertex").collect()[-1]
    assert tuple(last) == (max(a for a, _ in whole) + 1, len(whole))


def test_searches_over_all_lines(spark, whole):
    import heapq
    from collections import Counter

    degree = Counter(a for a, _ in whole)
    root = min(degree, key=lambda v: (-degree[v], v))
    out = {v: [] for v in degree}
    for (a, b), w in whole.items():
        out[a].append((b, w))
    dist, depth, heap = {}, {root: 0}, [(0.0, root)]
    while heap:
        x, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = x
            for b, w in out[v]:
                heapq.heappush(heap, (x + w, b))
    queue = [root]
    for v in queue:
        for b, _ in out[v]:
            if b not in depth:
                depth[b] = depth[v] + 1
                queue.append(b)
    assert dict(Counter(depth.values())) == {r["depth"]: r["frontier_size"] for r in QUERIES["bfs_levels_whole"](spark, SF).collect()}
    assert {r["vertex"]: r["dist"] for r in QUERIES["sssp_dist_whole"](spark, SF).collect()} == pytest.approx(dist)


@pytest.mark.parametrize("name", ["graph_stats", "top_degree_root", "out_degree", "degree_histogram", "bfs_levels"])
def test_sql_over_all_lines(spark, name):
    import duckdb
    from edgeloom.plans.queries import ORACLE

    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(ORACLE[f"{name}_whole"]).fetchall()
    assert sorted(map(tuple, QUERIES[f"{name}_whole"](spark, SF).collect())) == sorted(want)
