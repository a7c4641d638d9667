"""The registered graph queries against DuckDB, statistics on small fixtures, files and the command line."""

import numpy as np
import pytest
from edgeloom import cli
from edgeloom.operators import generate, search, stats
from edgeloom.operators import graph as g
from edgeloom.plans.reports import ORACLE, QUERIES
from edgeloom.sources import files
from test_graph import spark  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["graph_stats", "binary_stats", "adj_grid", "relax_once", "csr_positions", "csr_expand", "run_heads_lag", "postprocess_all", "random_root", "teps_expr", "bfs_expand_once",
         "bfs_bottom_up_once", "bfs_level_bars", "bfs_directions", "sssp_quantiles", "ascii_hist", "validate_bfs_damaged", "validate_sssp_damaged", "npz_roundtrip", "bin_roundtrip", "csr_text", "bench_searches"]


def rows_of(frame, columns):
    plain = lambda v: "None" if v is None or v != v else v if isinstance(v, str) else round(float(v), 9)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):  # noqa: F811
    import duckdb

    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(ORACLE[name]).fetch_df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(want.columns)) == rows_of(want, sorted(want.columns)) and len(want)


def frame(spark, rows):  # noqa: F811
    return spark.createDataFrame(rows, "src long, dst long, w double")


def test_records(spark):  # noqa: F811
    e = frame(spark, [(0, 1, 0.2), (1, 0, 0.2), (2, 0, 0.6), (0, 2, 0.6)])
    r = stats.graph_record(e, 4).first()
    assert (r["total_edges"], r["matrix_density"], r["matrix_sparsity"], r["matrix_sparsity_pct"], r["max_degree"]) == (4, 0.25, 0.75, 75.0, 2)
    r = stats.graph_record(frame(spark, []), 4).first().asDict()
    assert r["matrix_sparsity"] == 1 and not any(v for k, v in r.items() if not k.startswith("matrix_spars") and k != "num_vertices")
    loops = stats.graph_record(frame(spark, [(1, 1, 0.5), (1, 1, 0.25), (1, 2, 1.0)]), 3).first()
    assert (loops["total_edges"], loops["unique_edges"], loops["self_loops"], loops["active_vertices"], loops["unique_targets"]) == (3, 2, 2, 2, 2)


def test_bins_and_quantiles(spark):  # noqa: F811
    d = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.6,)], "d double")
    assert [r["count"] for r in stats.edge_bins(d, "d", 10).orderBy("bin").collect()] == [1, 0, 0, 1, 0, 0, 0, 0, 1, 1]
    assert [r["count"] for r in stats.bins_from_zero(d, "d").orderBy("bin").collect()] == [1, 0, 0, 1, 0, 0, 0, 0, 1, 1]
    assert [r["value"] for r in stats.quantiles(d, "d").orderBy("q").collect()] == [0.0, 0.15, 0.35, 0.525, 0.6]
    for empty in (stats.edge_bins, stats.bins_from_zero, stats.histogram_lines):
        assert empty(d.limit(0), "d").count() == 0
    assert stats.quantiles(d.limit(0), "d").count() == 0


def test_dense_and_discovery(spark):  # noqa: F811
    e = frame(spark, [(0, 1, 1.0), (0, 3, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 0, 1.0)])
    found = search.in_discovery_order(e, 0)
    assert [tuple(r) for r in found.select("vertex", "depth", "parent").orderBy("vertex").collect()] == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 1, 0)]
    assert stats.dense(spark, found, 5, "bfs").where("vertex = 4").select("depth", "parent").first() == (-1, -1)
    paths = search.sssp_multi(e, spark.createDataFrame([(0,)], "root long")).select("vertex", "dist")
    assert stats.dense(spark, paths, 5, "sssp").where("vertex = 4").first()["dist"] == float("inf")


def test_rounds_of_shortest_paths(spark):  # noqa: F811
    e = g.post_process(frame(spark, [(0, 1, 0.05), (0, 2, 0.5)]))
    for delta in (0.01, 0.1, 1.0, 10.0):
        log = []
        found = search.sssp_multi(e, spark.createDataFrame([(0,)], "root long"), delta, log)
        assert {r["vertex"]: r["dist"] for r in found.collect()} == {0: 0.0, 1: 0.05, 2: 0.5}
        assert [b for b, _ in log] == sorted(b for b, _ in log) and {k for _, k in log} == {"light", "heavy"}


def test_ids_beyond_32_bits(spark):  # noqa: F811
    big = 1 << 40
    e = g.post_process(frame(spark, [(big, big + 1, 0.5), (big + 1, big + 7, 0.25)]))
    assert search.sample_roots(e).count() == 3
    found = search.bfs_multi(e, spark.createDataFrame([(big,), (big + 7,)], "root long"))
    assert sorted((r["root"] - big, r["vertex"] - big, r["depth"]) for r in found.collect()) == [(0, 0, 0), (0, 1, 1), (0, 7, 2), (7, 0, 2), (7, 1, 1), (7, 7, 0)]
    ids = spark.createDataFrame([((1 << 44) + 3 * i,) for i in range(2000)], "id long")
    assert ids.selectExpr(generate.bijective_sql("id", 45) + " x").distinct().count() == 2000
    assert ids.selectExpr(generate.compatible_sql("id", 45) + " x").where("x >= 0").count() == 2000


def test_directed_and_many_roots_from_the_unvisited_side(spark):  # noqa: F811
    e = frame(spark, [(0, 1, 1.0), (2, 0, 1.0), (1, 3, 1.0), (3, 4, 1.0)])
    roots = spark.createDataFrame([(0,), (2,), (3,)], "root long")
    want = {(0, 0, 0), (0, 1, 1), (0, 3, 2), (0, 4, 3), (2, 2, 0), (2, 0, 1), (2, 1, 2), (2, 3, 3), (2, 4, 4), (3, 3, 0), (3, 4, 1)}
    for alpha in (1e-9, 1e9):  # never and always from the unvisited side
        log = []
        got = search.bfs_multi(e, roots, alpha, 1e9, log)
        assert {(r["root"], r["vertex"], r["depth"]) for r in got.collect()} == want
    assert any(x[3] for x in log)


def test_no_file_after_a_failure(spark, tmp_path):  # noqa: F811
    e = frame(spark, [(0, 1, 1.0), (5, 0, 1.0)])
    for write in (files.write_binary, files.write_npz, files.write_csr_text):
        with pytest.raises(ValueError):
            write(e, 3, str(tmp_path / "out"))
    broken = e.selectExpr("src", "dst", "cast(raise_error('no') as double) w")
    with pytest.raises(Exception):  # noqa: B017
        files.write_binary(broken, 6, str(tmp_path / "out"))
    assert not [p for p in tmp_path.iterdir() if p.name == "out" or p.name.startswith("out.")]


def test_magic_and_pointers_are_checked(spark, tmp_path):  # noqa: F811
    path = str(tmp_path / "g.bin")
    files.write_binary(frame(spark, [(0, 1, 1.0), (1, 0, 0.5)]), 2, path, magic=b"OTHERONE")
    with pytest.raises(ValueError):
        files.read_header(path)
    assert files.read_binary(spark, path, magic=b"OTHERONE").count() == 2
    raw = bytearray(open(path, "rb").read())
    raw[40 + 16] = 9
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        files.read_header(path, b"OTHERONE")


def test_compressed_npz(spark, tmp_path):  # noqa: F811
    path = str(tmp_path / "g.npz")
    np.savez_compressed(path, indptr=np.array([0, 1, 1]), indices=np.array([1]))
    got, n = files.read_npz(spark, path)
    assert n == 2 and [tuple(r) for r in got.collect()] == [(0, 1, 1.0)]


@pytest.mark.parametrize("form", ["bin", "csr", "npz", "edgelist"])
def test_command_line(spark, tmp_path, form):  # noqa: F811
    out, said = str(tmp_path / f"g.{form}"), []
    cli.main(["generate", "-s", "6", "-ef", "4", "--seed", "5", "--format", form, "-o", out, "--stats"], spark, said.append)
    assert any(x.startswith("max_degree") for x in said)
    said.clear()
    if form == "bin":
        cli.main(["bfs", "-i", out, "--source", "-1", "--validate", "--stats"], spark, said.append)
        assert "valid" in said and any(x.startswith("depth 1") for x in said)
        cli.main(["plot", "-i", out, "-o", str(tmp_path / "squares"), "--stats"], spark, said.append)
        assert spark.read.parquet(str(tmp_path / "squares")).agg({"cnt": "sum"}).first()[0] == files.read_header(out)[1]
        with pytest.raises(ValueError):
            cli.main(["bfs", "-i", out, "--root", "64"], spark, said.append)
    elif form == "npz":
        cli.main(["sssp", "-i", out, "--root", "-1", "--validate", "--stats"], spark, said.append)
        assert "valid" in said and any(x.startswith("quantile") for x in said)
    elif form == "csr":
        cli.main(["bfs", "-i", out, "--bench", "--searches", "2"], spark, said.append)
        assert "searches: 2" in said and any(x.startswith("harmonic") for x in said)
