import numpy as np
import pytest
from edgeloom.operators import generate, search
from edgeloom.operators import graph as g
from edgeloom.plans.queries import QUERIES
from edgeloom.plans.queries import edges as derived
from edgeloom.sources import files
from test_graph import spark  # noqa: F401

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def root(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root long")


CHAIN = [(0, 1, 0.2), (0, 2, 0.8), (1, 2, 0.3), (2, 3, 0.1)]


def test_generated_graph_of_scale_8(spark):
    e = g.post_process(generate.stochastic(spark, 8)).persist()
    assert (e.count(), g.active_vertices(e).count()) == (4286, 236)
    assert tuple(g.top_degree_root(e).first()) == (0, 155)
    levels = {r["depth"]: r["count"] for r in g.bfs(e, 0).groupBy("depth").count().collect()}
    assert levels == {0: 1, 1: 155, 2: 80}
    assert round(max(r["dist"] for r in g.sssp(e, 0).collect()), 6) == 0.975579


def test_directions_of_the_derived_graph(spark):
    log = []
    found = search.bfs_multi(derived(spark, SF), root(spark, 598), log=log)
    assert [x[1] for x in log] == [1, 10, 25, 66, 98, 223, 323, 582, 495, 522, 218, 132, 44, 19, 5, 2, 1]
    assert [x[3] for x in log] == [0] * 5 + [1] * 7 + [0] * 5
    assert search.validate_bfs(derived(spark, SF), found, strict=True).count() == 0


@pytest.mark.parametrize("delta", [None, 0.01, 0.1, 10.0])
def test_shortest_paths_whatever_the_bucket(spark, delta):
    e = frame(spark, CHAIN)
    got = search.with_parents(e, search.sssp_multi(e, root(spark, 0), delta))
    assert [(r["vertex"], round(r["dist"], 9), r["parent"]) for r in got.orderBy("vertex").collect()] == [(0, 0, 0), (1, 0.2, 0), (2, 0.5, 1), (3, 0.6, 2)]
    assert search.validate_sssp(e, got).count() == 0
    bad = got.selectExpr("root", "vertex", "case when vertex = 3 then 0.7D else dist end dist", "parent")
    assert {r["kind"] for r in search.validate_sssp(e, bad).collect()} == {"distance", "triangle"}


def test_zero_weights_make_no_parent_cycle(spark):
    e = g.post_process(frame(spark, [(0, 1, 0.1), (1, 2, 0.0), (2, 3, 0.0)]))
    got = search.with_parents(e, search.sssp_multi(e, root(spark, 0), 0.1)).orderBy("vertex").collect()
    assert [(r["dist"], r["parent"]) for r in got] == [(0.0, 0), (0.1, 0), (0.1, 1), (0.1, 2)]


def test_wrong_parents_are_found(spark):
    e = g.post_process(frame(spark, [(0, 1, 1.0), (0, 3, 1.0), (1, 2, 1.0)]))
    found = search.bfs_multi(e, root(spark, 0))
    bad = found.selectExpr("root", "vertex", "depth", "case when vertex = 2 then 0 else parent end parent")
    assert search.validate_bfs(e, found).count() == 0 and search.validate_bfs(e, bad).count() >= 1


def test_statistics(spark):
    r = search.rate_stats(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 0, 10)], "teps double")).first()
    assert tuple(r) == (0, 1, 2.5, 3, 10, 3.333333, 3.248931, 2.748092)
    d = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.6,)], "d double")
    assert [x["count"] for x in search.histogram(d, "d", 5).orderBy("bin").collect()] == [1, 1, 0, 0, 2]
    assert sorted(x["bin"] for x in search.histogram(d.where("d = 0"), "d", 10).where("count > 0").collect()) == [5]


def test_compatible_scramble_and_probabilities(spark):
    for scale, image in ((4, 9), (10, 708)):
        assert spark.range(1 << scale).selectExpr(generate.compatible_sql("id", scale) + " x").distinct().count() == image
    assert generate.cell_probabilities(spark, 4).selectExpr("round(sum(p), 9)").first()[0] == 1.0
    with pytest.raises(ValueError):
        generate.normalize_initiator([0, 0, 0, 0])


@pytest.mark.parametrize("weighted", [True, False])
def test_files(spark, tmp_path, weighted):
    e = frame(spark, CHAIN if weighted else [(a, b, 1.0) for a, b, _ in CHAIN])
    want = sorted(map(tuple, e.collect()))
    assert [r["indptr"] for r in search.row_pointers(e, 4, 2).orderBy("vertex").collect()] == [0, 2, 3, 4, 4]
    path = str(tmp_path / "g.bin")
    files.write_binary(e, 4, path, weighted)
    assert sorted(map(tuple, files.read_binary(spark, path, 2).collect())) == want
    with open(path, "r+b") as f:
        f.truncate(60)
    with pytest.raises(ValueError):
        files.read_binary(spark, path)
    files.write_csr_text(e, 4, str(tmp_path / "g.csr"), weighted)
    assert sorted(map(tuple, files.read_csr_text(spark, str(tmp_path / "g.csr"))[0].collect())) == want
    files.write_npz(e, 4, str(tmp_path / "g.npz"))
    got, n = files.read_npz(spark, str(tmp_path / "g.npz"))
    assert n == 4 and sorted(map(tuple, got.collect())) == want
    files.write_edge_list(e, str(tmp_path / "edges"), weighted)
    assert sorted(map(tuple, files.read_edge_list(spark, str(tmp_path / "edges")).collect())) == want
    assert np.load(str(tmp_path / "g.npz"))["indptr"].tolist() == [0, 2, 3, 4, 4]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_row_pointers_reach_the_greatest_id(spark, sf):
    e = derived(spark, sf)
    src = np.array([r["src"] for r in e.select("src").collect()])
    degree = np.bincount(src)
    got = [tuple(r) for r in QUERIES["csr_indptr"](spark, sf).orderBy("vertex").collect()]
    assert got == list(enumerate(np.concatenate([[0], np.cumsum(degree)]).tolist()))
    assert got[-1][1] == len(src)


def test_no_edges_have_one_row_pointer(spark):
    e = frame(spark, [])
    assert [tuple(r) for r in search.row_pointers(e, search.vertices_n(e)).collect()] == [(0, 0)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_rate_statistics_take_every_vertex(spark, sf):
    x = np.sort([r["degree"] for r in g.out_degree(derived(spark, sf)).collect()]).astype(float)
    q1, q3 = (x[int(p * (len(x) - 1))] for p in (0.25, 0.75))
    want = (x[0], q1, np.median(x), q3, x[-1], x.mean(), x.std(), len(x) / (1 / x).sum())
    assert tuple(QUERIES["teps_stats"](spark, sf).first()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 5001])
def test_ranks_over_many_ranges(spark, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=n - n // 3), np.full(n // 3, 0.25)])
    rates = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "teps double").repartition(7)
    got, x = search.rate_stats(rates).first(), np.sort(x)
    assert (got["q1"], got["q3"]) == tuple(x[int(p * (n - 1))] for p in (0.25, 0.75)) and got["median"] == pytest.approx(np.median(x), abs=1e-15)


def test_ranks_gather_no_list(spark, capsys):
    search.rate_stats(spark.range(100).selectExpr("cast(id as double) teps")).explain()
    plan = capsys.readouterr().out
    assert "collect_list" not in plan and "percentile" not in plan and "median(" not in plan


def test_searches_in_words_of_64(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 150, (220, 2))] + [(1000 + i, 1001 + i) for i in range(19)]
    out = {}
    for a, b in pairs + [(b, a) for a, b in pairs]:
        if a != b:
            out.setdefault(a, set()).add(b)
    want, sums = set(), set()
    for root in out:  # more than two words; the chain has more levels than stay apart
        depth = {root: 0}
        queue = [root]
        for v in queue:
            for b in out[v] - depth.keys():
                depth[b] = depth[v] + 1
                queue.append(b)
        want |= {(root, v, d) for v, d in depth.items()}
        sums.add((root, len(out[root]), len(depth), sum(len(out[v]) for v in depth)))
    e = g.post_process(frame(spark, [(a, b, 1.0) for a, b in pairs]))
    roots = spark.createDataFrame([(v,) for v in out], "root long")
    assert len(out) > 128 and max(d for _, _, d in want) > search.COMPACT
    assert sorted(map(tuple, search.bfs_depths(e, roots).collect())) == sorted(want)
    assert set(map(tuple, search.bfs_searches(e, roots).collect())) == sums
    assert search.bfs_depths(e, roots.limit(0)).count() == 0


def test_levels_of_a_word_share_an_exchange(spark):
    e = g.post_process(generate.stochastic(spark, 8))
    roots = search.sample_roots(e)
    found, _ = search.bfs_words(e, roots)
    assert found.count() < search.bfs_multi(e, roots).count() / 8  # a row stands for all searches that arrive together


def test_dealt_edges_are_not_exchanged(spark, capsys):
    with g.dealt(frame(spark, CHAIN), "src", "dst") as e:
        g.out_degree(e).explain()
        assert "Exchange" not in capsys.readouterr().out and g.out_degree(e).count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edgeloom_")]


def test_rounds_of_many_shortest_paths_leave_one_table(spark, tmp_path, monkeypatch):
    import heapq

    monkeypatch.setattr(g, "_folder", lambda _: str(tmp_path))
    rng = np.random.default_rng(5)
    e = g.post_process(frame(spark, [(int(a), int(b), round(float(w), 2)) for a, b, w in zip(*rng.integers(0, 60, (2, 150)), rng.random(150), strict=True)]))
    out, want = {}, {}
    for r in e.collect():
        out.setdefault(r["src"], []).append((r["dst"], r["w"]))
    for source in list(out)[:9]:
        heap = [(0.0, source)]
        while heap:
            x, v = heapq.heappop(heap)
            if (source, v) not in want:
                want[source, v] = x
                for b, w in out[v]:
                    heapq.heappush(heap, (x + w, b))
    got = search.sssp_multi(e, root(spark, *list(out)[:9], list(out)[0]))
    assert {(r["root"], r["vertex"]): r["dist"] for r in got.collect()} == want and got.count() == len(want)
    assert len(list(tmp_path.iterdir())) == 1  # neither the rounds' states nor the edges


@pytest.mark.parametrize("weighted", [True, False])
def test_text_rows_are_read_in_parts(spark, tmp_path, weighted, monkeypatch):
    rng = np.random.default_rng(7)
    e = g.post_process(frame(spark, [(int(a), int(b), 0.25) for a, b in rng.integers(0, 300, (400, 2))]))
    want = sorted((r["src"], r["dst"], 0.25 if weighted else 1.0) for r in e.collect())
    path = str(tmp_path / "g.csr")
    files.write_csr_text(e, 303, path, weighted)
    monkeypatch.setattr(files, "_frame", None)  # no array in the driver
    for part in (1, 7, 64, 1 << 20):
        got, n = files.read_csr_text(spark, path, 50, part)
        assert n == 303 and sorted(map(tuple, got.collect())) == want
    lines = open(path).read().split("\n")
    lines[2] = lines[2].rsplit(" ", 1)[0]
    open(path, "w").write("\n".join(lines))
    with pytest.raises(ValueError):
        files.read_csr_text(spark, path)


def test_paths_are_relaxed_in_files_without_an_exchange(spark, tmp_path, monkeypatch):
    import heapq

    from edgeloom.operators import paths

    monkeypatch.setattr(g, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(paths, "EDGES", 300)
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 90, (2, 500)), rng.random(500), strict=True) if a != b]
    e = frame(spark, [*pairs, *((200 + i, 3, 0.1 * i) for i in range(20)), (300, 301, 0.5)]).groupBy("src", "dst").agg({"w": "min"}).withColumnRenamed("min(w)", "w")  # directed: 200 and 300 are entered by no edge
    out, want = {}, {}
    for r in e.collect():
        out.setdefault(r["src"], []).append((r["dst"], r["w"]))
    sources = [200, 300, 301, 999, *(v for v in range(70))]  # more than one word; 999 has no edge
    for source in sources:
        heap = [(0.0, source)]
        while heap:
            x, v = heapq.heappop(heap)
            if (source, v) not in want:
                want[source, v] = x
                for b, w in out.get(v, ()):
                    heapq.heappush(heap, (x + w, b))
    got = search.sssp_multi(e, root(spark, *sources), degrees=True).collect()
    assert {(r["root"], r["vertex"]): r["dist"] for r in got} == want and len(got) == len(want)
    assert all(r["degree"] == len(out.get(r["vertex"], ())) for r in got)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["paths"]
