"""Golden values, properties against plain Python, and invalid input."""

import random
from itertools import accumulate, combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.operators import charts, clean, density, exact, peel, stats, verify
from bramble.plans import api, cli, config
from bramble.sources import generators, graph

# A, B, C, R, X by k
GOLDEN = {
    "K4": ("3333", "0012", "3333", "0333", "3333"),
    "star5": ("222222", "001111", "111111", "022222", "222222"),
    "petersen": ("3333333333", "0011122222", "3333333333", "0333333333", "3333333333"),
    "circulant6": ("444444", "001223", "444444", "044444", "444444"),
    "cubical": ("33333333", "00112222", "33333333", "03333333", "33333333"),
    "grid3x3": ("333333333", "001122222", "222222222", "033333333", "333333333"),
    "C8_chords": ("33333333", "00111222", "22222222", "03333333", "33333333"),
    "two_edges": ("1111", "0011", "1111", "0111", "1111"),
    "single": ("0", "0", "0", "0", "0"),
    "lollipop": ("4444444443", "0012344444", "4444411111", "0444444444", "4444444443"),
    "two_dense": ("44444444444", "00123444444", "44444333311", "04444444444", "44444444444"),
    "k4_isolated": ("3333322", "0012333", "3333000", "0333332", "3333322"),
    "bound_break": ("4444444", "0012333", "3333321", "0444444", "4444444"),
    "tie_a": ("3333333", "0011222", "2222211", "0333333", "3333333"),
    "tie_b": ("3333333", "0012222", "2222211", "0333333", "3333333"),
    "atie_a": ("333332222", "001222222", "222211100", "033333222", "333332222"),
    "atie_b": ("333322222", "001222222", "222211100", "033332222", "333332222"),
}
TRACES = {
    "C6_chords": [(1, 6, 8, 2, 2), (2, 5, 6, 1, 2), (3, 4, 4, 0, 2), (4, 3, 2, 3, 1), (5, 2, 1, 4, 1), (6, 1, 0, 5, 0)],
    "star5": [(1, 6, 5, 1, 1), (2, 5, 4, 2, 1), (3, 4, 3, 3, 1), (4, 3, 2, 4, 1), (5, 2, 1, 0, 1), (6, 1, 0, 5, 0)],
    "k4_isolated": [(1, 7, 6, 4, 0), (2, 6, 6, 5, 0), (3, 5, 6, 6, 0), (4, 4, 6, 0, 3), (5, 3, 3, 1, 2), (6, 2, 1, 2, 1), (7, 1, 0, 3, 0)],
}


@pytest.fixture(scope="module")
def run(spark):
    return api.analyze(generators.fixture_graphs(spark, [k for k in generators.FIXTURES if k != "dodecahedral"]))


def by_k(df, column):
    out = {}
    for r in df.select("graph_id", "k", column).orderBy("k").collect():
        out.setdefault(r["graph_id"], []).append(r[column])
    return out


def test_golden_values(run):
    found = [by_k(run.dk, c) for c in ("dk_density", "dk_tail_degree", "dk_degeneracy")] + [by_k(run.alpha, c) for c in ("alpha_removal", "alpha_exact")]
    for name, rows in GOLDEN.items():
        for values, want in zip(found, rows, strict=True):
            assert values[name] == [int(c) for c in want], name


def test_golden_traces(run):
    for name, want in TRACES.items():
        rows = run.trace.filter(run.trace.graph_id == name).orderBy("step").collect()
        assert [(r.step, r.vertices_before, r.edges_before, r.vid, r.deg_at_removal) for r in rows] == want


def test_witnesses(spark, run):
    g = generators.fixture_graphs(spark)
    want = {("C8_chords", 2): (2, 1, 8, 10, 2), ("K4", 0): (3, 1, 4, 6, 3), ("petersen", 3): (3, 1, 10, 15, 3), ("lollipop", 3): (4, 6, 5, 10, 4), ("lollipop", 6): (1, 1, 10, 15, 1)}
    for (name, k), row in want.items():
        r = density.witness_report(g, run.trace, k).filter(f"graph_id = '{name}'").first()
        assert (r.dk, r.step, r.n_witness, r.m_witness, r.min_degree) == row
    r = exact.exact_witness(generators.fixture_graphs(spark, ["lollipop"]), 2).first()
    assert (r.alpha_exact, r.vids) == (4, [0, 1, 2, 3, 4])


def test_k_outside_the_range(run):
    at = lambda k: {r.graph_id: r[2:] for r in density.dk_at(run.trace, k).collect()}
    assert at(-3)["K4"] == (3, 0, 3)
    assert at(4)["K4"] == (0, 3, 0)
    assert at(99)["lollipop"] == (0, 4, 0)


def test_ratios_and_classes(run):
    rows = {r.graph_id: r for r in run.ratios.collect()}
    assert rows["star5"]["class"] == "worst case" and rows["petersen"]["class"] == "optimal"
    assert rows["C6_chords"].max_ratio == 1.5 and rows["C6_chords"]["class"] == "neither"
    assert rows["k4_isolated"].n_infinite == 3
    zero = verify.verify(run.dk, run.alpha, zero_policy="zero").filter("graph_id = 'k4_isolated' AND k = 5").first()
    assert zero.ratio == 0.0
    assert not rows["bound_break"].all_upper_ok


def test_statistics(spark):
    rows = {r.graph_id: r for r in stats.graph_stats(generators.fixture_graphs(spark, ["K4", "C6_chords", "petersen", "two_edges", "single"])).collect()}
    assert (rows["K4"].avg_degree, rows["K4"].density, rows["K4"].avg_clustering, rows["K4"].connected) == (3.0, 1.0, 1.0, True)
    assert round(rows["C6_chords"].density, 4) == 0.5333 and rows["petersen"].avg_clustering == 0.0
    assert not rows["two_edges"].connected
    assert rows["single"].density is None and rows["single"].avg_degree == 0.0


def test_dodecahedral_is_beyond_exact(spark):
    g = generators.fixture_graphs(spark, ["dodecahedral"])
    assert stats.size(g).first().m == 30 and stats.min_degree(g).first().min_degree == 3
    assert exact.alpha_exact(g).count() == 0
    with pytest.raises(ValueError):
        exact.alpha_exact(g, 21)


def test_empty_graph(spark):
    g = graph.from_edge_list(spark, [])
    assert api.analyze(g).dk.count() == 0 and stats.size(g).count() == 0


def test_validation(spark):
    with pytest.raises(ValueError):
        graph.from_edge_list(spark, [(1, 1)]).validate()
    bad = graph.Graph(spark.range(1).selectExpr("'g' graph_id", "id vid", "'' label"), spark.createDataFrame([("g", 0, 5)], graph.EDGES))
    with pytest.raises(ValueError):
        bad.validate()
    with pytest.raises(Exception, match="use core_numbers"):
        peel.peel_trace(generators.fixture_graphs(spark, ["K5"]), max_edges=3).count()


def test_sources(spark, tmp_path):
    assert graph.from_edge_list(spark, [(0, 4), (4, 0)]).vertices.count() == 5
    g = graph.from_labels(spark.createDataFrame([("g", "x", "a", 1), ("g", "b", "x", 2)], "graph_id string, a string, b string, at int"), "at")
    assert {(r.label, r.vid) for r in g.vertices.collect()} == {("a", 0), ("x", 1), ("b", 2)}
    with pytest.raises(ValueError, match="ca-GrQc"):
        graph.read_graph(spark, "nowhere")
    with pytest.raises(FileNotFoundError):
        graph.read_graph(spark, "ca-GrQc", str(tmp_path))
    import gzip

    with gzip.open(tmp_path / "ca-GrQc.txt.gz", "wt") as f:
        f.write("# x\n1 2\n2 3\n7 7\n9 8\n")
    g = graph.read_graph(spark, "ca-GrQc", str(tmp_path))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(1, 2), (2, 3)]
    assert clean.remove_vertex(g, 2).edges.count() == 0
    assert g.add_edges(spark.createDataFrame([("ca-GrQc.txt.gz", 3, 1), ("ca-GrQc.txt.gz", 2, 1)], graph.EDGES)).edges.count() == 4
    shown = graph.described(spark, spark.createDataFrame([("wiki-Vote",), ("mine",)], "name string"))
    assert {(r.name, r.category, r.catalog_n) for r in shown.collect()} == {("wiki-Vote", "Communication Networks", 7115), ("mine", "other", None)}


def test_labels_are_numbered_in_order(spark):
    """Dense numbers by label within each graph, over many ranges."""
    rows = [(f"g{i % 3}", f"{(i * 7919) % 1000:04d}", f"x{i % 40:02d}") for i in range(1000)]
    g = graph.from_labels(spark.createDataFrame(rows, "graph_id string, a string, b string"))
    want = {}
    for k, a, b in rows:
        want.setdefault(k, set()).update((a, b))
    got = {(r.graph_id, r.vid): r.label for r in g.vertices.collect()}
    assert got == {(k, i): label for k, labels in want.items() for i, label in enumerate(sorted(labels))}


def test_command_line(spark, tmp_path, capsys):
    cli.main(["list"], spark)
    (tmp_path / "my_graph.txt").write_text("# a triangle with a tail\n1 2\n2 3\n3 1\n3 4\n4 4\n")
    cli.main(["stats", "--graph", f"{tmp_path}/my_graph.txt", "--file"], spark)
    said = capsys.readouterr().out
    assert "ca-GrQc" in said and "density" in said and "avg_clustering" in said
    cli.main(["report", "--graph", f"{tmp_path}/my_graph.txt", "--file", "--max-k", "2", "--out", str(tmp_path)], spark)
    said = capsys.readouterr().out
    assert "alpha_k" in said and "✓" in said
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith("parquet")]


def test_random_graphs(spark):
    a, b = generators.random_graph(spark, 60, 0.2, seed=3), generators.random_graph(spark, 60, 0.2, seed=3)
    assert a.edges.exceptAll(b.edges).isEmpty() and 250 < a.edges.count() < 460
    assert generators.random_graph(spark, 30, 1.0).validate().edges.count() == 435
    assert [generators.random_graph(spark, *x).edges.count() for x in ((30, 0.0), (1, 0.5), (0, 0.5))] == [0, 0, 0]


def test_random_graph_in_pieces(spark, monkeypatch):
    """Many pieces: simple edges, about as many as p gives, in every part of the pairs."""
    monkeypatch.setattr(generators, "_PIECE_EDGES", 50)
    g = generators.random_graph(spark, 400, 0.05, seed=2).validate()
    at = np.array([r.dst * (r.dst - 1) // 2 + r.src for r in g.edges.collect()])
    pairs = 400 * 399 // 2
    assert abs(len(at) - pairs * 0.05) < 5 * (pairs * 0.05 * 0.95) ** 0.5
    assert np.histogram(at, 20, (0, pairs))[0].min() > 0.6 * pairs * 0.05 / 20


def test_preferential_graphs(spark):
    pairs = generators.preferential_pairs(50, 3, seed=1)
    assert len(pairs) == len(set(pairs)) == 3 + 46 * 3
    with pytest.raises(ValueError):
        generators.make(spark, "moebius")


def test_peel_against_core_numbers(spark):
    g = generators.random_graph(spark, 80, 0.1, seed=5)
    trace = peel.peel_trace(g)
    assert trace.agg({"deg_at_removal": "sum"}).first()[0] == g.edges.count()
    one = density.dk_all(trace).select("graph_id", "k", "dk_degeneracy")
    two = peel.dk_degeneracy_from_cores(peel.core_numbers(g))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def plain_peel(n, edges):
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = []
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        order.append((v, len(near[v])))
        for u in near.pop(v):
            near[u].discard(v)
    return order


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.floats(0, 1), st.integers(0, 10**6))
def test_peel_order_is_the_plain_one(n, p, seed):
    rng = random.Random(seed)
    edges = [e for e in combinations(range(n), 2) if rng.random() < p]
    src, dst = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
    order, degree = peel.peel_order(n, src, dst)
    assert list(zip(order.tolist(), degree.tolist(), strict=True)) == plain_peel(n, edges)


def test_packed_neighbours_come_in_any_pieces():
    """Three graphs with the same numbers, an isolated vertex and a hub, in batches that cut vertices apart."""
    import pyarrow as pa

    rng = random.Random(3)
    graphs = {"a": [e for e in combinations(range(40), 2) if rng.random() < 0.2], "b": [(0, v) for v in range(1, 41)], "c": []}
    rows = sorted(((v, g, None) for g in graphs for v in range(42)), key=str) + [(u, g, v) for g, edges in graphs.items() for a, b in edges for u, v in ((a, b), (b, a))]
    rows.sort(key=lambda r: r[0])
    parts = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    batches = [pa.RecordBatch.from_pydict({"graph_id": pa.array([r[1] for r in p]), "u": pa.array([r[0] for r in p], pa.int64()), "v": pa.array([r[2] for r in p], pa.int64())}) for p in parts]
    packed = pa.Table.from_batches(list(peel._pack(iter(batches))))
    for g, edges in graphs.items():
        own = packed.filter(pa.compute.equal(packed["graph_id"], g)).to_batches(max_chunksize=3)
        got = pa.Table.from_batches(list(peel._peel(None)((pa.scalar(g),), iter(own)))).to_pydict()
        order = plain_peel(42, edges)
        assert list(zip(got["vid"], got["deg_at_removal"], strict=True)) == order
        gone = [0, *accumulate(d for _, d in order)]
        assert got["edges_before"] == [len(edges) - x for x in gone[:-1]] and got["vertices_before"] == list(range(42, 0, -1)) and got["step"] == list(range(1, 43))


def test_no_limit_on_edges(spark):
    """10.1 million edges among few vertices: the whole peel by default."""
    n = 4500
    src, dst = (spark.range(0, n, 1, 4).withColumnRenamed("id", c) for c in ("src", "dst"))
    edges = src.crossJoin(dst).filter("src < dst").selectExpr("'K' graph_id", "src", "dst")
    trace = peel.peel_trace(graph.Graph(spark.range(n).selectExpr("'K' graph_id", "id vid", "'' label"), edges))
    whole = f"vid = step - 1 AND deg_at_removal = {n} - step AND vertices_before = {n} - step + 1 AND edges_before = ({n} - step + 1) * ({n} - step) div 2"
    assert trace.selectExpr("count(*)", f"count_if({whole})", "count(DISTINCT step)").first()[:] == (n, n, n)


def test_alpha_removal_is_the_density_before(run):
    a, r = by_k(run.dk, "dk_density"), by_k(run.alpha, "alpha_removal")
    for name, values in r.items():
        assert values[1:] == a[name][: len(values) - 1]


def test_charts(run, tmp_path):
    panels = charts.four_panels(run.dk, run.alpha, run.checked)
    assert set(panels) == {"lines", "ratio", "scatter", "histogram"}
    assert charts.file_name("a b/c") == "a_b_c_alpha_k_correlation.parquet"
    path = charts.write_chart(panels["histogram"], str(tmp_path), "h.csv", "csv")
    assert path.endswith("h.csv")
    total = {r.graph_id: r["sum(count)"] for r in panels["histogram"].groupBy("graph_id").sum("count").collect()}
    assert total["lollipop"] == 10


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.yml")).graph.name == "test_graph.txt"
    assert not list(tmp_path.iterdir())
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text(yaml.dump({"graph": {"max_k": 7}, "computation": {"max_nodes_for_exact": 9}}))
    c = config.load(str(tmp_path / "c.yml"), graph="my_graph.txt")
    assert (c.graph.name, c.k_max(100), c.k_max(5), c.computation.max_nodes_for_exact, c.title) == ("my_graph.txt", 7, 4, 9, "My Graph")
    assert config.Config().k_max(100) == 20
    (tmp_path / "bad.yml").write_text("graph: {colour: red}")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.yml"))


def test_report_and_comparison(spark):
    g = generators.fixture_graphs(spark, ["petersen", "K5"])
    r = {x.graph_id: x for x in api.report(g, 3).collect()}
    assert r["petersen"].dk == 3 and r["petersen"].alpha_k == 3
    assert api.compare_peels(g)["equal"]
    with pytest.raises(ValueError):
        api.load(spark, "ether")


def test_components_of_chains_in_few_rounds(spark, monkeypatch):
    """A chain in id order, one in reverse, a star, repeated edges and loops; by rounds alone and with the last task."""
    from bramble.operators import connect

    chain = [(i, i + 1) for i in range(10_000)]
    more = [(20_001 - i, 20_000 - i) for i in range(300)] + [(30_000, 30_001 + i) for i in range(500)] * 2 + [(5, 5), (40_000, 40_000), (50_000, None)]
    edges = spark.createDataFrame([("g", a, b) for a, b in chain + more] + [("h", 1, 2), ("h", 10_001, 3)], "graph_id string, a long, b long")
    rounds = []
    monkeypatch.setattr(connect, "_round", lambda *args, f=connect._round: rounds.append(1) or f(*args))
    want = {("g", i): 0 for i in range(10_001)} | {("g", 19_701 + i): 19_701 for i in range(301)} | {("g", 30_000 + i): 30_000 for i in range(501)}
    want |= {("h", 1): 1, ("h", 2): 1, ("h", 3): 3, ("h", 10_001): 3}
    for most in (0, 400_000):
        monkeypatch.setattr(connect, "LOCAL_EDGES", most)
        rounds.clear()
        got = connect.connected(edges, ["graph_id"])
        assert {(r.graph_id, r.id): r.component for r in got.collect()} == want
        assert len(rounds) <= 20 and bool(rounds) == (most == 0)
    assert connect.connected(edges.limit(0).drop("graph_id")).count() == 0
