"""Structure, propagation and verification on hand-made graphs, against stated values and NumPy."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quellgraph.operators import dense, ensemble, fingerprint, gcn, graph, pipeline, propagation, temporal, traversal, verification
from quellgraph.runtime import cut
from quellgraph.schema import EDGES, NODES, check, conform
from quellgraph.sources import simulate


def make(spark, nodes, edges, g="g"):
    n = spark.createDataFrame([(g, i, v, k, p, s) for i, (v, k, p, s) in enumerate(nodes)], "graph_id string, ord int, node_id string, node_type string, privilege_level double, sensitivity double")
    e = spark.createDataFrame([(g, i, a, b, k, w, lim) for i, (a, b, k, w, lim) in enumerate(edges)], "graph_id string, ord int, src string, dst string, edge_type string, weight double, delegation_depth_limit int")
    return cut(conform(n, NODES)), cut(conform(e, EDGES))


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [("A", "USER", 0.05, 0.1), ("B", "SERVICE", 0.2, 0.3), ("C", "SERVICE", 0.4, 0.5), ("D", "ROLE", 0.95, 0.95)], [("A", "B", "AUTHENTICATE_AS", 0.8, 2), ("B", "C", "TOKEN_MINT", 0.7, 2), ("C", "D", "ASSUME_ROLE", 0.9, 1)])


@pytest.fixture(scope="module")
def random_graphs(spark):
    rng = np.random.default_rng(5)
    parts = []
    for k in range(3):
        n = 12
        pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b}
        parts.append(make(spark, [(f"v{i:02d}", "SERVICE", float(i) / n, 0.5) for i in range(n)], [(f"v{a:02d}", f"v{b:02d}", "TOKEN_MINT", float(rng.uniform(0.2, 1)), 3) for a, b in sorted(pairs)], f"r{k}"))
    n, e = parts[0]
    for a, b in parts[1:]:
        n, e = n.unionByName(a), e.unionByName(b)
    return cut(n), cut(e)


def seed(spark, v, g="g"):
    return spark.createDataFrame([(g, v)], "graph_id string, node_id string")


def risks(df):
    return {r["node_id"]: round(r["risk"], 6) for r in df.collect()}


def test_reachability(spark, chain):
    n, e = chain
    r = traversal.reachability(n, e, seed(spark, "A"))
    assert risks(r) == {"A": 1.0, "B": 0.5, "C": round(1 / 3, 6), "D": 0.25}
    h = traversal.reachability_header(n, r).first()
    assert (h["depth"], h["cascade_probability"], h["n_compromised"]) == (3, 1.0, 4)
    assert rows(traversal.reachability(n, e, seed(spark, "A"), 1).where("compromised"), "node_id") == {("A",), ("B",)}
    assert rows(traversal.reachability(n, e, seed(spark, "A"), None, ["ASSUME_ROLE"]).where("compromised"), "node_id") == {("A",)}
    with pytest.raises(KeyError):
        traversal.reachability(n, e, seed(spark, "nobody"))


def test_both_tiers_of_bfs_agree(spark, random_graphs, monkeypatch):
    n, e = random_graphs
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    few = rows(traversal.bfs(e, s))
    monkeypatch.setattr(dense, "SMALL_EDGES", 1)
    assert rows(traversal.bfs(e, s)) == few and len(few) > 10


def test_epidemic(spark, chain):
    n, e = chain
    assert risks(propagation.epidemic(n, e, seed(spark, "A"))) == {"A": 1.0, "B": 0.0, "C": 0.0, "D": 0.0}
    want = {"D": 1.0, "C": 0.27, "B": 0.0567, "A": 0.013608}
    assert risks(propagation.epidemic(n, e, seed(spark, "D"))) == want
    assert risks(propagation._mat_vec_joined(n, e, seed(spark, "D"), 0.3, 50, 1e-4, True, "reverse")) == want
    assert rows(propagation.epidemic(n, e, seed(spark, "D"), beta=0.0).where("compromised"), "node_id") == {("D",)}


def test_control_and_spectral(spark, chain, random_graphs):
    n, e = chain
    assert rows(propagation.spectral_cascade(n, e, seed(spark, "A")).where("compromised"), "node_id") == {("A",)}
    n, e = random_graphs
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    h = {(r["graph_id"], r["node_id"]): r for r in propagation.spectral_header(n, e).collect()}
    got = {(r["graph_id"], r["node_id"]): r["risk"] for r in propagation.control_system(n, e, s).collect()}
    power = {(r["graph_id"], r["node_id"]): r for r in propagation.spectral_radius(n, e, 15).collect()}
    for g in ("r0", "r1", "r2"):
        sparse = dense.Sparse(n.where(F.col("graph_id") == g).toPandas(), e.where(F.col("graph_id") == g).toPandas())
        ids, a = sparse.ids, sparse.matrix()
        lam = max(np.linalg.eigvals(a).real)
        assert abs(h[g, ids[0]]["lambda_max"] - lam) < 1e-9
        z = np.ones(len(a))
        for _ in range(15):
            y = a @ z + z
            z, top = y / y.max(), y.max()
        assert abs(power[g, ids[0]]["radius"] - (top - 1)) < 1e-9
        x = np.array([v == "v00" for v in ids], float)
        for _ in range(50):
            y = np.clip(a / (lam + 1e-9) @ x, 0, 1)
            x, move = y, np.linalg.norm(y - x)
            if move < 1e-4:
                break
        assert all(abs(got[g, v] - x[i]) < 1e-9 for i, v in enumerate(ids))


@pytest.mark.parametrize("n_nodes", [1_990, 2_010])
def test_graphs_without_circles_have_no_cascade_at_any_size(spark, n_nodes):
    n, e = make(spark, [(f"v{i:05d}", "SERVICE", 0.5, 0.5) for i in range(n_nodes)], [(f"v{i:05d}", f"v{i + k:05d}", "TOKEN_MINT", 0.9, 3) for i in range(n_nodes) for k in (1, 2, 3) if i + k < n_nodes])
    assert rows(propagation.spectral_cascade(n, e, seed(spark, "v00000")).where("compromised"), "node_id") == {("v00000",)}
    assert propagation.stability(n, e).first()["radius"] == 0


def test_spectral_forms_agree(spark, random_graphs, monkeypatch):
    """Dense, iterated in one task, and by joins; with a graph without circles among them."""
    line = make(spark, [(f"x{i}", "SERVICE", 0.1, 0.1) for i in range(9)], [(f"x{i}", f"x{i + 1}", "TOKEN_MINT", 0.5, 1) for i in range(8)], "line")
    n, e = (a.unionByName(b) for a, b in zip(random_graphs, line, strict=True))
    want = {tuple(r[:2]): (round(r["lambda_max"], 6), round(r["vector"], 5)) for r in propagation.spectral_header(n, e).collect()}
    assert want["line", "x0"] == (0.0, 0.0) and want["r0", "v00"][0] > 0.5
    for g in ("r0", "r1", "line"):
        sparse = dense.Sparse(n.where(F.col("graph_id") == g).toPandas(), e.where(F.col("graph_id") == g).toPandas())
        gaps = [sparse.gap(k) for k in ("lower", "avg")]
        with monkeypatch.context() as m:
            m.setattr(dense, "EIGEN_NODES", 0)
            value, vector = sparse.leading()
            assert all(want[g, v] == (round(value, 6), round(x, 5)) for v, x in zip(sparse.ids, vector, strict=True))
            assert np.allclose([sparse.gap(k) for k in ("lower", "avg")], gaps, atol=1e-8)
    n, e = (x.where("graph_id in ('r0', 'line')") for x in (n, e))
    monkeypatch.setattr(dense, "SMALL_NODES", 0)
    got = {tuple(r[:2]): (round(r["lambda_max"], 6), round(r["vector"], 5)) for r in propagation.spectral_header(n, e).collect()}
    assert got == {k: v for k, v in want.items() if k[0] in ("r0", "line")}


def test_structure_forms_agree(spark, random_graphs, monkeypatch):
    n, e = (x.where("graph_id = 'r1'") for x in random_graphs)
    own = lambda: ({tuple(r[:2]): round(r[2], 9) for r in graph.clustering(n, e).collect()}, rows(graph.components(n, e)), [round(v, 9) if isinstance(v, float) else v for k, v in fingerprint.fingerprint(n, e).first().asDict().items() if k != "spectral_gap"])
    few = own()
    monkeypatch.setattr(dense, "TASK_PATHS", 60)
    assert own() == few
    monkeypatch.setattr(dense, "SMALL_NODES", 0)
    assert own() == few


def test_layout_of_large_graphs(monkeypatch):
    import pandas as pd

    kernel = {}
    monkeypatch.setattr(dense, "per_graph", lambda n, e, k, *a: kernel.setdefault("k", k))
    dense.layout(None, None, rounds=5)
    v = pd.DataFrame({"ord": 0, "node_id": [f"v{i:05d}" for i in range(5_000)], "privilege_level": 0.5})
    e = pd.DataFrame({"src": v["node_id"].iloc[:-1].to_numpy(), "dst": v["node_id"].iloc[1:].to_numpy(), "weight": 0.5})
    out = kernel["k"](v, e)
    assert len(out) == 5_000 and out[["x", "y"]].abs().max().max() <= 10 and out["x"].nunique() > 4_000 and (out["z"] == 5).all()


def test_gated_forms_agree(spark, random_graphs):
    n, e = random_graphs
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    for conditions in (False, True):
        few, many = traversal.gated(n, e, s, 6, conditions), traversal._gated_levels(e, s, 6, conditions, 42)
        assert rows(few[0]) == rows(many[0]) and rows(few[1]) == rows(many[1]) and few[1].count() == many[1].count() > 20


def test_edges_put_in_and_taken_out(spark, chain):
    n, e = chain
    new = spark.createDataFrame([("g", 9, "D", "A", "ASSUME_ROLE", 0.3, 1), ("g", 10, "A", "B", "TOKEN_MINT", 0.9, 1), ("g", 11, "A", "nobody", "TOKEN_MINT", 0.9, 1)], "graph_id string, ord int, src string, dst string, edge_type string, weight double, delegation_depth_limit int")
    more = graph.add_edge(n, e, new)
    assert rows(more, "src", "dst", "weight") == {("A", "B", 0.9), ("B", "C", 0.7), ("C", "D", 0.9), ("D", "A", 0.3)}
    assert rows(graph.drop_edge(more, new), "src", "dst") == {("B", "C"), ("C", "D")}
    with pytest.raises(KeyError):
        graph.get_edge(e, "A", "D")


def test_epidemic_tiers(spark, random_graphs):
    n, e = random_graphs
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    few = {tuple(r[:2]): round(r["risk"], 9) for r in propagation._mat_vec(n, e, s, 0.3, 3, 0, True, "reverse").collect()}
    assert few == {tuple(r[:2]): round(r["risk"], 9) for r in propagation._mat_vec_joined(n, e, s, 0.3, 3, 0, True, "reverse").collect()}


def test_percolation(spark, chain):
    n, e = chain
    s = seed(spark, "A")
    assert rows(propagation.percolation(n, e, s, p=0.0, n_trials=4).where("compromised"), "node_id") == {("A",)}
    sure = e.withColumn("weight", F.lit(1.0))
    assert set(risks(propagation.percolation(n, sure, s, p=1.0, n_trials=3)).values()) == {1.0}


def test_components_and_structure(spark, chain, random_graphs):
    n, e = chain
    far = make(spark, [(f"x{i:03d}", "SERVICE", 0.1, 0.1) for i in range(60)], [(f"x{i:03d}", f"x{i + 1:03d}", "TOKEN_MINT", 0.5, 1) for i in range(49)], "long")
    c = graph.components(n.unionByName(far[0]), e.unionByName(far[1]))
    assert rows(c.groupBy("graph_id", "component").count()) == {("g", "A", 4), ("long", "x000", 50), *{("long", f"x{i:03d}", 1) for i in range(50, 60)}}
    f = fingerprint.fingerprint(n, e).first()
    assert round(f["degree_entropy"], 6) == 1.918296 and f["density"] == 0.25 and f["clustering"] == 0.0 and round(f["centrality_variance"], 6) == 0.027778
    assert round(f["avg_path_length"], 6) == 1.666667 and f["spectral_gap"] == 0.0 and f["topology_type"] == "HUB"
    n, e = (x.where("graph_id = 'r0'") for x in random_graphs)
    one = {tuple(r[:2]): round(r[2], 9) for r in traversal.betweenness(n, e).collect()}
    two = {tuple(r[:2]): round(r[2], 9) for r in traversal.betweenness_joined(n, e).collect()}
    assert one == two
    comps = graph.components(n, e)
    assert {r[0]: round(r[1], 9) for r in traversal.average_path(n, e, comps).collect()} == {r[0]: round(r[1], 9) for r in traversal._average_path_joined(n, e, comps).collect()}


def test_graph_operators(spark, chain):
    n, e = chain
    assert check(n, e) == {"node_type": 0, "edge_type": 0, "repeated_nodes": 0, "repeated_edges": 0, "dangling_ends": 0}
    assert rows(graph.neighbors(e, "both").where("node_id = 'B'"), "neighbor") == {("A",), ("C",)}
    with pytest.raises(ValueError):
        graph.neighbors(e, "sideways")
    with pytest.raises(KeyError):
        graph.get_node(n, "nobody")
    assert graph.get_edge(e, "A", "B").count() == 1 and graph.high_privilege(n).count() == 1
    twice = e.unionByName(e.withColumn("weight", F.col("weight") + 0.05).withColumn("ord", F.col("ord") + 10)).unionByName(e.withColumn("dst", F.col("src")))
    assert rows(graph.keep_strongest(twice), "src", "weight") == {("A", 0.8500000000000001), ("B", 0.75), ("C", 0.9500000000000001)}
    assert rows(traversal.simple_paths(n, e, seed(spark, "A"), 0.8).select(F.concat_ws("", "path"))) == {("ABCD",)}
    left_n, left_e = graph.drop_node(n, e, "B")
    assert left_n.count() == 3 and left_e.count() == 1


def test_gated_traversal(spark, chain):
    n, e = chain
    seen, steps = traversal.gated(n, e, seed(spark, "A"))
    assert rows(seen, "node_id") == {("A",), ("B",), ("C",)}
    assert rows(steps, "src", "outcome") == {("A", "succeeded"), ("B", "succeeded"), ("C", "depth_exceeded")}
    assert rows(traversal.gated(n, e, seed(spark, "A"), max_depth=0)[0], "node_id") == {("A",)}
    blocked = e.withColumn("weight", F.lit(0.0))
    assert rows(traversal.gated(n, blocked, seed(spark, "A"), conditions=True)[0], "node_id") == {("A",)}
    pred = n.select("graph_id", "node_id", F.lit(0.5).alias("risk"), F.col("node_id").isin("A", "B", "D").alias("compromised"))
    f = verification.flags(n, pred, seen)
    b = verification.blast_radius(f).first()
    assert (b["pbr_size"], b["vbr_size"], b["gap_size"], b["missed"], b["classification"]) == (3, 3, 1, 1, "CRITICAL_MISS") and b["exploitability_gap"] == 0.5
    assert rows(verification.node_class(f), "node_id", "gap_classification") == {("A", "VERIFIED"), ("B", "VERIFIED"), ("C", "CRITICAL_MISS"), ("D", "GAP")}
    assert rows(verification.critical_paths(f.withColumn("privilege_level", F.lit(0.9)), steps).select("node_id", F.concat_ws("", "path"))) == {("A", "A"), ("B", "AB"), ("C", "ABC")}


def test_prf_edges(spark):
    data = [("x", True, True), ("x", True, False), ("x", False, True), ("no_p", False, True), ("no_a", True, False), ("none", False, False)]
    df = spark.createDataFrame(data, "k string, predicted boolean, actual boolean")
    got = {r["k"]: (r["precision"], r["recall"], r["f1"]) for r in verification.prf(df, ["k"]).collect()}
    assert got == {"x": (0.5, 0.5, 0.5), "no_p": (0.0, 0.0, 0.0), "no_a": (0.0, 0.0, 0.0), "none": (1.0, 1.0, 1.0)}
    got = {r["k"]: (r["precision"], r["recall"], r["f1"]) for r in verification.prf(df, ["k"], "calibration").collect()}
    assert got["no_p"] == (1.0, 0.0, 0.0) and got["no_a"] == (0.0, 1.0, 0.0)


def test_ensemble(spark):
    r = spark.createDataFrame([("g", m, v, x, x >= 0.5) for m, v, x in [("graph_traversal", "A", 1.0), ("epidemic", "A", 0.5), ("gnn", "A", 0.0), ("graph_traversal", "B", 0.2)]], "graph_id string, model string, node_id string, risk double, compromised boolean")
    w = ensemble.priors(spark).where("topology_type = 'MIXED'")
    assert risks(ensemble.weighted(r, w)) == {"A": 0.55, "B": 0.1}
    assert ensemble.invalid(ensemble.priors(spark)).count() == 0 and ensemble.invalid(ensemble.uniform(spark)).count() == 0
    zero = spark.createDataFrame([("T", "a", 0.0), ("T", "b", 0.0)], "topology_type string, model string, weight double")
    assert rows(ensemble.normalised(zero), "weight") == {(0.5,)}
    assert rows(ensemble.voting(r), "node_id", "compromised") == {("A", False), ("B", False)}
    c = {x["node_id"]: x for x in ensemble.confidence(r).collect()}
    assert abs(c["A"]["mean"] - 0.25) < 1e-12 and c["A"]["uncertain"] and not c["B"]["uncertain"]
    h = spark.createDataFrame([(i, "T", m, 0.5) for i in range(30) for m in ("a", "b")] + [(i, "U", "a", 1.0) for i in range(30)] + [(99, None, "a", 1.0)], "id int, topology_type string, model_name string, f1_score double")
    assert rows(ensemble.adaptive(h, models=("a", "b"))) == {("T", "a", 0.5), ("T", "b", 0.5)}
    assert ensemble.recent(h.where("topology_type = 'U'"), 20).agg(F.min("id")).first()[0] == 10


def test_simulated_topologies(spark):
    parts = [simulate.generate(spark, kind, 40, [1, 2]) for kind in ("HUB", "CHAIN", "DENSE_CLUSTER")]
    n, e = (cut(parts[0][i].unionByName(parts[1][i]).unionByName(parts[2][i])) for i in (0, 1))
    assert check(n, e) == {"node_type": 0, "edge_type": 0, "repeated_nodes": 0, "repeated_edges": 0, "dangling_ends": 0}
    clusters = {r["graph_id"]: r["k"] for r in n.groupBy("graph_id").agg(F.countDistinct(F.col("tags")["cluster"]).alias("k")).collect()}
    got = {r["graph_id"]: r["topology_type"] for r in fingerprint.fingerprint(n, e).collect()}
    assert all(got[f"hub-{k}"] == "HUB" and got[f"chain-{k}"] == "CHAIN" for k in (1, 2))
    # Four clusters of this size have a density below that of the class.
    assert all(v == ("DENSE_CLUSTER" if clusters[g] == 3 else "MIXED") for g, v in got.items() if g.startswith("dense"))
    n, e = simulate.generate(spark, "MIXED", 50, [1, 2])
    assert e.where("edge_id like 'hub%->chain%' or edge_id like 'chain%->cluster%'").count() == 4 and n.select("graph_id").distinct().count() == 2


def test_gcn(spark, chain):
    n, e = chain
    x = cut(gcn.features(n, e, seed(spark, "A")))
    assert {len(r["x"]) for r in x.collect()} == {13}
    rng = np.random.default_rng(0)
    w = {k: v.tolist() for k, v in gcn._layers(rng, (13, 6, 4, 1)).items()}
    got = {r["node_id"]: r["risk"] for r in gcn.forward(x, e, w).collect()}
    labels = propagation.graph_traversal(n, e, seed(spark, "A"))
    (xs, a, y), = gcn.training_graphs(n, e, x, labels)
    ids = [r["node_id"] for r in n.join(x, ["graph_id", "node_id"]).select("node_id").collect()]
    h = np.maximum(a @ (xs @ np.array(w["w1"]).T + w["b1"]), 0)
    h = np.maximum(a @ (h @ np.array(w["w2"]).T + w["b2"]), 0)
    want = 1 / (1 + np.exp(-(h @ np.array(w["w3"]).T + w["b3"])[:, 0]))
    assert sorted(np.round(list(got.values()), 9)) == sorted(np.round(want, 9)) and len(ids) == 4


def test_gcn_training():
    rng = np.random.default_rng(0)
    graphs = []
    for _ in range(40):
        m = 10
        adj = np.eye(m) + (rng.random((m, m)) < 0.1)
        f = rng.random((m, 13))
        y = (f[:, 1] > 0.6).astype(float)
        f[:, 2] = y
        graphs.append((f, adj / adj.sum(1, keepdims=True), y))
    p = gcn._layers(rng, (13, 5, 4, 1))
    _, grad, _ = gcn._loss(p, graphs[:3], 3.0)
    for k, at in (("w1", (2, 3)), ("b1", (1,)), ("w2", (1, 2)), ("w3", (0, 1)), ("b3", (0,))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        slope = (gcn._loss(up, graphs[:3], 3.0)[0] - gcn._loss(down, graphs[:3], 3.0)[0]) / 2e-5
        assert abs(slope - grad[k][at]) < 1e-6
    _, f1 = gcn.train(graphs[:30], graphs[30:], epochs=120, rate=1e-2, patience=60, threshold=0.5)
    everything = gcn._macro_f1([np.ones(10)] * 10, graphs[30:], 0.5)
    assert f1 > everything + 0.1


def test_temporal(spark, chain):
    n, e = chain
    s = seed(spark, "A")
    sure = temporal.outcomes(temporal.simulate(n, e, s, [("greedy", 1)], detection=1.0, steps=20)).first()
    assert sure["detected_at"] == 1
    never = temporal.outcomes(temporal.simulate(n, e, s, [("greedy", 1), ("stealthy", 1)], detection=0.0, steps=40)).collect()
    assert all(r["detected_at"] is None and r["attacker_success"] and r["n_final"] == 4 for r in never)


def test_temporal_on_any_graph(spark, random_graphs, monkeypatch):
    n, e = random_graphs
    n = n.unionByName(n.where("node_id = 'v00' and graph_id = 'r0'").withColumn("graph_id", F.lit("lone")))
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    stop = e.where("ord % 7 = 0").select("graph_id", "src", "dst")
    runs = [("greedy", 1), ("stealthy", 1), ("random", 1), ("random", 2)]
    for options in ({"detection": 0.01, "steps": 30, "blocked": stop}, {"steps": 18}, {"detection": 0.0, "steps": 13, "dwell": 2}):
        dense_form = sorted(map(tuple, temporal.simulate(n, e, s, runs, **options).collect()))
        with monkeypatch.context() as m:
            m.setattr(dense, "SMALL_NODES", 0)
            joined = sorted(map(tuple, temporal.simulate(n, e, s, runs, **options).collect()))
        assert len(dense_form) == 4 * 4 * options["steps"] and joined == dense_form


def test_percolation_tiers(spark, random_graphs, monkeypatch):
    n, e = random_graphs
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    cols = ("graph_id", "trial", "node_id", "in_giant", "reached", "component", "size")
    few = rows(propagation.percolation_trials(n, e, s, n_trials=20), *cols)
    fused = {tuple(r[:3]): (round(r["risk"], 9), r["compromised"]) for r in propagation.percolation(n, e, s, n_trials=20).collect()}
    assert fused == {tuple(r[:3]): (round(r["risk"], 9), r["compromised"]) for r in propagation._percolation_risk(n, e, s, 0.6, 20, 0.3, 42).collect()} and len(fused) == 36
    monkeypatch.setattr(propagation, "TRIAL_WORK", 0)
    assert len(few) == 3 * 20 * 12 and few == rows(propagation.percolation_trials(n, e, s, n_trials=20), *cols)


def test_full_queries(spark, tmp_path):
    from quellgraph import plans

    path = [f"p{k}" for k in range(8)]
    spark.createDataFrame([("o", v, "SERVICE" if v == "p0" else "ROLE", v, 0.9 if v == "p7" else 0.1, 0.5) for v in path], "org_id string, node_id string, node_type string, name string, privilege_level double, sensitivity double").write.parquet(f"{tmp_path}/org_graph.parquet")
    spark.createDataFrame([("o", i, a, b, "TOKEN_MINT", 0.9, 3) for i, (a, b) in enumerate(zip(path, path[1:]))], "org_id string, edge_id int, source string, target string, edge_type string, weight double, delegation_depth_limit int").write.parquet(f"{tmp_path}/org_edges.parquet")
    d = str(tmp_path)
    assert rows(plans.QUERIES["simple_paths_full"](spark, d), "path") == {(" > ".join(path),)}
    times = dict(rows(plans.QUERIES["percolation_reach_full"](spark, d), "node_id", "times_reached"))
    assert times["p0"] == 100 and 30 < times["p1"] < 80
    risk = dict(rows(plans.QUERIES["percolation_risk"](spark, d), "node_id", "risk"))
    assert any(abs(r * 25 - round(r * 25)) > 1e-6 for r in risk.values())


def test_analysis_takes_weights_of_the_topology(spark, chain, random_graphs):
    from quellgraph.operators.analysis import analyse, graph_weights

    n, e = chain[0].unionByName(random_graphs[0].where("graph_id = 'r0'")), chain[1].unionByName(random_graphs[1].where("graph_id = 'r0'"))
    s = n.where("node_id in ('A', 'v00')").select("graph_id", "node_id")
    results, weights, fused = analyse(n, e, s, percolation={"n_trials": 10})
    kind = {r["graph_id"]: r["topology_type"] for r in fingerprint.fingerprint(n, e).collect()}
    assert kind["g"] == "HUB" and results.select("model").distinct().count() == 6
    want = {}
    for r in results.collect():
        ws = ensemble.PRIORS[kind[r["graph_id"]]]
        k = r["graph_id"], r["node_id"]
        want[k] = want.get(k, 0.0) + r["risk"] * ws[ensemble.MODELS.index(r["model"])] / sum(ws)
    got = {(r["graph_id"], r["node_id"]): (r["risk"], r["compromised"]) for r in fused.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - min(1, v)) < 1e-9 and got[k][1] == (round(v, 9) >= 0.35) for k, v in want.items())
    history = spark.createDataFrame([(i, "HUB", m, 0.5 if m != "gnn" else 1.0) for i, m in enumerate(ensemble.MODELS * 6)], "id int, topology_type string, model_name string, f1_score double")
    w = {(r["graph_id"], r["model"]): (round(r["weight"], 6), r["source"]) for r in graph_weights(fingerprint.fingerprint(n, e), history).collect()}
    assert w["g", "gnn"] == (round(1 / 3.5, 6), "adaptive") and (kind["r0"] == "HUB" or w["r0", "gnn"][1] == "topology_prior")


def test_six_models_vote(spark, small):
    from quellgraph import plans

    n, e, s, r, _, _ = plans.spread._analysed(spark, small)
    votes = {}
    for x in r.where("compromised").collect():
        votes.setdefault((x["graph_id"], x["node_id"]), set()).add(x["model"])
    got = plans.QUERIES["ensemble_voting_full"](spark, small).collect()
    assert len(got) == n.count() and any(x["compromised"] for x in got)
    for x in got:
        k = len(votes.get((x["graph_id"], x["node_id"]), ()))
        assert x["risk"] == round(k / 6, 6) and x["compromised"] == (k >= 4)


def test_pipeline(spark, chain, tmp_path):
    n, e = chain
    run = pipeline.run(n, e, seed(spark, "A"), cycles=2, percolation={"n_trials": 5})
    r = run.report().first()
    assert r["topology_type"] == "HUB" and r["weight_source"] == "topology_prior" and r["tokens"] >= 1 and 0 <= r["success_rate"] <= 1
    nodes = run.node_rows()
    assert nodes.columns[1:] == ["node_id", "type", "privilege_level", "x", "y", "z", "risk_score", "state", "in_pbr", "in_vbr", "exploitability_score"] and nodes.count() == 4
    assert {x["src"]: x["state"] for x in run.edge_rows().collect()}.keys() == {"A", "B", "C"} and rows(run.edge_rows(), "state") <= {("blocked",), ("critical",), ("normal",)}
    one = pipeline.inspect(run, "g", "B").first()
    assert one["out_edges"] == {"TOKEN_MINT": 1} and one["in_edges"] == {"AUTHENTICATE_AS": 1} and pipeline.inspect(run, "g", "nobody").count() == 0
    run.export(str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "analysis")).count() == 4 and spark.read.option("header", True).csv(str(tmp_path / "verification")).count() == 4
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    with pytest.raises(ValueError, match="fusion"):
        pipeline.fuse("median", run.results)
    assert pipeline.fuse("voting", run.results).count() == 4
