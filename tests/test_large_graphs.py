"""Graphs too large for one task's work are dealt to tasks, not to rows of (source, node) or (trial, node)."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quellgraph.operators import dense, fingerprint, propagation
from quellgraph.runtime import cut
from quellgraph.schema import EDGES, NODES, conform


def ring(spark, n):
    """``n`` nodes, each pointing to the next two; a row each, nothing more is needed of them."""
    v = lambda c: F.format_string("v%06d", c)
    nodes = spark.range(n).select(F.lit("g").alias("graph_id"), v("id").alias("node_id"))
    return nodes, spark.range(2 * n).select(F.lit("g").alias("graph_id"), v(F.col("id") % n).alias("src"), v((F.col("id") + 1 + F.expr(f"id div {n}")) % n).alias("dst"))


@pytest.fixture(scope="module")
def mixed(spark):
    """Two graphs of 40 nodes, one of them with a long tail."""
    rng = np.random.default_rng(9)
    edges = {("a", int(x), int(y)) for x, y in rng.integers(0, 40, (90, 2))} | {("b", i, i + 1) for i in range(39)} | {("b", int(x), int(y)) for x, y in rng.integers(0, 20, (40, 2))}
    n = spark.createDataFrame([(g, i, f"v{i:02d}", "SERVICE", 0.1, 0.5) for g in "ab" for i in range(40)], "graph_id string, ord int, node_id string, node_type string, privilege_level double, sensitivity double")
    e = spark.createDataFrame([(g, i, f"v{x:02d}", f"v{y:02d}", "TOKEN_MINT", 0.3 + (x + y) % 7 / 10, 3) for i, (g, x, y) in enumerate(sorted(edges)) if x != y], "graph_id string, ord int, src string, dst string, edge_type string, weight double, delegation_depth_limit int")
    return cut(conform(n, NODES)), cut(conform(e, EDGES))


def test_paths_of_large_graphs_go_to_tasks(spark):
    n, e = ring(spark, 30_000)  # n (n + m) is 2.7 billion
    got = dense.path_graphs(n, e).collect()
    assert [(r["graph_id"], r["parts"]) for r in got] == [("g", 14)]


def brute(n, pairs):
    """By plain search: betweenness before it is scaled, sums of distances and nodes reached along edges, and sums without directions."""
    out, score, sums = {}, [0.0] * n, []
    for x, y in pairs:
        if x != y:
            out.setdefault(x, set()).add(y)
    both = {}
    for x, ys in out.items():
        for y in ys:
            both.setdefault(x, set()).add(y)
            both.setdefault(y, set()).add(x)

    def search(near, s):
        dist, sigma, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        return order, dist, sigma

    for s in range(n):
        order, dist, sigma = search(out, s)
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in out.get(v, ()) if dist[w] == dist[v] + 1)
            score[v] += delta[v] if v != s else 0.0
        sums.append((sum(dist.values()), len(dist) - 1, sum(search(both, s)[1].values())))
    return score, sums


@pytest.mark.parametrize(("at_once", "wide"), [(1_500_000, 64), (300, 1), (1, 3)])
def test_path_kernels(monkeypatch, at_once, wide):
    monkeypatch.setattr(dense, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(dense, "WIDE_LEVELS", wide)
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 20), (90, 200), (70, 400)):
        src, dst = rng.integers(0, n, m), rng.integers(0, n, m)
        score, own = np.zeros(n), np.arange(n)
        d, p = dense._path_sums(n, *dense._adjacency(n, src, dst), own, score)
        u = dense._distance_sums(n, *dense._adjacency(n, np.concatenate([src, dst]), np.concatenate([dst, src])), own)
        want = brute(n, zip(src.tolist(), dst.tolist(), strict=True))
        assert np.allclose(score, want[0]) and list(zip(d.tolist(), p.tolist(), u.tolist(), strict=True)) == want[1]


def test_path_counts_in_parts(spark, mixed, monkeypatch):
    n, e = mixed
    monkeypatch.setattr(dense, "TASK_PATHS", 400)
    got = {(r["graph_id"], r["node_id"]): r for r in dense.path_counts(n, e).collect()}
    assert dense.path_graphs(n, e).agg(F.min("parts")).first()[0] > 5 and len(got) == 80
    for g in "ab":
        score, sums = brute(40, [(int(r["src"][1:]), int(r["dst"][1:])) for r in e.where(F.col("graph_id") == g).collect()])
        for i in range(40):
            r = got[g, f"v{i:02d}"]
            assert abs(r["betweenness"] - score[i] / (39 * 38)) < 1e-12 and (r["directed_sum"], r["directed_pairs"], r["undirected_sum"]) == sums[i]


def test_components_of_arrays():
    rng = np.random.default_rng(4)
    for n, m in ((0, 0), (1, 0), (50, 20), (200, 190), (300, 900)):
        src, dst = rng.integers(0, max(n, 1), m), rng.integers(0, max(n, 1), m)
        assert dense.component_places(n, src, dst).tolist() == dense.component_roots(n, src.tolist(), dst.tolist())


def test_percolation_in_parts(spark, mixed, monkeypatch):
    n, e = mixed
    s = n.where("node_id = 'v00'").select("graph_id", "node_id")
    got = lambda: {tuple(r[:3]): (r["risk"], r["compromised"]) for r in propagation.percolation(n, e, s, n_trials=12).collect()}
    one = got()
    monkeypatch.setattr(propagation, "TRIAL_WORK", 300)
    monkeypatch.setattr(propagation, "_percolation_risk", None)  # no rows of trials
    assert propagation._trial_parts(n, e, 12).agg(F.min("parts")).first()[0] > 3 and got() == one and len(one) == 80


def test_units_of_are_those_of_unit():
    from quellgraph.functions.rng import unit_of, units_of

    assert units_of("42|c|g|3", [b"a|b", "ä|c".encode()]).tolist() == [unit_of(42, "c", "g", 3, "a|b"), unit_of(42, "c", "g", 3, "ä|c")] and len(units_of("1", [])) == 0


def test_feedback_keeps_nothing_of_a_cycle(spark, mixed):
    from pathlib import Path

    from quellgraph.operators import guards
    from quellgraph.runtime import shared_dir, written

    n, e = mixed
    s = cut(n.where("node_id = 'v00'").select("graph_id", "node_id"))
    here = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("written-*")}
    before, made = here(), []

    def analyse(nodes, edges, seeds):
        out = written(nodes.select("graph_id", "node_id", F.lit(0.9).alias("risk"), F.lit(True).alias("compromised")))
        made.append(len(here() - before))
        return out

    after, _, log = guards.feedback(n, e, s, e.where("src = 'v00'").select("graph_id", "src", "dst"), analyse, 2)
    assert made == [1, 1] and here() == before
    assert rows(log, "graph_id", "cycle", F.round("risk", 6)) == {(g, k, 0.9) for g in "ab" for k in (0, 1)} and after.where("weight = 0").count() == e.where("src = 'v00'").count()


@pytest.mark.parametrize("work", [200_000_000, 400])
def test_path_totals(spark, mixed, monkeypatch, work):
    from quellgraph.operators import traversal

    n, e = mixed
    lone = n.where("graph_id = 'a'").limit(1).withColumn("graph_id", F.lit("lone"))
    circle = e.where("graph_id = 'b' and src < 'v39' and dst > src").select(F.lit("circle").alias("graph_id"), F.col("src"), F.col("dst")).where("cast(substr(dst, 2) as int) = cast(substr(src, 2) as int) + 1")
    e = e.select("graph_id", "src", "dst").unionByName(circle).unionByName(spark.createDataFrame([("circle", "v39", "v00")], "graph_id string, src string, dst string"))
    n = n.unionByName(lone).unionByName(n.where("graph_id = 'b'").withColumn("graph_id", F.lit("circle")))
    monkeypatch.setattr(dense, "TASK_PATHS", work)
    got = {r["graph_id"]: r for r in traversal.paths(n, e).collect()}
    comps = graph_components(n, e)
    want = {r["graph_id"]: r["avg_path_length"] for r in traversal._average_path_joined(n, e, comps).collect()}
    assert set(got) == {"a", "b", "circle", "lone"} and all(abs(got[g]["avg_path_length"] - want[g]) < 1e-12 for g in got) and got["circle"]["avg_path_length"] == 20.0
    for g in ("a", "b"):
        score = np.array(brute(40, [(int(r["src"][1:]), int(r["dst"][1:])) for r in e.where(F.col("graph_id") == g).collect()])[0]) / (39 * 38)
        assert abs(got[g]["centrality_variance"] - score.var()) < 1e-12
    assert {r[0]: r[1] for r in traversal.average_path(n, e).collect()} == {g: r["avg_path_length"] for g, r in got.items()}


def graph_components(n, e):
    from quellgraph.operators.graph import components

    return cut(components(n, e))


def test_packed_graphs_are_a_row_each(spark, mixed):
    n, e = mixed
    got = {r["graph_id"]: r for r in dense.packed(n, e, dense.path_graphs(n, e), ("privilege_level",), ("weight",)).collect()}
    for g in "ab":
        own = e.where(F.col("graph_id") == g).select("src", "dst", "weight").collect()
        places = [np.frombuffer(got[g][c], np.int32) for c in ("src", "dst")]
        ids = got[g]["ids"]
        assert ids == sorted(ids) and got[g]["n"] == 40 and set(zip([ids[i] for i in places[0]], [ids[i] for i in places[1]], np.frombuffer(got[g]["weight"]), strict=True)) == {tuple(r) for r in own}


def test_gcn_parts_are_written_one_by_one(spark, mixed, monkeypatch):
    from quellgraph.operators import gcn

    n, e = mixed
    kept, real = [], gcn.written
    monkeypatch.setattr(gcn, "written", lambda df: (kept.append(df.columns[-1]), real(df))[1])
    x = gcn.features(n, e, n.where("node_id = 'v00'"))
    assert kept == ["degree", "betweenness", "clustering"] and x.count() == 80


def test_gcn_in_tasks_as_by_joins(spark, mixed):
    from quellgraph.operators import gcn

    n, e = mixed
    x = cut(gcn.features(n, e, n.where("node_id = 'v00'")))
    w = {k: v.tolist() for k, v in gcn._layers(np.random.default_rng(0), (13, 6, 4, 1)).items()}
    got = lambda f: {tuple(r[:2]): round(r[2], 9) for r in f(x, e, w).collect()}
    assert got(gcn.forward) == got(gcn.forward_joined) and len(got(gcn.forward)) == 80


def test_models_are_written_one_by_one(spark, mixed, monkeypatch):
    n, e = mixed
    s, kept = n.where("node_id = 'v00'").select("graph_id", "node_id"), []
    real = propagation.written
    monkeypatch.setattr(propagation, "written", lambda df: (kept.append(df.columns), real(df))[1])
    got = propagation.run_all(n, e, s, percolation={"n_trials": 4})
    assert len(kept) == 5 and {r[0]: r[1] for r in got.groupBy("model").count().collect()} == dict.fromkeys(propagation.MODELS, 80)
    two = [rows(got.where(F.col("model") == m), "graph_id", "node_id", "risk", "compromised") for m in ("gnn", "graph_traversal")]
    assert two[0] == two[1]


def files(spark):
    """The names of what is written in the shared folder now."""
    from pathlib import Path

    from quellgraph.runtime import shared_dir

    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("written-*")}


def test_weights_by_graph_are_sent_to_the_results(spark, mixed, monkeypatch):
    from quellgraph.operators import ensemble
    from quellgraph.operators.analysis import analyse

    n, e = mixed
    before = files(spark)
    r, w, _ = analyse(n, e, n.where("node_id = 'v00'").select("graph_id", "node_id"), percolation={"n_trials": 4})
    assert len(files(spark) - before) == 5  # the packed graphs are gone
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    both = []
    for most in (ensemble.BROADCAST_ROWS, 0):
        monkeypatch.setattr(ensemble, "BROADCAST_ROWS", most)
        got = ensemble.contributions(r, w)
        assert ("Exchange hashpartitioning" in plan(got)) == (not most)
        both.append([rows(got, "graph_id", "model", "node_id", F.round("weighted", 9)), rows(ensemble.weighted(r, w), "graph_id", "node_id", F.round("risk", 9), "compromised")])
    assert both[0] == both[1] and [len(x) for x in both[0]] == [480, 80]


@pytest.fixture
def analysed(spark, mixed, monkeypatch):
    """The queries over the analysis of the two graphs."""
    from quellgraph.operators.analysis import analyse
    from quellgraph.plans import spread

    n, e = mixed
    s = cut(n.where("node_id = 'v00'").select("graph_id", "node_id"))
    monkeypatch.setattr(spread, "_analysed", lambda *_: (n, e, s, *analyse(n, e, s, percolation={"n_trials": 4})))
    return spread


def test_metrics_leave_nothing_written(spark, analysed):
    from quellgraph.operators import ensemble

    before = files(spark)
    got = analysed.ensemble_metrics(spark, "")
    assert files(spark) == before
    *_, r, _, p = analysed._analysed()
    assert rows(got) == rows(ensemble.metrics(p, ensemble.confidence(r), ensemble.agreement(r))) and got.count() == 2


def test_flags_leave_no_results(spark, analysed):
    from quellgraph.operators import traversal, verification

    before = files(spark)
    n, e, s, f, *_ = analysed.flags_full(spark, "")
    assert len(files(spark) - before) == 3  # prediction, walk, flags
    want = verification.flags(n, analysed._analysed()[5], traversal.gated(n, e, s)[0])
    assert rows(verification.node_class(f)) == rows(verification.node_class(want)) and f.count() == 80


def test_top_scored_edges_keep_only_the_top(spark, mixed):
    from quellgraph.operators import guards

    n, e = mixed
    x = cut(n.where("node_id < 'v30'").select("graph_id", "node_id", (F.substring("node_id", 2, 2).cast("double") / 40).alias("exploitability")))
    before = files(spark)
    got = guards.top_scored(e, x, 7)
    assert len(files(spark) - before) == 1
    assert rows(got) == rows(guards.top_edges(guards.scored_edges(e, x), "score", 7)) and got.count() == 14


def test_guard_set_keeps_only_the_top_written(spark, mixed, monkeypatch):
    from quellgraph.operators import guards
    from quellgraph.operators.traversal import gated

    n, e = mixed
    s = cut(n.where("node_id = 'v00'").select("graph_id", "node_id"))
    x = cut(n.select("graph_id", "node_id", F.lit(0.5).alias("exploitability")))
    seen, steps = gated(n, e, s)
    freed, real = [], guards.free
    monkeypatch.setattr(guards, "free", lambda *a: (freed.append(1), real(*a)))
    before = files(spark)
    got = guards.guard_set(e, x, steps, seen, s, 3)
    assert freed and len(files(spark) - before) == 1
    ends = ["graph_id", "src", "dst"]
    want = rows(guards.top_edges(guards.scored_edges(e, x), "score", 3), *ends) | rows(steps.where("outcome = 'succeeded'"), *ends) | rows(e.join(seen.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi"), *ends)
    assert rows(got) == want


def test_rows_of_a_run_are_made_part_by_part(spark, mixed, monkeypatch):
    from quellgraph.operators import pipeline

    n, e = mixed
    kept, real = [], pipeline.settled
    monkeypatch.setattr(pipeline, "settled", lambda df: (kept.append(df.columns[-1]), real(df))[1])
    r = pipeline.run(n, e, cut(n.where("node_id = 'v00'").select("graph_id", "node_id")), cycles=0, percolation={"n_trials": 4})
    out = r.node_rows()
    assert kept == ["compromised", "exploitability", "z"] and out.count() == 80 and out.where("x is null").count() == 0


def test_layout_has_all_nodes_of_graphs_beyond_a_task(spark, mixed, monkeypatch):
    """The same places, whether a graph goes to its task as rows or as numbers; with loops, a node without edges, and ends that are no nodes."""
    n, e = mixed
    lone = spark.createDataFrame([("a", None, "lone", None), ("c", 0, "only", 0.4)], "graph_id string, ord long, node_id string, privilege_level double")
    n = n.unionByName(lone, allowMissingColumns=True)
    e = e.unionByName(spark.createDataFrame([("a", "v01", "v01", 0.5), ("a", "v02", "nobody", 0.5)], "graph_id string, src string, dst string, weight double"), allowMissingColumns=True)
    want = rows(dense.layout(n, e, rounds=10))
    assert len(want) == 82
    monkeypatch.setattr(dense, "SMALL_NODES", 0)
    assert rows(dense.layout(n, e, rounds=10)) == want


@pytest.mark.parametrize("n", [2, 600])
def test_all_pairs_of_a_layout_repel_at_any_size(monkeypatch, n):
    import pandas as pd

    kernel = {}
    monkeypatch.setattr(dense, "per_graph", lambda n, e, k, *a: kernel.setdefault("k", k))
    dense.layout(None, None, rounds=30)
    rng = np.random.default_rng(4)
    ids = np.array([f"v{i:05d}" for i in range(n)])
    v = pd.DataFrame({"ord": 0, "node_id": ids, "privilege_level": 0.5})
    e = pd.DataFrame({"src": ids[np.r_[np.zeros(n // 4, int), rng.integers(0, n, n)]], "dst": ids[rng.integers(0, n, n + n // 4)], "weight": 0.5})
    monkeypatch.setattr(dense, "PAIR_NODES", n)
    want = kernel["k"](v, e)
    monkeypatch.setattr(dense, "PAIR_NODES", 0)
    pd.testing.assert_frame_equal(kernel["k"](v, e), want)


def test_fingerprints_of_graphs_beyond_a_task_are_whole(spark, mixed, monkeypatch):
    """The spectral gap too; with a loop, a pair stored twice, ends that are no nodes, and graphs of one and two nodes."""
    n, e = mixed
    more = spark.createDataFrame([("c", 0, "only", 0.4), ("d", 0, "x", 0.4), ("d", 1, "y", 0.4)], "graph_id string, ord long, node_id string, privilege_level double")
    n = n.unionByName(more, allowMissingColumns=True)
    twice = e.where("graph_id = 'a'").limit(1).select("graph_id", "src", "dst", "weight")
    odd = spark.createDataFrame([("a", "v01", "v01", 0.5), ("a", "v02", "nobody", 0.5), ("d", "y", "x", 0.5)], "graph_id string, src string, dst string, weight double").unionByName(twice)
    e = cut(e.unionByName(odd, allowMissingColumns=True))
    own = lambda: {tuple(round(x, 7) + 0.0 if isinstance(x, float) else x for x in r) for r in fingerprint.fingerprint(n, e).collect()}
    few = own()
    assert len(few) == 4 and all(None not in r for r in few)
    gaps = {(r[0], r[1], round(r["spectral_gap"], 7)) for kind in ("lower", "avg") for r in dense.spectral_gap(n, e, kind).withColumn("kind", F.lit(kind)).select("graph_id", "kind", "spectral_gap").collect()}
    monkeypatch.setattr(dense, "SMALL_NODES", 0)
    assert own() == few
    assert gaps == {(r[0], r[1], round(r["spectral_gap"], 7)) for kind in ("lower", "avg") for r in dense.spectral_gap(n, e, kind).withColumn("kind", F.lit(kind)).select("graph_id", "kind", "spectral_gap").collect()}


@pytest.mark.parametrize("kind", ["chain", "two alike", "random"])
def test_gaps_do_not_depend_on_the_number_of_nodes(monkeypatch, kind):
    """All eigenvalues, or the largest two by iteration, which goes on until they are found."""
    import pandas as pd

    n, rng = 1_200, np.random.default_rng(8)
    a, b = (np.arange(n - 1), np.arange(1, n)) if kind == "chain" else rng.integers(0, n // 2 if kind == "two alike" else n, (2, 2_000))
    w = np.ones(len(a)) if kind == "chain" else rng.random(len(a))
    if kind == "two alike":
        a, b, w = np.r_[a, a + n // 2], np.r_[b, b + n // 2], np.r_[w, w]
    ids = np.array([f"v{i:05d}" for i in range(n)])
    graph = dense.Sparse(pd.DataFrame({"ord": 0, "node_id": ids}), pd.DataFrame({"src": ids[b], "dst": ids[a], "weight": w}))
    want = graph.gap("lower")
    monkeypatch.setattr(dense, "EIGEN_NODES", 0)
    assert abs(graph.gap("lower") - want) < 1e-7
