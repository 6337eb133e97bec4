"""Everything from a graph to its reports, for all graphs of the tables at once: analysis, verification, containment, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.operators import ensemble, guards, traversal, verification
from quellgraph.operators.analysis import analyse
from quellgraph.operators.dense import layout
from quellgraph.runtime import cut, free, settled
from quellgraph.schema import EDGES, NODES, conform

FUSION = ("weighted", "voting")


def fuse(mode: str, results: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """``(graph_id, node_id, risk, compromised)`` by the fusion of that name."""
    if mode not in FUSION:
        raise ValueError(f"unknown fusion {mode}; known: {', '.join(FUSION)}")
    return ensemble.weighted(results, weights, **options) if mode == "weighted" else ensemble.voting(results, **options)


@dataclass
class Run:
    """What a run gives, a table each."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    weights: DataFrame
    results: DataFrame
    prediction: DataFrame
    flags: DataFrame
    visited: DataFrame
    steps: DataFrame
    contained: dict[str, DataFrame]

    def report(self) -> DataFrame:
        """One row per graph: topology, where its weights come from, blast radius, token statistics, containment."""
        of = self.weights.select("graph_id", "topology_type", F.col("source").alias("weight_source")).distinct()
        tokens = self.steps.groupBy("graph_id").agg(
            F.count("*").alias("tokens"), F.count_if(F.col("outcome") == "succeeded").alias("tokens_valid"), F.count_if(F.col("outcome") != "succeeded").alias("tokens_rejected"), F.max(F.when(F.col("outcome") == "succeeded", F.col("level") + 1)).alias("max_depth")
        )
        out = verification.blast_radius(self.flags).join(of, "graph_id", "left").join(tokens, "graph_id", "left").join(self.contained["metrics"].withColumnRenamed("missed", "missed_after"), "graph_id", "left")
        return out.fillna(0, ["tokens", "tokens_valid", "tokens_rejected", "max_depth"])

    def node_rows(self) -> DataFrame:
        """The analysis file's 11 columns, and the graph."""
        place = settled(layout(self.nodes, self.edges)).withColumnsRenamed({"x": "_x", "y": "_y", "z": "_z"})
        state = verification.visual_state(self.flags).join(self.prediction.select("graph_id", "node_id", F.col("risk").alias("_risk")), ["graph_id", "node_id"], "left")
        j = state.join(place, ["graph_id", "node_id"], "left")
        shown = F.when(F.col("in_vbr"), 1.0).otherwise(F.coalesce("_risk", F.lit(0.0)))
        return j.select(
            "graph_id", "node_id", "type", "privilege_level", F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), F.round(shown, 4).alias("risk_score"), "state", "in_pbr", "in_vbr", F.round("risk_score", 4).alias("exploitability_score")
        )

    def edge_rows(self) -> DataFrame:
        """Each edge with whether it is blocked, and else whether a token passed it."""
        on = ["graph_id", "src", "dst"]
        flag = lambda df, name: df.select(*on).distinct().withColumn(name, F.lit(True))
        j = self.edges.join(flag(guards.blocked(self.contained["edges"]), "_b"), on, "left").join(flag(self.steps.where("outcome = 'succeeded'"), "_s"), on, "left")
        return j.select(*on, "edge_type", "weight", F.when(F.col("_b"), "blocked").when(F.col("_s"), "critical").otherwise("normal").alias("state"))

    def export(self, base: str) -> None:
        """The files of a run under ``base``: nodes and edges with their states, the verification table of 7 columns, a row per graph, deny
        policies."""
        from quellgraph.sources.state import export_csv, export_json

        export_csv(self.node_rows(), f"{base}/analysis")
        export_csv(verification.node_class(self.flags), f"{base}/verification")
        export_json(self.edge_rows(), f"{base}/edges")
        export_json(self.report(), f"{base}/report")
        export_json(guards.deny_policies(guards.blocked(self.contained["edges"])), f"{base}/policies")


def run(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, history: DataFrame | None = None, *, max_depth: int = 6, cycles: int = 5, random_seed: int = 42, fusion: str = "weighted", **options: dict) -> Run:
    """Analysis with weights by each graph's topology, token traversal with conditions, blast radius, guards and the feedback loop, which
    analyses again in every cycle. Graphs without nodes have no rows anywhere."""
    nodes, edges = conform(nodes, NODES), conform(edges, EDGES)
    results, weights, _ = analyse(nodes, edges, seeds, history, **options)
    prediction = settled(fuse(fusion, results, weights))
    visited, steps = traversal.gated(nodes, edges, seeds, max_depth, True, random_seed)
    free(nodes.sparkSession)
    flags = settled(verification.flags(nodes, prediction, visited))

    def again(n: DataFrame, e: DataFrame, s: DataFrame) -> DataFrame:
        r, w, _ = analyse(n, e, s, history, **options)
        return fuse(fusion, r, w)

    contained = guards.contain(nodes, edges, seeds, flags, again, traversal.bfs(edges, seeds), cycles, max_depth)
    return Run(nodes, edges, seeds, weights, results, prediction, flags, visited, steps, contained)


def all_topologies(spark: SparkSession, n: int = 30, seeds: tuple[int, ...] = (42,), **how) -> Run:
    """One run over graphs of all archetypes, each from its first node with an edge out of it."""
    from functools import reduce

    from quellgraph.operators.evaluation import first_with_edges
    from quellgraph.sources import simulate

    parts = [simulate.generate(spark, kind, n, seeds) for kind in simulate.TOPOLOGIES]
    nodes, edges = (cut(reduce(DataFrame.unionByName, [p[i] for p in parts])) for i in (0, 1))
    return run(nodes, edges, cut(first_with_edges(edges)), **how)


def inspect(run_: Run, graph_id: str, node_id: str) -> DataFrame:
    """One row on a node: type, state, privilege, risk, exploitability, flags, numbers of edges by direction and kind; no row if there is none."""
    here = lambda c: (F.col("graph_id") == graph_id) & (F.col(c) == node_id)
    count = lambda end, name: run_.edges.where(here(end)).groupBy("edge_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("edge_type", "n"))).alias(name))
    risk = run_.prediction.where(here("node_id")).select("node_id", F.round("risk", 4).alias("risk"))
    state = verification.visual_state(run_.flags.where(here("node_id"))).withColumnRenamed("risk_score", "exploitability")
    flagged: Column = F.col("state").isin("compromised", "critical_miss")
    return state.join(risk, "node_id", "left").withColumn("compromised", flagged).crossJoin(count("src", "out_edges")).crossJoin(count("dst", "in_edges"))  # one row each
