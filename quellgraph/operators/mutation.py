"""Rewriting graphs as an adversary would: each mutation is a sample, an anti-join and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions.rng import draw_order, unit
from quellgraph.runtime import place_within
from quellgraph.schema import EDGES, NODES, conform

STRATEGIES = ("EDGE_SPLITTING", "PRIVILEGE_DILUTION", "CHAIN_OBFUSCATION")


def high_risk(edges: DataFrame, scores: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """Edges with an end above the threshold; by their weight where there are no scores."""
    if scores is None:
        return edges.where(F.col("weight") > threshold)
    s = scores.select("graph_id", "node_id", "exploitability")
    j = edges.join(s.select("graph_id", F.col("node_id").alias("src"), F.col("exploitability").alias("_a")), ["graph_id", "src"], "left").join(s.select("graph_id", F.col("node_id").alias("dst"), F.col("exploitability").alias("_b")), ["graph_id", "dst"], "left")
    return j.where(F.coalesce(F.greatest("_a", "_b"), F.lit(0.0)) > threshold).select(*edges.columns)


def service_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = nodes.where("node_type = 'SERVICE'").select("graph_id", "node_id")
    return edges.join(s.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(s.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi").select(*edges.columns)


def sample_share(edges: DataFrame, intensity: float, seed: int) -> DataFrame:
    """A random ``round(n * intensity)`` edges of each graph, numbered."""
    n = edges.groupBy("graph_id").agg(F.round(F.count("*") * intensity).alias("_k"))
    drawn = edges.withColumn("_d", draw_order(seed, "graph_id", "src", "dst"))
    return place_within(drawn, "graph_id", ["_d"], "_i").join(n, "graph_id").where(F.col("_i") < F.col("_k")).drop("_k", "_d")


def _through(nodes: DataFrame, edges: DataFrame, picked: DataFrame, mid_id, node: dict, first: str, second: str, factor: float) -> tuple[DataFrame, DataFrame]:
    """``picked`` edges replaced by two through a new node, each with ``factor`` of the weight and the same depth limit."""
    p = picked.withColumn("_m", mid_id)
    new = conform(p.select("graph_id", F.col("_m").alias("node_id"), *[F.lit(v).alias(k) for k, v in node.items()]), NODES)
    w = F.round(F.col("weight") * factor, 4)
    hop = lambda a, b, kind: conform(p.select("graph_id", F.col(a).alias("src"), F.col(b).alias("dst"), F.concat_ws("->", a, b).alias("edge_id"), F.lit(kind).alias("edge_type"), w.alias("weight"), "delegation_depth_limit", "ord"), EDGES)
    kept = edges.join(picked, ["graph_id", "src", "dst"], "left_anti")
    return conform(nodes, NODES).unionByName(new), conform(kept, EDGES).unionByName(hop("src", "_m", first)).unionByName(hop("_m", "dst", second))


def split_edges(nodes: DataFrame, edges: DataFrame, intensity: float = 0.3, seed: int = 42, scores: DataFrame | None = None, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    picked = sample_share(high_risk(edges, scores, threshold), intensity, seed)
    return _through(nodes, edges, picked, F.concat_ws("_", F.lit("wp"), "src", "dst", "_i"), {"node_type": "WORKLOAD", "name": "wl", "privilege_level": 0.1, "sensitivity": 0.1}, "AUTHENTICATE_AS", "AUTHENTICATE_AS", 0.6)


def obfuscate_chains(nodes: DataFrame, edges: DataFrame, intensity: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    picked = sample_share(service_edges(nodes, edges), intensity, seed)
    return _through(nodes, edges, picked, F.concat_ws("_", F.lit("obf_role"), "_i", "src"), {"node_type": "ROLE", "name": "obf-role", "privilege_level": 0.4, "sensitivity": 0.3}, "ASSUME_ROLE", "TOKEN_MINT", 0.9)


def dilute(nodes: DataFrame, edges: DataFrame, intensity: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``int(10 * intensity)`` decoys per graph, each pointing at a random node of privilege .5 or more, or any if there is none."""
    count = int(intensity * 10)
    if not count:
        return conform(nodes, NODES), conform(edges, EDGES)
    strong = nodes.where("privilege_level >= 0.5").select("graph_id", "node_id")
    pool = strong.unionByName(nodes.select("graph_id", "node_id").join(strong, "graph_id", "left_anti"))
    pool = pool.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # The node with the smallest draw is a uniform pick, found by a min per decoy.
    pick = pool.groupBy("graph_id", "_d").agg(F.min_by("node_id", draw_order(seed, "graph_id", F.col("_d"), F.col("node_id"))).alias("dst"))
    decoy = F.concat_ws("_", F.lit("decoy"), "_d", F.floor(unit(seed, "graph_id", F.col("_d")) * 10000))
    p = pick.withColumn("src", decoy)
    new = conform(p.select("graph_id", F.col("src").alias("node_id"), F.lit("SERVICE").alias("node_type"), F.concat_ws("-", F.lit("decoy-svc"), "_d").alias("name"), F.lit(0.1).alias("privilege_level"), F.lit(0.1).alias("sensitivity")), NODES)
    e = conform(p.select("graph_id", "src", "dst", F.concat_ws("->", "src", "dst").alias("edge_id"), F.lit("TOKEN_MINT").alias("edge_type"), F.lit(0.15).alias("weight"), F.lit(1).alias("delegation_depth_limit")), EDGES)
    return conform(nodes, NODES).unionByName(new), conform(edges, EDGES).unionByName(e)


def mutate(nodes: DataFrame, edges: DataFrame, strategy: str, intensity: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    return {"EDGE_SPLITTING": split_edges, "PRIVILEGE_DILUTION": dilute, "CHAIN_OBFUSCATION": obfuscate_chains}[strategy](nodes, edges, intensity, seed)
