"""The structural fingerprint of each graph, and the topology that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellgraph.operators import dense
from quellgraph.operators.graph import clustering_joined, degree_entropy, density
from quellgraph.operators.traversal import paths
from quellgraph.runtime import cut, free, written


def topology(avg_path: Column, clustering_: Column, centrality_variance: Column, density_: Column, n: Column) -> Column:
    """Long paths without triangles are a chain; uneven betweenness makes a hub; dense triangles a cluster; else mixed."""
    return (
        F.when((avg_path > 4) & (clustering_ < 1e-9), "CHAIN").when((centrality_variance * n > 0.05) & (clustering_ < 0.3), "HUB")
        .when((clustering_ > 0.4) & (density_ > 0.15), "DENSE_CLUSTER").otherwise("MIXED")
    )


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph, of any size. Edges count once per ordered pair, and with both ends among the nodes; paths pass all."""
    fit = cut(dense.small_graphs(nodes, edges))
    base = dense.structure(nodes, edges, fit)
    big = nodes.join(fit, "graph_id", "left_anti")
    if big.take(1):
        e = edges.join(fit, "graph_id", "left_anti").dropDuplicates(["graph_id", "src", "dst"])
        for end in ("src", "dst"):
            e = e.join(big.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
        e = written(e.select("graph_id", "src", "dst", "weight"))
        some = big.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
        cc = clustering_joined(big, e).groupBy("graph_id").agg(F.avg("clustering").alias("clustering"))
        for part in (degree_entropy(big, e), density(big, e), cc, dense.spectral_gap(big, e, fit=fit)):
            some = some.join(part, "graph_id", "left")
        base = base.unionByName(some)
    base = cut(base)  # a row per graph; its shuffles aren't kept while paths are counted
    free(nodes.sparkSession)
    out = base.join(paths(nodes, edges), "graph_id", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("degree_entropy", "density", "clustering", "centrality_variance", "avg_path_length")]
    out = out.select("graph_id", "n_nodes", *zero, "spectral_gap")
    return out.withColumn("topology_type", topology(F.col("avg_path_length"), F.col("clustering"), F.col("centrality_variance"), F.col("density"), F.col("n_nodes")))
