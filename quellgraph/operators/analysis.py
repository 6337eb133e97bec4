"""The whole analysis of each graph: fingerprint, weights by its topology, all models, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.operators import ensemble, propagation
from quellgraph.operators.fingerprint import fingerprint
from quellgraph.runtime import cut, scratch


def graph_weights(fingerprints: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``(graph_id, topology_type, model, weight, source)``: adaptive weights for the graph's topology where the history is long
    enough, else that topology's prior, over its sum."""
    prior = ensemble.normalised(ensemble.priors(fingerprints.sparkSession)).withColumn("source", F.lit("topology_prior"))
    if history is not None:
        own = cut(ensemble.adaptive(history))  # a few rows per topology
        prior = own.withColumn("source", F.lit("adaptive")).unionByName(prior.join(own.select("topology_type").distinct(), "topology_type", "left_anti"))
    return fingerprints.select("graph_id", "topology_type").join(F.broadcast(prior), "topology_type").select("graph_id", "topology_type", "model", "weight", "source")


def analyse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, history: DataFrame | None = None, **options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results, weights, prediction)`` of every graph, the results and weights kept; ``options`` by model name."""
    with scratch(nodes.sparkSession):
        weights = cut(graph_weights(fingerprint(nodes, edges), history))
    results = propagation.run_all(nodes, edges, seeds, **options)
    return results, weights, ensemble.weighted(results, weights)
