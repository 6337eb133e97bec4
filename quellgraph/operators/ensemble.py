"""Fusing the models' results into one prediction, with weights by topology or by past accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellgraph.runtime import top_within
from quellgraph.schema import MODELS, TOPOLOGIES

# Prior weights by topology, in the order of MODELS.
PRIORS = {
    "HUB": (0.411, 0.0632, 0.0632, 0.2994, 0.0632, 0.1),
    "CHAIN": (0.3256, 0.0354, 0.0354, 0.2182, 0.0354, 0.35),
    "DENSE_CLUSTER": (0.4, 0.12, 0.06, 0.28, 0.02, 0.12),
    "MIXED": (0.5, 0.1, 0.05, 0.12, 0.03, 0.2),
}
# The decision threshold of every topology.
THRESHOLD = 0.35
# Recommended weights by topology of the fingerprint, in this order of models.
HINT_MODELS = ("graph_traversal", "epidemic", "spectral", "percolation", "control_system")
HINTS = {"HUB": (0.1, 0.1, 0.5, 0.2, 0.1), "CHAIN": (0.15, 0.45, 0.1, 0.1, 0.2), "DENSE_CLUSTER": (0.1, 0.15, 0.15, 0.5, 0.1), "MIXED": (0.2, 0.2, 0.2, 0.2, 0.2)}


def _table(spark: SparkSession, values: dict, models: tuple) -> DataFrame:
    return spark.createDataFrame([(t, m, float(w)) for t, ws in values.items() for m, w in zip(models, ws, strict=True)], "topology_type string, model string, weight double")


def priors(spark: SparkSession) -> DataFrame:
    return _table(spark, PRIORS, MODELS)


def hints(spark: SparkSession) -> DataFrame:
    return _table(spark, HINTS, HINT_MODELS)


def uniform(spark: SparkSession) -> DataFrame:
    return _table(spark, {t: (1 / len(MODELS),) * len(MODELS) for t in TOPOLOGIES}, MODELS)


def normalised(weights: DataFrame, by: str = "topology_type") -> DataFrame:
    """Weights over their sum; equal ones where the sum is 0. A topology has as many rows as there are models."""
    w = Window.partitionBy(by)
    total = F.sum("weight").over(w)
    return weights.withColumn("weight", F.when(total == 0, 1.0 / F.count("*").over(w)).otherwise(F.col("weight") / total))


def invalid(weights: DataFrame, by: str = "topology_type") -> DataFrame:
    """The topologies whose weights don't add up to 1."""
    return weights.groupBy(by).agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > 1e-6)


#: Weights by graph up to which they are sent to the results, which needn't be shuffled by graph then.
BROADCAST_ROWS = 200_000


def _with_weight(results: DataFrame, weights: DataFrame) -> DataFrame:
    """``results`` with ``weight``, null for a model without one."""
    on = ["graph_id", "model"] if "graph_id" in weights.columns else ["model"]
    w = weights.select(*on, "weight")
    few = on == ["model"] or w.count() <= BROADCAST_ROWS
    return results.join(F.broadcast(w) if few else w, on, "left")


def weighted(results: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(graph_id, node_id, risk, compromised)``: the weighted sum of the models' risks, a model without weight counting 0.

    ``weights`` is (model, weight), or (graph_id, model, weight) for weights by graph; a few rows per graph.
    """
    r = _with_weight(results, weights).groupBy("graph_id", "node_id").agg(F.sum(F.col("risk") * F.coalesce("weight", F.lit(0.0))).alias("risk"))
    return r.withColumn("risk", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "risk"))).withColumn("compromised", F.round("risk", 9) >= threshold)


def voting(results: DataFrame, n_models: int = len(MODELS), threshold: float = 0.6) -> DataFrame:
    """``(graph_id, node_id, risk, compromised)``: the share of models that flag the node."""
    v = results.groupBy("graph_id", "node_id").agg(F.sum(F.col("compromised").cast("int")).alias("votes"))
    return v.select("graph_id", "node_id", (F.col("votes") / n_models).alias("risk"), (F.col("votes") >= threshold * n_models).alias("compromised"))


def confidence(results: DataFrame, n_models: int = len(MODELS), uncertain: float = 0.25) -> DataFrame:
    """``(graph_id, node_id, mean, std, lo, hi, uncertain)``: mean and 1.96 population deviations over all models, a model without
    a row counting 0."""
    s = results.groupBy("graph_id", "node_id").agg((F.sum("risk") / n_models).alias("mean"), (F.sum(F.col("risk") * F.col("risk")) / n_models).alias("_q"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("mean") * F.col("mean")))
    clip = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4)
    return s.select("graph_id", "node_id", "mean", std.alias("std"), clip(F.col("mean") - 1.96 * std).alias("lo"), clip(F.col("mean") + 1.96 * std).alias("hi"), (F.round(std, 9) > uncertain).alias("uncertain"))


def contributions(results: DataFrame, weights: DataFrame) -> DataFrame:
    """``(graph_id, model, node_id, risk, weight, weighted)``; ``weights`` as of :func:`weighted`."""
    j = _with_weight(results, weights).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return j.select("graph_id", "model", "node_id", "risk", "weight", (F.col("risk") * F.col("weight")).alias("weighted"))


def agreement(results: DataFrame) -> DataFrame:
    """Per graph: union, intersection and Jaccard of the flagged sets (1 if nothing is flagged)."""
    n = results.select("model").distinct().count()
    c = results.where("compromised").groupBy("graph_id", "node_id").agg(F.count("*").alias("c"))
    g = c.groupBy("graph_id").agg(F.count("*").alias("n_union"), F.sum(F.when(F.col("c") == n, 1).otherwise(0)).alias("n_intersection"))
    g = results.select("graph_id").distinct().join(g, "graph_id", "left").fillna(0)
    return g.withColumn("jaccard", F.when(F.col("n_union") == 0, 1.0).otherwise(F.col("n_intersection") / F.col("n_union")))


def consensus_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("graph_id", "node_id").agg(F.sum(F.col("compromised").cast("int")).alias("consensus"), F.avg("risk").alias("avg_risk"))


def most_dangerous(results: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nodes of each graph flagged by most models, then by mean risk."""
    return top_within(consensus_counts(results), ["graph_id"], [F.desc("consensus"), F.desc(F.round("avg_risk", 9)), "node_id"], k)


def cascade_spread(headers: DataFrame) -> DataFrame:
    """Mean and population deviation of the models' cascade probabilities."""
    return headers.groupBy("graph_id").agg(F.avg("cascade_probability").alias("mean_cascade"), F.coalesce(F.stddev_pop("cascade_probability"), F.lit(0.0)).alias("std_cascade"))


def recent(history: DataFrame, n: int, at: str = "id", by: tuple[str, ...] = ("topology_type", "model_name")) -> DataFrame:
    """The last ``n`` rows of each key. A key is first cut to n rows in each of 64 salted parts, then over all."""
    kept = history.where(F.col("f1_score").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*by, F.pmod(F.xxhash64(at), F.lit(64))).orderBy(F.desc(at)))).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("recency", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))).where(F.col("recency") <= n)


def adaptive(history: DataFrame, last: int = 20, min_history: int = 5, models: tuple[str, ...] = MODELS) -> DataFrame:
    """``(topology_type, model, weight)``: mean F1 of each model's last rows over their sum; no rows for a topology where a model has
    fewer than ``min_history``."""
    known = history.where(F.col("topology_type").isNotNull() & F.col("model_name").isin(*models))
    m = recent(known, last).groupBy("topology_type", "model_name").agg(F.avg("f1_score").alias("weight"), F.count("*").alias("n"))
    full = m.groupBy("topology_type").agg(F.count("*").alias("k"), F.min("n").alias("least")).where((F.col("k") == len(models)) & (F.col("least") >= min_history))
    return normalised(m.join(full, "topology_type", "left_semi").select("topology_type", F.col("model_name").alias("model"), "weight"))


def metrics(prediction: DataFrame, conf: DataFrame, agree: DataFrame) -> DataFrame:
    """Per graph: size of the blast radius, mean risk in it, share of uncertain nodes in it, Jaccard; rounded to 4 places."""
    j = prediction.join(conf.select("graph_id", "node_id", "uncertain"), ["graph_id", "node_id"])
    c = F.col("compromised")
    g = j.groupBy("graph_id").agg(
        F.sum(c.cast("int")).alias("blast_radius"), F.count("*").alias("n_nodes"), F.avg(F.when(c, F.col("risk"))).alias("_r"), F.avg(F.when(c, F.col("uncertain").cast("double"))).alias("_u")
    )
    return g.join(agree.select("graph_id", "jaccard"), "graph_id").select(
        "graph_id", "blast_radius", "n_nodes", F.round(F.coalesce("_r", F.lit(0.0)), 4).alias("mean_risk"), F.round(F.coalesce("_u", F.lit(0.0)), 4).alias("uncertain_share"), F.round("jaccard", 4).alias("jaccard")
    )
