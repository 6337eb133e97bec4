"""Sweeps, baselines and their statistics: parameter grids as keys, results as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import place_within


def tag_graphs(df: DataFrame, label: str) -> DataFrame:
    """The same graphs again under another id, to run several variants in one pass."""
    return df.withColumn("graph_id", F.concat_ws("@", "graph_id", F.lit(label)))


def pick_seeds(nodes: DataFrame, types: tuple[str, ...] = ("SERVICE",)) -> DataFrame:
    """The node of least privilege among ``types`` in each graph, else of all; the first among equals."""
    best = lambda d: d.groupBy("graph_id").agg(F.min_by("node_id", F.struct("privilege_level", "ord", "node_id")).alias("node_id"))
    some = best(nodes.where(F.col("node_type").isin(*types)))
    return some.unionByName(best(nodes.join(some, "graph_id", "left_anti")))


def first_with_edges(edges: DataFrame) -> DataFrame:
    """The first node by id that has an edge out of it."""
    return edges.groupBy("graph_id").agg(F.min("src").alias("node_id"))


def nth_node(nodes: DataFrame, index: int) -> DataFrame:
    """The node at ``index`` modulo the size of its graph, in the order of ids."""
    placed = place_within(nodes.select("graph_id", "node_id"), "graph_id", ["node_id"])
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    return placed.join(n, "graph_id").where(F.col("i") == F.lit(index) % F.col("_n")).select("graph_id", "node_id")


def compare_mutation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per graph, from blast_radius rows before and after (after: with strategy, intensity): how much the gap moved, whether the
    attack stayed possible, whether it evaded, and robustness."""
    a = after.alias("a").join(before.alias("b"), F.expr("a.graph_id = b.graph_id"))
    move = F.round(F.col("a.exploitability_gap") - F.col("b.exploitability_gap"), 6)
    kept = F.col("a.vbr_size") >= 0.8 * F.col("b.vbr_size")
    return a.select(
        "a.graph_id", "a.strategy", "a.intensity", move.alias("evasion_improvement"), kept.alias("reachability_preserved"), (kept & (move > 0.1)).alias("evaded"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - move)).alias("robustness")
    )


def robustness(results: DataFrame) -> DataFrame:
    """One row: mean robustness (1 without results), the strategy and topology with the largest mean improvement."""
    worst = lambda c: results.groupBy(c).agg(F.avg("evasion_improvement").alias("m")).agg(F.max_by(c, F.struct(F.round("m", 9), -F.ascii(c))).alias(c))
    total = results.agg(F.round(F.coalesce(F.avg("robustness"), F.lit(1.0)), 4).alias("overall_robustness"))
    return total.select("overall_robustness", worst("strategy").scalar().alias("most_effective_strategy"), worst("topology").scalar().alias("most_vulnerable_topology"))


def sweep_stats(records: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, population deviation, smallest and largest value, count. A sweep has as many rows as points."""
    return records.groupBy(*by).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_pop(metric), F.lit(0.0)).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(metric).alias("n"))


def calibration(scores: DataFrame, stated: DataFrame) -> DataFrame:
    """Means per (model, topology) and per model (null topology) in one pass of grouping sets, against the stated confidence."""
    g = scores.groupingSets([["model", "topology"], ["model"]], "model", "topology").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("n"))
    j = g.join(F.broadcast(stated), "model", "left")
    return j.withColumn("error", F.abs(F.col("confidence") - F.col("f1"))).withColumn("calibrated", F.col("error") < 0.05)


def complexity(timings: DataFrame, by: list[str] = ()) -> DataFrame:
    """The slope of log time on log size, and its label."""
    g = timings.groupBy(*by).agg(F.regr_slope(F.log("total_ms"), F.log("n")).alias("slope"))
    s = F.col("slope")
    return g.withColumn("label", F.when(s < 1.1, "O(n)").when(s < 1.25, "O(n log n)").when(s < 1.75, "O(n^1.5)").otherwise("O(n^2)"))


def largest_under(timings: DataFrame, ms: float) -> DataFrame:
    return timings.agg(F.coalesce(F.max(F.when(F.col("total_ms") < ms, F.col("n"))), F.lit(0)).alias("max_n"))


def bottleneck(stages: DataFrame) -> DataFrame:
    """The stage with the largest mean time of (stage, ms)."""
    return stages.groupBy("stage").agg(F.avg("ms").alias("ms")).agg(F.max_by("stage", "ms").alias("stage"))


def naive(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kind: str) -> DataFrame:
    """Baselines: every node, the seeds, or the seeds and their successors."""
    s = seeds.select("graph_id", "node_id")
    if kind == "all":
        return nodes.select("graph_id", "node_id")
    if kind == "seed":
        return s
    hop = edges.join(s.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("node_id"))
    return s.unionByName(hop).distinct()


def false_guards(guards: DataFrame, verified: DataFrame) -> DataFrame:
    """The share of guards that no verified edge needs."""
    on = ["graph_id", "src", "dst"]
    g = guards.select(*on).distinct().join(verified.select(*on).distinct().withColumn("_v", F.lit(1)), on, "left")
    return g.groupBy("graph_id").agg((F.sum(F.when(F.col("_v").isNull(), 1).otherwise(0)) / F.greatest(F.lit(1), F.count("*"))).alias("fp_rate"))
