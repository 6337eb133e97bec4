"""Predicted against verified blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellgraph.operators.traversal import paths_to


def flags(nodes: DataFrame, predicted: DataFrame, verified: DataFrame) -> DataFrame:
    """``(graph_id, node_id, node_type, privilege_level, in_pbr, in_vbr, exploitability)`` of every node.

    ``predicted`` is (graph_id, node_id, risk, compromised), ``verified`` (graph_id, node_id). Exploitability is 1 where verified,
    0.3 of the risk where only predicted."""
    p = predicted.select("graph_id", "node_id", "risk", "compromised")
    v = verified.select("graph_id", "node_id").distinct().withColumn("_v", F.lit(True))
    j = nodes.select("graph_id", "node_id", "node_type", "privilege_level").join(p, ["graph_id", "node_id"], "left").join(v, ["graph_id", "node_id"], "left")
    return j.select("graph_id", "node_id", "node_type", "privilege_level", F.coalesce("compromised", F.lit(False)).alias("in_pbr"), F.coalesce("_v", F.lit(False)).alias("in_vbr"), F.when(F.col("_v"), 1.0).when(F.col("compromised"), 0.3 * F.col("risk")).otherwise(0.0).alias("exploitability"))


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def blast_radius(f: DataFrame) -> DataFrame:
    """One row per graph: sizes, gap, missed nodes, gap fraction, 1 - Jaccard, class; rounded to 6 places."""
    p, v = F.col("in_pbr"), F.col("in_vbr")
    g = f.groupBy("graph_id").agg(_n(p).alias("pbr_size"), _n(v).alias("vbr_size"), _n(p & ~v).alias("gap_size"), _n(v & ~p).alias("missed"), _n(p & v).alias("both"), _n(p | v).alias("either"))
    gap = F.when(F.col("pbr_size") > 0, F.col("gap_size") / F.col("pbr_size")).otherwise(0.0)
    egd = F.when(F.col("either") > 0, 1 - F.col("both") / F.col("either")).otherwise(0.0)
    kind = F.when(F.col("missed") > 0, "CRITICAL_MISS").when(gap < 0.1, "CALIBRATED").when(gap < 0.4, "OVER_PREDICTED").otherwise("UNDER_PREDICTED")
    return g.select("graph_id", "pbr_size", "vbr_size", "gap_size", "missed", F.round(gap, 6).alias("gap_fraction"), F.round(egd, 6).alias("exploitability_gap"), kind.alias("classification"))


def node_class(f: DataFrame) -> DataFrame:
    """The report's class of each node. Verified nodes without a prediction are misses; ``MISSED`` can't occur."""
    p, v = F.col("in_pbr"), F.col("in_vbr")
    kind = F.when(v & ~p, "CRITICAL_MISS").when(p & v, "VERIFIED").when(p, "GAP").otherwise("SAFE")
    return f.select("graph_id", "node_id", F.col("node_type").alias("type"), F.round("privilege_level", 3).alias("privilege"), "in_pbr", "in_vbr", F.round("exploitability", 4).alias("exploitability_score"), kind.alias("gap_classification"))


def visual_state(f: DataFrame) -> DataFrame:
    p, v = F.col("in_pbr"), F.col("in_vbr")
    state = F.when(p & v, "compromised").when(v, "critical_miss").when(p, "predicted_only").when(F.col("exploitability") > 0, "contained").otherwise("safe")
    return f.select("graph_id", "node_id", F.col("node_type").alias("type"), "privilege_level", "in_pbr", "in_vbr", F.col("exploitability").alias("risk_score"), state.alias("state"))


def critical_paths(f: DataFrame, steps: DataFrame, privilege: float = 0.8) -> DataFrame:
    """Paths from a seed to every verified node of high privilege."""
    return paths_to(steps, f.where(F.col("in_vbr") & (F.col("privilege_level") >= privilege)))


def across_topologies(analyses: DataFrame) -> DataFrame:
    """One row over (topology, gap_fraction, classification): mean gap, best and worst topology (the first by name among equals), misses."""
    k = F.struct("gap_fraction", "topology")
    return analyses.agg(
        F.round(F.avg("gap_fraction"), 4).alias("mean_gap"), F.min_by("topology", k).alias("best_topology"), F.max_by("topology", F.struct("gap_fraction", -F.xxhash64("topology"))).alias("worst_topology"),
        F.sum(F.when(F.col("classification") == "CRITICAL_MISS", 1).otherwise(0)).alias("critical_misses"),
    )


def summary_text(blast: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """``(graph_id, summary)``: one paragraph on each graph."""
    j = blast.join(n_nodes, "graph_id")
    miss = F.when(F.col("missed") > 0, F.format_string(" CRITICAL: %d node(s) verified reachable but NOT predicted by ensemble.", "missed")).otherwise(F.lit(" No critical misses detected."))
    text = F.format_string(
        "Of %d nodes, ensemble predicted %d compromised (PBR=%d). Controlled traversal verified %d were reachable (VBR=%d). ExploitabilityGap=%d (%.1f%%), classified as %s.",
        "n_nodes", "pbr_size", "pbr_size", "vbr_size", "vbr_size", "gap_size", F.col("gap_fraction") * 100, F.regexp_replace(F.initcap(F.regexp_replace("classification", "_", " ")), " ", "-"),
    )
    return j.select("graph_id", F.concat(text, miss).alias("summary"))


def prf(pairs: DataFrame, by: list[str], empty: str = "tracker") -> DataFrame:
    """Precision, recall and F1 of sets given as (*by, predicted, actual) flags per element, with the counts.

    ``tracker``: both empty is 1, 1, 1, one empty 0, 0, 0. ``calibration``: nothing predicted is 1, 0, 0, no truth 0, 1, 0.
    """
    p, a = F.col("predicted"), F.col("actual")
    g = pairs.groupBy(*by).agg(_n(p & a).alias("tp"), _n(p & ~a).alias("fp"), _n(a & ~p).alias("fn"))
    no_p, no_a = F.col("tp") + F.col("fp") == 0, F.col("tp") + F.col("fn") == 0
    if empty == "tracker":
        edge = lambda c, *_: F.when(no_p & no_a, 1.0).when(no_p | no_a, 0.0).otherwise(c)
    else:
        edge = lambda c, x, y: F.when(no_p, x).when(no_a, y).otherwise(c)
    tp = F.col("tp").cast("double")
    out = g.select(*by, "tp", "fp", "fn", edge(tp / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 1.0, 0.0).alias("precision"), edge(tp / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 0.0, 1.0).alias("recall"))
    s = F.col("precision") + F.col("recall")
    harmonic = F.when(s > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(s, F.lit(0.0))).otherwise(0.0)
    return out.withColumn("f1", harmonic if empty == "tracker" else F.when((F.col("tp") == 0), 0.0).otherwise(harmonic))


def iou(pairs: DataFrame, by: list[str]) -> DataFrame:
    p, a = F.col("predicted"), F.col("actual")
    g = pairs.groupBy(*by).agg(_n(p & a).alias("_i"), _n(p | a).alias("_u"))
    return g.select(*by, F.when(F.col("_u") == 0, 1.0).otherwise(F.col("_i") / F.col("_u")).alias("iou"))
