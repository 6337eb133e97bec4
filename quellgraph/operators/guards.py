"""Choosing edges to guard, deciding on tokens, and containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellgraph.functions.rng import draw_order
from quellgraph.functions.tokens import anomaly_score, consensus, guard_decision, strictness_of
from quellgraph.operators.traversal import gated
from quellgraph.runtime import cut, free, scratch, settled, top_within, written

GUARDS_PER_EDGE = 3


def scored_edges(edges: DataFrame, scores: DataFrame, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``edges`` with ``score``: the mean exploitability of both ends, 0 where unknown. ``step`` gets the edges after either end is joined."""
    s = scores.select("graph_id", "node_id", F.col("exploitability").alias("_x"))
    j = step(edges.join(s.select("graph_id", F.col("node_id").alias("src"), F.col("_x").alias("_a")), ["graph_id", "src"], "left"))
    j = step(j.join(s.select("graph_id", F.col("node_id").alias("dst"), F.col("_x").alias("_b")), ["graph_id", "dst"], "left"))
    return j.withColumn("score", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).drop("_a", "_b")


def top_edges(edges: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` edges of each graph with the largest ``by``, the first among equals."""
    return top_within(edges.select("graph_id", "src", "dst", "ord", by), ["graph_id"], [F.desc(F.round(by, 9)), "ord", "src", "dst"], k)


def top_scored(edges: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """:func:`top_edges` by the score of :func:`scored_edges`, written. Edges travel by either end and by graph, one after the other, and what
    one way shuffled is freed before the next."""
    with scratch(edges.sparkSession) as keep:
        return keep(written(top_edges(scored_edges(edges.select("graph_id", "src", "dst", "ord"), scores, settled), "score", k)))


def random_edges(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    drawn = edges.select("graph_id", "src", "dst", draw_order(seed, "graph_id", "src", "dst").alias("_d"))
    return top_within(drawn, ["graph_id"], ["_d"], k).drop("_d")


def guard_set(edges: DataFrame, scores: DataFrame, steps: DataFrame, verified: DataFrame, seeds: DataFrame, top_k: int = 20) -> DataFrame:
    """``(graph_id, src, dst)`` to guard: the ``top_k`` by score, the edges of successful steps, and all edges out of verified
    nodes; where a graph has none, the edges into its seeds."""
    ends = ["graph_id", "src", "dst"]
    walked = steps.where("outcome = 'succeeded'").select(*ends)
    out = edges.join(verified.select("graph_id", F.col("node_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi").select(*ends)
    chosen = cut(top_scored(edges, scores, top_k).select(*ends).unionByName(walked).unionByName(out).distinct())
    free(edges.sparkSession)
    into = edges.join(seeds.select("graph_id", F.col("node_id").alias("dst")).distinct(), ["graph_id", "dst"], "left_semi").select(*ends)
    return chosen.unionByName(into.join(chosen, "graph_id", "left_anti"))


def decisions(attempts: DataFrame, guards_per_edge: int = GUARDS_PER_EDGE) -> DataFrame:
    """One row per guard and attempt. Attempts hold base, strictness, depth, max_depth, age and approved; each guard keeps its own nonces."""
    a = attempts.withColumn("guard", F.explode(F.sequence(F.lit(0), F.lit(guards_per_edge - 1))))
    d = guard_decision(F.col("base"), F.col("strictness"), F.col("depth"), F.col("max_depth"), F.col("age"), F.col("approved"))
    return a.withColumn("_d", d).select("*", F.col("_d.decision").alias("decision"), F.col("_d.reason").alias("reason")).drop("_d")


def agree(decided: DataFrame, by: list[str], required: int = 2) -> DataFrame:
    """2-of-3 consensus per attempt; a flag counts as a block."""
    g = decided.groupBy(*by).agg(F.count("*").alias("n_guards"), F.sum(F.when(F.col("decision") == "ALLOWED", 1).otherwise(0)).alias("n_allowed"))
    return g.withColumn("consensus", consensus(F.col("n_guards"), F.col("n_allowed"), required))


def statistics(decided: DataFrame, by: list[str]) -> DataFrame:
    """Per edge: events by decision, and the share that isn't allowed."""
    n = {d: F.sum(F.when(F.col("decision") == d, 1).otherwise(0)) for d in ("ALLOWED", "BLOCKED", "FLAGGED")}
    g = decided.groupBy(*by).agg(F.count("*").alias("n_events"), *[c.alias(f"n_{d.lower()}") for d, c in n.items()])
    return g.withColumn("block_rate", (F.col("n_blocked") + F.col("n_flagged")) / F.col("n_events"))


def sensor(events: DataFrame, by: list, seconds: float = 60.0, threshold: float = 0.6) -> DataFrame:
    """The sensor's reading per group of (decision, reason, edge_type) events: a batch, or a window of a stream.

    No event gives no row; the detection uses the score before it is rounded.
    """
    allowed = F.col("decision") == "ALLOWED"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = events.groupBy(*by).agg(
        F.count("*").alias("n_events"), count(allowed).alias("n_allowed"), count((F.col("decision") == "BLOCKED") & F.lower("reason").contains("depth")).alias("escalations"),
        count(allowed & F.col("edge_type").isin("ASSUME_ROLE", "AUTHENTICATE_AS")).alias("jumps"),
    )
    g = g.withColumn("frequency", F.col("n_events") / seconds).withColumn("validation_rate", F.col("n_allowed") / F.col("n_events"))
    score = anomaly_score(F.col("frequency"), F.col("validation_rate"), F.col("escalations"), F.col("jumps"))
    return g.withColumn("score", score).withColumn("anomaly_score", F.round("score", 4)).withColumn("anomaly", F.col("score") > threshold)


def block(edges: DataFrame, guards: DataFrame, levels: DataFrame) -> DataFrame:
    """Weight 0 on guarded edges of graphs whose strictness isn't nominal."""
    g = guards.select("graph_id", "src", "dst").join(levels.where("strictness != 'NOMINAL'").select("graph_id"), "graph_id", "left_semi").distinct().withColumn("_g", F.lit(True))
    return edges.join(g, ["graph_id", "src", "dst"], "left").withColumn("weight", F.when(F.col("_g"), 0.0).otherwise(F.col("weight"))).select(*edges.columns)


def blocked(edges: DataFrame) -> DataFrame:
    return edges.where("weight = 0").select("graph_id", "src", "dst")


def fully_contained(edges: DataFrame, blocked_edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that are no seed and whose every outgoing edge, of at least one, is blocked."""
    b = blocked_edges.select("graph_id", "src", "dst").distinct().withColumn("_b", F.lit(True))
    g = edges.join(b, ["graph_id", "src", "dst"], "left").groupBy("graph_id", F.col("src").alias("node_id")).agg(F.bool_and(F.coalesce("_b", F.lit(False))).alias("all"))
    return g.where("all").join(seeds, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")


def expand_seeds(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds and what they reach in one hop over edges with weight."""
    hop = edges.where("weight > 0").join(seeds.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("node_id"))
    return seeds.select("graph_id", "node_id").unionByName(hop).distinct()


def _levels(cycle: int, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, guards: DataFrame, analyse) -> DataFrame:
    """``(graph_id, cycle, risk, anomaly_score, strictness)`` of a cycle of :func:`feedback`, kept."""
    pred = analyse(nodes, edges, seeds)
    risk = pred.where("compromised").groupBy("graph_id").agg(F.avg("risk").alias("risk"))
    levels = seeds.select("graph_id").distinct().join(risk, "graph_id", "left").select("graph_id", F.coalesce("risk", F.lit(0.0)).alias("risk")).withColumn("strictness", strictness_of(F.col("risk")))
    live = edges.where("weight > 0").join(guards, ["graph_id", "src", "dst"], "left_semi").join(levels, "graph_id")
    tried = live.select("graph_id", "src", "dst", "edge_type", F.lit("valid").alias("base"), "strictness", F.col("delegation_depth_limit").alias("depth"), F.col("delegation_depth_limit").alias("max_depth"), F.lit(0.0).alias("age"), F.lit(False).alias("approved"))
    seen = sensor(decisions(tried), ["graph_id"]).select("graph_id", "anomaly_score", "anomaly")
    levels = levels.join(seen, "graph_id", "left").withColumn("strictness", F.when(F.coalesce("anomaly", F.lit(False)) & (F.col("strictness") == "NOMINAL"), "ELEVATED").otherwise(F.col("strictness")))
    return cut(levels.select("graph_id", F.lit(cycle).alias("cycle"), "risk", F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"), "strictness"))


def feedback(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, guards: DataFrame, analyse, cycles: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The loop of risk and strictness: ``(edges, seeds, log)`` after ``cycles``.

    ``analyse(nodes, edges, seeds)`` gives (graph_id, node_id, risk, compromised). Per cycle: the mean risk over compromised nodes
    sets the strictness; tokens at the depth limit are tried on guarded edges that still have weight, and an anomaly lifts nominal
    to elevated; guarded edges are blocked unless nominal; seeds spread by one hop over what is left.
    """
    log = None
    for cycle in range(cycles):
        with scratch(nodes.sparkSession):
            levels = _levels(cycle, nodes, edges, seeds, guards, analyse)
        log = levels if log is None else log.unionByName(levels)
        edges = cut(block(edges, guards, levels))
        seeds = cut(expand_seeds(seeds, edges))
    if log is None:
        log = seeds.select("graph_id", F.lit(0).alias("cycle"), F.lit(0.0).alias("risk"), F.lit(0.0).alias("anomaly_score"), F.lit("NOMINAL").alias("strictness")).limit(0)
    return edges, seeds, log


def transitions(log: DataFrame) -> DataFrame:
    """Cycles where the strictness changed, from NOMINAL at first."""
    w = Window.partitionBy("graph_id").orderBy("cycle")
    t = log.withColumn("before", F.coalesce(F.lag("strictness").over(w), F.lit("NOMINAL")))
    return t.where("before != strictness").select("graph_id", "cycle", "before", F.col("strictness").alias("after"), "risk")


def containment(before: DataFrame, after: DataFrame, unconstrained: DataFrame | None = None) -> DataFrame:
    """Per graph, from verified nodes before and after and what plain reachability gives: contained share (1 if nothing was
    verified), missed, reduction, blocks by nature and by guards, and both over the plain reach; rounded to 4 places."""
    f = lambda d, n: d.select("graph_id", "node_id").distinct().withColumn(n, F.lit(1))
    j = f(before, "b").join(f(after, "a"), ["graph_id", "node_id"], "full")
    j = j.join(f(unconstrained, "u"), ["graph_id", "node_id"], "full") if unconstrained is not None else j.withColumn("u", F.lit(None).cast("int"))
    j = j.fillna(0, ["a", "b", "u"])
    g = j.groupBy("graph_id").agg(F.sum("b").alias("vbr"), F.sum("a").alias("missed"), F.sum(F.col("b") * (1 - F.col("a"))).alias("guard_blocks"), F.sum(F.col("u") * (1 - F.col("b"))).alias("natural_blocks"), F.sum("u").alias("reach"))
    rate = F.when(F.col("vbr") == 0, 1.0).otherwise(F.col("guard_blocks") / F.col("vbr"))
    cut_ = F.when(F.col("vbr") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("vbr") - F.col("missed")) / F.col("vbr")))
    both = F.when(F.col("reach") == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("natural_blocks") + F.col("guard_blocks")) / F.col("reach")))
    return g.select("graph_id", F.round(rate, 4).alias("success_rate"), "missed", F.round(cut_, 4).alias("reduction"), "natural_blocks", "guard_blocks", F.round(both, 4).alias("combined"))


def contain(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, scores: DataFrame, analyse, reach: DataFrame | None = None, cycles: int = 5, max_depth: int = 6) -> dict[str, DataFrame]:
    """Guard set, feedback loop, and traversal of what is left."""
    before, steps = gated(nodes, edges, seeds, max_depth, True)
    guards = cut(guard_set(edges, scores, steps, before, seeds))
    after_edges, _, log = feedback(nodes, edges, seeds, guards, analyse, cycles)
    after, _ = gated(nodes, after_edges, seeds, max_depth, True)
    return {"guards": guards, "edges": after_edges, "log": log, "before": before, "after": after, "metrics": containment(before, after, reach)}


def deny_policies(blocked_edges: DataFrame, account: str = "123456789012", prefix: str = "Guard") -> DataFrame:
    """``(graph_id, src, dst, policy_name, description, document, apply_command)``: one Deny document per blocked edge."""
    flat = lambda c: F.translate(c, "/", "-")
    stmt = F.struct(F.lit("EdgeGuard").alias("Sid"), F.lit("Deny").alias("Effect"), F.lit("sts:AssumeRole").alias("Action"), F.concat(F.lit(f"arn:aws:iam::{account}:role/"), "dst").alias("Resource"))
    doc = F.to_json(F.struct(F.lit("2012-10-17").alias("Version"), F.array(stmt).alias("Statement")))
    return blocked_edges.select(
        "graph_id", "src", "dst", F.concat(F.lit(f"{prefix}-"), flat("src"), F.lit("-to-"), flat("dst")).alias("policy_name"), F.concat(F.lit("Deny "), "src", F.lit(" from assuming "), "dst").alias("description"), doc.alias("document"),
        F.concat(F.lit("aws iam put-role-policy --role-name "), "src", F.lit(f" --policy-name {prefix}-"), "dst", F.lit(" --policy-document '"), doc, F.lit("'")).alias("apply_command"),
    )
