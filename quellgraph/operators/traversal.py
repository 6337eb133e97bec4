"""Level-by-level traversals. A level is a join of the frontier with the edges and an anti-join with what was seen.

A frontier of at most ``BROADCAST_ROWS`` rows, which the loop counts anyway, is sent to the edges; a larger one is joined by
shuffle. Every level is kept in the shared folder, so that the plan doesn't grow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions.rng import unit, unit_of
from quellgraph.operators import dense
from quellgraph.operators.graph import components
from quellgraph.runtime import cut, written

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def check_seeds(nodes: DataFrame, seeds: DataFrame) -> None:
    lost = seeds.join(nodes, ["graph_id", "node_id"], "left_anti").select("node_id").take(1)
    if lost:
        raise KeyError(f"no such seed: {lost[0][0]}")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, edge_types: list[str] | None = None, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """``(*keys, node_id, dist)``: hops from the nearest seed along edges, seeds included at 0. Weights don't matter.

    ``keys`` may name more than the graph, such as a source or a trial, for many traversals at once; edges need the keys they share.
    Graphs with few edges are walked one to a task, all others level by level.
    """
    hop = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    on = [k for k in keys if k in edges.columns]
    hop = hop.select(*on, "src", "dst")
    start = cut(seeds.select(*keys, "node_id").distinct())
    if list(keys) != on:
        return _bfs_levels(cut(hop.distinct()), start, max_depth, keys, on)
    big = hop.groupBy(*on).agg(F.count("*").alias("m")).where(F.col("m") > dense.SMALL_EDGES).select(*on)
    some = bool(big.take(1))
    few = lambda df: df.join(big, on, "left_anti") if some else df
    out = _bfs_small(few(hop), few(start), max_depth, on)
    if some:
        hop = cut(hop.distinct())
        out = out.unionByName(_bfs_levels(hop.join(big, on, "left_semi"), start.join(big, on, "left_semi"), max_depth, keys, on))
    return out


def _bfs_small(hop: DataFrame, start: DataFrame, max_depth: int | None, on: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in start.select(*on).schema)

    def run(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(e["src"], e["dst"], strict=True):
            near.setdefault(a, []).append(b)
        dist = dict.fromkeys(s["node_id"], 0)
        queue = list(dist)
        for v in queue:
            if max_depth is None or dist[v] < max_depth:
                for w in near.get(v, ()):
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        queue.append(w)
        return pd.DataFrame([(*key, v, k) for v, k in dist.items()], columns=[*on, "node_id", "dist"])

    return start.groupBy(*on).cogroup(hop.groupBy(*on)).applyInPandas(run, f"{kinds}, node_id string, dist int")


def _bfs_levels(hop: DataFrame, start: DataFrame, max_depth: int | None, keys: tuple[str, ...], on: list[str]) -> DataFrame:
    front = start.withColumn("dist", F.lit(0))
    seen, n, depth = front, front.count(), 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        reached = hop.join(small(front.withColumnRenamed("node_id", "src"), n), [*on, "src"]).select(*keys, F.col("dst").alias("node_id")).distinct()
        front = cut(reached.join(seen, [*keys, "node_id"], "left_anti").withColumn("dist", F.lit(depth)))
        n = front.count()
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def reachability(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """``(graph_id, node_id, dist, risk, compromised)`` of every node: risk 1 / (dist + 1), 0 where no seed reaches."""
    check_seeds(nodes, seeds)
    hit = bfs(edges, seeds, max_depth, edge_types)
    out = nodes.select("graph_id", "node_id").join(hit, ["graph_id", "node_id"], "left")
    return out.withColumn("risk", F.when(F.col("dist").isNotNull(), 1.0 / (F.col("dist") + 1)).otherwise(0.0)).withColumn("compromised", F.col("dist").isNotNull())


def reachability_header(nodes: DataFrame, result: DataFrame, high: float = 0.9) -> DataFrame:
    """Per graph: cascade 1 if a node of high privilege that is no seed was reached, else the share reached; the depth."""
    j = result.join(nodes.select("graph_id", "node_id", "privilege_level"), ["graph_id", "node_id"])
    g = j.groupBy("graph_id").agg(
        F.sum(F.col("compromised").cast("int")).alias("n_compromised"), F.count("*").alias("n"), F.max("dist").alias("depth"), F.max(F.when((F.col("dist") > 0) & (F.col("privilege_level") >= high), 1).otherwise(0)).alias("_high")
    )
    return g.select("graph_id", "n_compromised", "depth", F.when(F.col("_high") == 1, 1.0).otherwise(F.col("n_compromised") / F.col("n")).alias("cascade_probability"), F.lit(1.0).alias("confidence"))


_STEP = "graph_id string, kind string, src string, dst string, level int, outcome string"


def gated(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 6, conditions: bool = False, random_seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Traversal by delegation tokens: ``(visited, steps)``.

    At level d, every edge from the frontier to a node not seen before the level is attempted: it fails if d exceeds the edge's
    delegation depth limit and, with ``conditions``, with probability 1 - weight. ``visited`` is ``(graph_id, node_id, level)``;
    ``steps`` has one row per attempt, ``(graph_id, src, dst, level, outcome)``.
    Graphs that fit are walked one to a task, the others level by level, with the same draws.
    """
    check_seeds(nodes, seeds)
    hop = edges.select("graph_id", "src", "dst", "weight", "delegation_depth_limit")
    start = seeds.select("graph_id", "node_id").distinct()
    big = cut(hop.groupBy("graph_id").agg(F.count("*").alias("m")).where(F.col("m") > dense.SMALL_EDGES).select("graph_id"))
    some = bool(big.take(1))
    few = lambda df: df.join(big, "graph_id", "left_anti") if some else df

    def run(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list] = {}
        for a, b, w, most in zip(e["src"], e["dst"], e["weight"], e["delegation_depth_limit"], strict=True):
            near.setdefault(a, []).append((b, w, most))
        front, rows = list(s["node_id"]), []
        level = dict.fromkeys(front, 0)
        for depth in range(max_depth):
            reached: dict[str, int] = {}
            for a in front:
                for b, w, most in near.get(a, ()):
                    if b in level:
                        continue
                    if most is not None and most == most and most < depth:
                        outcome = "depth_exceeded"
                    elif conditions and not (w is not None and unit_of(random_seed, depth, key[0], a, b) < w):
                        outcome = "condition_failed"
                    else:
                        outcome = "succeeded"
                        reached[b] = depth + 1
                    rows.append((key[0], "step", a, b, depth, outcome))
            level |= reached
            front = list(reached)
        rows += [(key[0], "seen", v, None, k, None) for v, k in level.items()]
        return pd.DataFrame(rows, columns=["graph_id", "kind", "src", "dst", "level", "outcome"])

    walked = written(few(start).groupBy("graph_id").cogroup(few(hop).groupBy("graph_id")).applyInPandas(run, _STEP))
    seen = walked.where("kind = 'seen'").select("graph_id", F.col("src").alias("node_id"), "level")
    steps = walked.where("kind = 'step'").select("graph_id", "src", "dst", "level", "outcome")
    if some:
        a, b = _gated_levels(hop.join(big, "graph_id", "left_semi"), start.join(big, "graph_id", "left_semi"), max_depth, conditions, random_seed)
        seen, steps = seen.unionByName(a), steps.unionByName(b)
    return seen, steps


def _gated_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, conditions: bool, random_seed: int) -> tuple[DataFrame, DataFrame]:
    """:func:`gated` for graphs of any size, level by level."""
    hop = cut(edges.select("graph_id", "src", "dst", "weight", "delegation_depth_limit"))
    front = cut(seeds.select("graph_id", "node_id").distinct().withColumn("level", F.lit(0)))
    seen, n, log = front, front.count(), []
    for depth in range(max_depth):
        if not n:
            break
        tried = hop.join(small(front.select("graph_id", F.col("node_id").alias("src")), n), ["graph_id", "src"]).join(seen.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti")
        lucky = unit(random_seed, F.lit(depth), "graph_id", F.col("src"), F.col("dst")) < F.col("weight") if conditions else F.lit(True)
        outcome = F.when(F.col("delegation_depth_limit") < depth, "depth_exceeded").when(~lucky, "condition_failed").otherwise("succeeded")
        tried = cut(tried.select("graph_id", "src", "dst", F.lit(depth).alias("level"), outcome.alias("outcome")))
        log.append(tried)
        front = cut(tried.where("outcome = 'succeeded'").select("graph_id", F.col("dst").alias("node_id")).distinct().withColumn("level", F.lit(depth + 1)))
        n = front.count()
        seen = seen.unionByName(front)
    steps = log[0] if log else hop.limit(0).select("graph_id", "src", "dst", F.lit(0).alias("level"), F.lit("").alias("outcome"))
    for more in log[1:]:
        steps = steps.unionByName(more)
    return seen, steps


def parents(steps: DataFrame) -> DataFrame:
    """``(graph_id, node_id, parent, level)``: the first successful step into each node."""
    first = steps.where("outcome = 'succeeded'").groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min(F.struct("level", "src")).alias("s"))
    return first.select("graph_id", "node_id", F.col("s.src").alias("parent"), F.col("s.level").alias("level"))


def paths_to(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """``(graph_id, node_id, path)`` from a seed to each of ``targets`` that was reached, by :func:`parents`; seeds are their own path."""
    up = cut(parents(steps).select("graph_id", F.col("node_id").alias("_at"), "parent"))
    paths = targets.select("graph_id", "node_id", F.array("node_id").alias("path"), F.col("node_id").alias("_at"))
    done = paths.limit(0).select("graph_id", "node_id", "path")
    while True:  # as many rounds as the deepest path has steps
        on = cut(paths.join(up, ["graph_id", "_at"], "left"))
        done = done.unionByName(on.where("parent is null").select("graph_id", "node_id", "path"))
        paths = on.where("parent is not null").select("graph_id", "node_id", F.concat(F.array("parent"), F.col("path")).alias("path"), F.col("parent").alias("_at"))
        if not paths.take(1):
            return done


def simple_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, target_privilege: float = 0.8, max_hops: int = 10) -> DataFrame:
    """``(graph_id, path)``: every path without repeated nodes from a source to another node of high privilege, up to ``max_hops``.

    Their number can grow as the paths of the graph do; ``max_hops`` is the reference's bound and bounds the rounds.
    """
    hop = cut(edges.select("graph_id", "src", "dst"))
    high = nodes.where(F.col("privilege_level") >= target_privilege).select("graph_id", F.col("node_id").alias("_last"))
    walk = cut(sources.select("graph_id", F.array("node_id").alias("path")))
    found = None
    for _ in range(max_hops):
        walk = walk.withColumn("src", F.element_at("path", -1)).join(hop, ["graph_id", "src"]).where("not array_contains(path, dst)").select("graph_id", F.concat("path", F.array("dst")).alias("path"))
        walk = cut(walk)
        found = walk if found is None else found.unionByName(walk)
        if not walk.take(1):
            break
    return found.withColumn("_last", F.element_at("path", -1)).join(high, ["graph_id", "_last"], "left_semi").select("graph_id", "path")


def all_pairs(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """``(graph_id, source, node_id, dist)`` for every node as source."""
    e = edges if directed else edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return bfs(e, nodes.select("graph_id", F.col("node_id").alias("source"), "node_id"), keys=("graph_id", "source"))


def _largest(comps: DataFrame) -> DataFrame:
    """``(graph_id, node_id, k)``: the nodes of each graph's largest component, and its size."""
    size = comps.groupBy("graph_id", "component").agg(F.count("*").alias("k"))
    largest = size.groupBy("graph_id").agg(F.max_by("component", F.struct("k", "component")).alias("component"), F.max("k").alias("k"))
    return comps.join(largest, ["graph_id", "component"]).select("graph_id", "node_id", "k")


def paths(nodes: DataFrame, edges: DataFrame, comps: DataFrame | None = None, variance: bool = True) -> DataFrame:
    """``(graph_id, avg_path_length, centrality_variance)``: of the largest weak component, directed if it is strongly connected, else
    undirected; and the variance of the betweenness, null if not asked for. Paths of a graph are counted by tasks that hold its edges where
    they fit, else by joins; ``comps`` are the components of the latter, found here if not given."""
    fit = cut(dense.path_graphs(nodes, edges))
    out = dense.path_totals(nodes, edges, fit, variance)
    big = nodes.join(fit, "graph_id", "left_anti")
    if big.take(1):
        e = edges.join(fit, "graph_id", "left_anti")
        inside = components(big, e) if comps is None else comps.join(fit, "graph_id", "left_anti")
        more = _average_path_joined(big, e, inside)
        if variance:
            more = more.join(betweenness_joined(big, e).groupBy("graph_id").agg(F.var_pop("betweenness").alias("centrality_variance")), "graph_id", "left")
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def average_path(nodes: DataFrame, edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """``(graph_id, avg_path_length)`` as of :func:`paths`."""
    return paths(nodes, edges, comps, False).select("graph_id", "avg_path_length")


def _average_path_joined(nodes: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
    inside = _largest(comps)
    e = edges.join(inside.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").select("graph_id", "src", "dst")
    total = lambda d: all_pairs(inside, e, d).where("dist > 0").groupBy("graph_id").agg(F.count("*").alias("pairs"), F.sum("dist").alias("dist"))
    k = inside.groupBy("graph_id").agg(F.first("k").alias("k"))
    both = k.join(total(True).select("graph_id", F.col("pairs").alias("p1"), F.col("dist").alias("d1")), "graph_id", "left").join(total(False).select("graph_id", F.col("dist").alias("d2")), "graph_id", "left")
    full = F.col("k") * (F.col("k") - 1)
    return both.select("graph_id", F.when(F.col("k") < 2, 0.0).when(F.col("p1") == full, F.col("d1") / full).otherwise(F.col("d2") / full).alias("avg_path_length"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, betweenness)``: directed, unweighted, normalised by (n - 1)(n - 2). Small graphs are counted one to a
    task, the others by :func:`betweenness_joined`."""
    fit = cut(dense.path_graphs(nodes, edges))
    out = dense.path_counts(nodes, edges, fit, False).select("graph_id", "node_id", "betweenness")
    big = nodes.join(fit, "graph_id", "left_anti")
    return out.unionByName(betweenness_joined(big, edges.join(fit, "graph_id", "left_anti"))) if big.take(1) else out


def betweenness_joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Betweenness of graphs of any size: Brandes' two
    sweeps as joins, for all sources at once: forwards the numbers of shortest paths by level, backwards the
    dependencies. Rows are (source, node) pairs, spread over the cluster by both.
    """
    hop = cut(edges.where("src != dst").select("graph_id", "src", "dst").distinct())
    key = ["graph_id", "source", "node_id"]
    front = cut(nodes.select("graph_id", F.col("node_id").alias("source"), "node_id", F.lit(1.0).alias("sigma")))
    seen, levels = front.select(*key), [front]
    while True:
        nxt = front.withColumnRenamed("node_id", "src").join(hop, ["graph_id", "src"]).groupBy("graph_id", "source", F.col("dst").alias("node_id")).agg(F.sum("sigma").alias("sigma"))
        front = cut(nxt.join(seen, key, "left_anti"))
        if not front.take(1):
            break
        levels.append(front)
        seen = cut(seen.unionByName(front.select(*key)))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    done = [delta]
    for level in reversed(levels[:-1]):
        share = delta.select("graph_id", "source", F.col("node_id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("s"))
        back = share.join(hop, ["graph_id", "dst"]).groupBy("graph_id", "source", F.col("src").alias("node_id")).agg(F.sum("s").alias("s"))
        delta = cut(level.join(back, key, "left").select(*key, "sigma", (F.col("sigma") * F.coalesce("s", F.lit(0.0))).alias("delta")))
        done.append(delta)
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    total = total.where("source != node_id").groupBy("graph_id", "node_id").agg(F.sum("delta").alias("b"))
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    out = nodes.select("graph_id", "node_id").join(total, ["graph_id", "node_id"], "left").join(n, "graph_id")
    return out.select("graph_id", "node_id", F.when(F.col("n") > 2, F.coalesce("b", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))
