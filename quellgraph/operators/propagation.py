"""How compromise spreads: six models with one result ``(graph_id, model, node_id, risk, compromised)``.

Matrix-vector models follow the product A x: a node's value comes from those it points to. ``direction='forward'`` turns that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions.rng import unit, units_of
from quellgraph.operators import dense
from quellgraph.operators.graph import components
from quellgraph.operators.traversal import bfs, check_seeds, reachability
from quellgraph.runtime import cut, free, scratch, top_within, written

# The stated confidence of each model, and of the stand-in for the network without trained weights.
CONFIDENCE = {"graph_traversal": 1.0, "epidemic": 0.2608, "spectral_cascade": 0.2974, "percolation": 0.7279, "control_system": 0.1267, "gnn": 0.62}
FALLBACK_CONFIDENCE = 0.5
#: Trials x (nodes + edges) up to which percolation is sampled by one task, and into how many tasks the trials of a graph are dealt at most.
TRIAL_WORK, TRIAL_PARTS = 2_500_000, 20


def _result(model: str, df: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """Flags at or above ``threshold``, and every seed."""
    s = seeds.select("graph_id", "node_id").distinct().withColumn("_s", F.lit(True))
    j = df.join(s, ["graph_id", "node_id"], "left")
    return j.select("graph_id", F.lit(model).alias("model"), "node_id", "risk", ((F.col("risk") >= threshold) | F.coalesce("_s", F.lit(False))).alias("compromised"))


def graph_traversal(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, follow_edge_types: list[str] | None = None) -> DataFrame:
    r = reachability(nodes, edges, seeds, max_depth, follow_edge_types)
    return r.select("graph_id", F.lit("graph_traversal").alias("model"), "node_id", "risk", "compromised")


def _mat_vec(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, scale: DataFrame | float, steps: int, tolerance: float, hold_seeds: bool, direction: str) -> DataFrame:
    """Values after x <- clip(scale A x), from 1 at the seeds; a graph stops when its change is below ``tolerance``.

    Small graphs are iterated one to a task, the others by a join and a sum per step.
    """
    check_seeds(nodes, seeds)
    fit = cut(dense.small_graphs(nodes, edges))
    n = nodes.select("graph_id", "node_id", "ord").join(seeds.select("graph_id", "node_id").distinct().withColumn("seed", F.lit(1.0)), ["graph_id", "node_id"], "left")
    n = n.join(scale, "graph_id", "left") if isinstance(scale, DataFrame) else n.withColumn("scale", F.lit(float(scale)))

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = dense.Sparse(v, e)
        a.w = a.w * float(v["scale"].iloc[0])
        times = a.times if direction == "reverse" else a.back
        start = v.sort_values(["ord", "node_id"])["seed"].fillna(0.0).to_numpy()
        x = start.copy()
        for _ in range(steps):
            y = np.clip(times(x), 0.0, 1.0)
            if hold_seeds:
                y = np.where(start > 0, 1.0, y)
            move = float(np.sqrt(((y - x) ** 2).sum()))
            x = y
            if tolerance > 0 and move < tolerance:
                break
        return pd.DataFrame({"node_id": a.ids, "risk": x})

    out = dense.per_graph(n, edges, kernel, "node_id string, risk double", ("seed", "scale"))
    big = nodes.join(fit, "graph_id", "left_anti")
    if big.take(1):
        part = scale.join(fit, "graph_id", "left_anti") if isinstance(scale, DataFrame) else scale
        out = out.unionByName(_mat_vec_joined(big, edges.join(fit, "graph_id", "left_anti"), seeds.join(fit, "graph_id", "left_anti"), part, steps, tolerance, hold_seeds, direction))
    return out


def _mat_vec_joined(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, scale: DataFrame | float, steps: int, tolerance: float, hold_seeds: bool, direction: str) -> DataFrame:
    """:func:`_mat_vec` for graphs of any size. Only nodes with a value above 0 take part in a step, and only of graphs that still move.
    """
    to, by = ("src", "dst") if direction == "reverse" else ("dst", "src")
    a = edges.where("weight > 0").select("graph_id", F.col(to).alias("node_id"), F.col(by).alias("_by"), "weight")
    if isinstance(scale, DataFrame):
        a = a.join(scale, "graph_id").withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
    else:
        a = a.withColumn("weight", F.col("weight") * scale)
    a = cut(a)
    start = seeds.select("graph_id", "node_id").distinct().withColumn("x", F.lit(1.0))
    x, still = cut(start), None
    held = start.withColumnRenamed("x", "_one")
    for step in range(steps):
        live = x if still is None else x.join(still, "graph_id", "left_semi")
        y = a.join(live.select("graph_id", F.col("node_id").alias("_by"), "x"), ["graph_id", "_by"]).groupBy("graph_id", "node_id").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        y = y.withColumn("y", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("y"))))
        if hold_seeds:
            h = held if still is None else held.join(still, "graph_id", "left_semi")
            y = y.join(h, ["graph_id", "node_id"], "full").select("graph_id", "node_id", F.coalesce("_one", "y").alias("y"))
        both = cut(live.join(y, ["graph_id", "node_id"], "full").select("graph_id", "node_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")))
        rest = None if still is None else x.join(still, "graph_id", "left_anti")
        new = both.select("graph_id", "node_id", F.col("y").alias("x"))
        x = new if rest is None else rest.unionByName(new)
        if tolerance > 0:
            move = both.groupBy("graph_id").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("d")).where(F.col("d") >= tolerance).select("graph_id")
            still = cut(move)  # one row per graph
            if not still.take(1):
                break
            x = cut(x)
        elif step % 4 == 3:
            x = cut(x)
    return nodes.select("graph_id", "node_id").join(x, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("x", F.lit(0.0)).alias("risk"))


def epidemic(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, beta: float = 0.3, infection_threshold: float = 0.5, max_steps: int = 50, tolerance: float = 1e-4, direction: str = "reverse") -> DataFrame:
    return _result("epidemic", _mat_vec(nodes, edges, seeds, beta, max_steps, tolerance, True, direction), seeds, infection_threshold)


def circular(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id)`` of graphs with a circle of edges with weight: nodes without an edge into or out of them are taken away until none is
    left to take. As many rounds as half the longest path."""
    left = cut(edges.where("weight > 0").select("graph_id", "src", "dst"))
    n = left.count()
    while n:
        ends = left.select("graph_id", F.col("src").alias("v")).distinct().intersect(left.select("graph_id", F.col("dst").alias("v")).distinct())
        kept = left
        for end in ("src", "dst"):
            kept = kept.join(ends.withColumnRenamed("v", end), ["graph_id", end], "left_semi")
        left, before = cut(kept.select("graph_id", "src", "dst")), n
        n = left.count()
        if n == before:
            break
    return left.select("graph_id").distinct()


def spectral_radius(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """``(graph_id, radius, node_id, vector)`` by power iteration on A + I, for graphs of any size, until no entry moves by
    ``tolerance`` or for exactly ``rounds``.

    With no negative weight the radius is an eigenvalue, and the shift by I keeps periodic graphs from swinging. Graphs without
    circles don't converge; :func:`spectral_header` takes them out first.
    """
    a = cut(edges.where("weight > 0").select("graph_id", "src", "dst", "weight"))
    x, k = nodes.select("graph_id", "node_id", F.lit(1.0).alias("x")), 0
    while rounds is None or k < rounds:
        k += 1
        y = a.join(x.select("graph_id", F.col("node_id").alias("dst"), "x"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        z = x.join(y, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "x", (F.coalesce("y", F.lit(0.0)) + F.col("x")).alias("z"))
        top = z.groupBy("graph_id").agg(F.max("z").alias("top"))
        moved = cut(z.join(top, "graph_id").select("graph_id", "node_id", (F.col("z") / F.col("top")).alias("x"), (F.col("top") - 1).alias("radius"), F.abs(F.col("z") / F.col("top") - F.col("x")).alias("move")))
        x = moved.drop("move")
        if rounds is None and (moved.agg(F.max("move")).first()[0] or 0.0) < tolerance:
            break
    return x.select("graph_id", "node_id", "radius", F.col("x").alias("vector"))


def spectral_header(nodes: DataFrame, edges: DataFrame, tau: float = 0.5) -> DataFrame:
    """``(graph_id, node_id, lambda_max, vector, cascade, probability)``: one task per graph where it fits, by joins for the rest; 0 for
    graphs without circles in both forms."""
    fit = dense.small_graphs(nodes, edges)
    big = nodes.join(fit, "graph_id", "left_anti")
    r = dense.spectral_risk(nodes, edges)
    if big.take(1):
        r = r.unionByName(_spectral_joined(big, edges.join(fit, "graph_id", "left_anti")))
    lam = F.col("lambda_max")
    cascade = (lam > 1e-9) & (tau > 1 / F.greatest(lam, F.lit(1e-9)))
    chance = F.when(lam <= 1e-9, 0.0).when(cascade, F.least(F.lit(1.0), tau * lam)).otherwise(0.1 * tau * lam)
    return r.withColumn("cascade", cascade).withColumn("probability", chance)


def _spectral_joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    round_ = cut(circular(nodes, edges))
    flat = nodes.join(round_, "graph_id", "left_anti").select("graph_id", "node_id", F.lit(0.0).alias("lambda_max"), F.lit(0.0).alias("vector"))
    found = spectral_radius(nodes.join(round_, "graph_id", "left_semi"), edges.join(round_, "graph_id", "left_semi"))
    return flat.unionByName(found.select("graph_id", "node_id", F.col("radius").alias("lambda_max"), "vector"))


def spectral_cascade(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, tau: float = 0.5, risk_threshold: float = 0.3) -> DataFrame:
    """The eigenvector as risk where there is a cascade; else only seeds are compromised. Graphs without cycles: seeds only."""
    check_seeds(nodes, seeds)
    r = spectral_header(nodes, edges, tau).join(seeds.select("graph_id", "node_id").distinct().withColumn("_s", F.lit(True)), ["graph_id", "node_id"], "left")
    seed = F.coalesce("_s", F.lit(False))
    risk = F.when(F.col("lambda_max") <= 1e-9, seed.cast("double")).otherwise(F.col("vector"))
    return r.select("graph_id", F.lit("spectral_cascade").alias("model"), "node_id", risk.alias("risk"), (seed | (F.col("cascade") & (risk >= risk_threshold))).alias("compromised"))


def _samples(v: pd.DataFrame, e: pd.DataFrame, p: float, trials: range, random_seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per trial, by place in the sorted ids: the first node of the component, its size, and whether the seeds reach."""
    ids, graph = sorted(v["node_id"]), v["graph_id"].iloc[0] if len(v) else ""
    at = {x: i for i, x in enumerate(ids)}
    src, dst = (np.array([at[x] for x in e[c]], np.int64) for c in ("src", "dst"))
    chance = np.fmin(1.0, e["weight"].to_numpy(float) * p)
    pairs = [f"{x}|{y}".encode() for x, y in zip(e["src"], e["dst"], strict=True)]
    out: list[list] = [[] for _ in ids]
    for x, *rest in zip(src.tolist(), dst.tolist(), chance.tolist(), pairs, strict=True):
        out[x].append(rest)
    start = [at[x] for x in v.loc[v["seed"].notna(), "node_id"]]
    for k in trials:
        kept = units_of(f"{random_seed}|c|{graph}|{k}", pairs) < chance
        tops = dense.component_places(len(ids), src[kept], dst[kept])
        size = np.bincount(tops, minlength=len(ids))[tops]
        reached, todo, head = np.zeros(len(ids), bool), list(start), f"{random_seed}|r|{graph}|{k}"
        reached[start] = True
        while todo:
            near = [x for x in out[todo.pop()] if not reached[x[0]]]
            for (y, w, _), drawn in zip(near, units_of(head, [x[2] for x in near]).tolist(), strict=True):
                if drawn < w and not reached[y]:
                    reached[y] = True
                    todo.append(y)
        yield k, tops, size, reached


def _trial_graphs(nodes: DataFrame, edges: DataFrame, n_trials: int) -> DataFrame:
    """The ids of graphs whose trials one task samples."""
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    fit = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(m, "graph_id", "left")
    return cut(fit.where((F.col("n") + F.coalesce("m", F.lit(0))) * n_trials <= TRIAL_WORK).select("graph_id"))


def _trial_parts(nodes: DataFrame, edges: DataFrame, n_trials: int) -> DataFrame:
    """``(graph_id, parts)``: graphs that a task holds, and to how many tasks their trials are dealt."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    m_ = F.coalesce("m", F.lit(0))
    parts = F.least(F.ceil((F.col("n") + m_) * n_trials / max(1, TRIAL_WORK)), F.lit(TRIAL_PARTS), F.lit(max(1, n_trials)))
    fit = n.join(m, "graph_id", "left").where((F.col("n") <= dense.SMALL_NODES) & (m_ <= dense.SMALL_EDGES))
    return cut(fit.select("graph_id", parts.cast("int").alias("parts")))


def _with_seed(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node_id", "ord").join(seeds.select("graph_id", "node_id").distinct().withColumn("seed", F.lit(1.0)), ["graph_id", "node_id"], "left")


def percolation_trials(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, p: float = 0.6, n_trials: int = 100, giant_threshold: float = 0.3, random_seed: int = 42) -> DataFrame:
    """``(graph_id, trial, node_id, in_giant, reached, component, size)`` for every trial and node.

    Each trial draws two independent samples of the edges, each with probability min(1, weight p): one for the components of the
    undirected graph, one for reaching from the seeds along edges. Small graphs go one to a task, with all their trials.
    """
    check_seeds(nodes, seeds)
    fit, n = _trial_graphs(nodes, edges, n_trials), _with_seed(nodes, seeds)

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(v["node_id"])
        parts = [pd.DataFrame({"trial": k, "node_id": ids, "in_giant": size > giant_threshold * len(ids), "reached": reached, "component": [ids[x] for x in tops], "size": size}) for k, tops, size, reached in _samples(v, e, p, range(n_trials), random_seed)]
        return pd.concat(parts)

    done = dense.per_graph(n, edges, kernel, "trial int, node_id string, in_giant boolean, reached boolean, component string, size bigint", ("seed",), fit)
    big = nodes.join(fit, "graph_id", "left_anti")
    if big.take(1):
        done = done.unionByName(_percolation_joined(big, edges.join(fit, "graph_id", "left_anti"), seeds.join(fit, "graph_id", "left_anti"), p, n_trials, giant_threshold, random_seed))
    return done


def _percolation_joined(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, p: float, n_trials: int, giant_threshold: float, random_seed: int) -> DataFrame:
    """:func:`percolation_trials` for graphs of any size, with the same draws. Trials are extra keys of the same joins."""
    trial = F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial")
    chance = F.least(F.lit(1.0), F.col("weight") * p)
    drawn = edges.select("graph_id", "src", "dst", "weight", trial)
    kept = lambda what: drawn.where(unit(random_seed, F.lit(what), "graph_id", F.col("trial"), F.col("src"), F.col("dst")) < chance)
    tag = F.concat_ws("#", "graph_id", "trial")
    all_nodes = nodes.select("graph_id", "node_id", trial)
    comp = components(all_nodes.select(tag.alias("graph_id"), "node_id"), kept("c").select(tag.alias("graph_id"), "src", "dst"))
    sizes = comp.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    comp = comp.join(sizes, ["graph_id", "component"])
    start = seeds.select("graph_id", "node_id", trial).select(tag.alias("graph_id"), "node_id")
    hit = bfs(cut(kept("r").select(tag.alias("graph_id"), "src", "dst")), start).select("graph_id", "node_id", F.lit(True).alias("reached"))
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    j = all_nodes.withColumn("_tag", tag).join(comp.withColumnRenamed("graph_id", "_tag"), ["_tag", "node_id"]).join(hit.withColumnRenamed("graph_id", "_tag"), ["_tag", "node_id"], "left").join(n, "graph_id")
    return j.select("graph_id", "trial", "node_id", (F.col("size") > giant_threshold * F.col("_n")).alias("in_giant"), F.coalesce("reached", F.lit(False)).alias("reached"), "component", "size")


def percolation(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, p: float = 0.6, n_trials: int = 100, giant_threshold: float = 0.3, random_seed: int = 42) -> DataFrame:
    """Risk min(1, .4 share of trials in a giant component + .6 share reached), 1 for seeds; compromised from .5, in the trial
    whose seed component is largest (the first among equals), or a seed."""
    check_seeds(nodes, seeds)
    fit = _trial_parts(nodes, edges, n_trials)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.iloc[0]
        ids = np.asarray(g["ids"], object)
        n = int(g["n"])
        seed = np.frombuffer(g["seed"]) > 0
        v = pd.DataFrame({"graph_id": key[0], "node_id": ids[:n], "seed": np.where(seed, 1.0, np.nan)})
        e = pd.DataFrame({c: ids[np.frombuffer(g[c], np.int32)] for c in ("src", "dst")} | {"weight": np.frombuffer(g["weight"])})
        giant, reach, most, first, won = np.zeros(n, np.int32), np.zeros(n, np.int32), -1, -1, np.zeros(n, bool)
        for k, tops, size, reached in _samples(v, e, p, range(key[1], n_trials, int(g["parts"])), random_seed):
            giant += size > giant_threshold * n
            reach += reached
            own = int(size[seed].max()) if seed.any() else -1
            if own > most:
                most, first, won = own, k, np.isin(tops, tops[seed])
        return pd.DataFrame({"graph_id": [key[0]], "part": [key[1]], "giant": [giant.tobytes()], "reach": [reach.tobytes()], "own": [most], "trial": [first], "won": [won.tobytes()]})

    def total(g: pd.Series, parts: pd.DataFrame) -> dict:
        n, best = int(g["n"]), max(range(len(parts)), key=lambda i: (parts["own"].iloc[i], -parts["trial"].iloc[i]))
        add = lambda c: sum(np.frombuffer(x, np.int32) for x in parts[c])
        return {"node_id": np.asarray(g["ids"], object)[:n], "seed": np.frombuffer(g["seed"]) > 0, "g": add("giant"), "r": add("reach"), "won": np.frombuffer(parts["won"].iloc[best], bool)}

    graphs = dense.packed(_with_seed(nodes, seeds).withColumn("seed", F.coalesce("seed", F.lit(0.0))), edges, fit, ("seed",), ("weight",))
    free(nodes.sparkSession)
    done = dense.of_nodes(graphs.select("graph_id", "ids", "n", "seed"), dense.dealt(graphs, run, "graph_id string, part int, giant binary, reach binary, own bigint, trial int, won binary"), total, "node_id string, seed boolean, g bigint, r bigint, won boolean")
    risk = F.when(F.col("seed"), 1.0).otherwise(F.least(F.lit(1.0), 0.4 * (F.col("g") / n_trials) + 0.6 * (F.col("r") / n_trials)))
    done = done.select("graph_id", F.lit("percolation").alias("model"), "node_id", risk.alias("risk"), ((risk >= 0.5) | F.col("won") | F.col("seed")).alias("compromised"))
    big = nodes.join(fit, "graph_id", "left_anti")
    if big.take(1):
        done = done.unionByName(_percolation_risk(big, edges.join(fit, "graph_id", "left_anti"), seeds.join(fit, "graph_id", "left_anti"), p, n_trials, giant_threshold, random_seed))
    return done


def _percolation_risk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, p: float, n_trials: int, giant_threshold: float, random_seed: int) -> DataFrame:
    """:func:`percolation` from the rows of all trials, for graphs of any size."""
    t = written(percolation_trials(nodes, edges, seeds, p, n_trials, giant_threshold, random_seed))
    s = seeds.select("graph_id", "node_id").distinct().withColumn("_s", F.lit(True))
    own = t.join(s, ["graph_id", "node_id"], "left_semi").groupBy("graph_id", "trial").agg(F.max("size").alias("k"))
    best = own.groupBy("graph_id").agg(F.max_by("trial", F.struct("k", -F.col("trial"))).alias("trial"))
    won = t.join(best, ["graph_id", "trial"], "left_semi").join(t.join(best, ["graph_id", "trial"], "left_semi").join(s, ["graph_id", "node_id"], "left_semi").select("graph_id", "component").distinct(), ["graph_id", "component"], "left_semi")
    won = won.select("graph_id", "node_id", F.lit(True).alias("_w"))
    share = t.groupBy("graph_id", "node_id").agg(F.avg(F.col("in_giant").cast("double")).alias("g"), F.avg(F.col("reached").cast("double")).alias("r"))
    j = share.join(s, ["graph_id", "node_id"], "left").join(won, ["graph_id", "node_id"], "left")
    risk = F.when(F.col("_s"), 1.0).otherwise(F.least(F.lit(1.0), 0.4 * F.col("g") + 0.6 * F.col("r")))
    return j.select("graph_id", F.lit("percolation").alias("model"), "node_id", risk.alias("risk"), ((risk >= 0.5) | F.coalesce("_w", F.lit(False)) | F.coalesce("_s", F.lit(False))).alias("compromised"))


def percolation_header(trials: DataFrame) -> DataFrame:
    """Per graph: the share of trials with a giant component and the mean size of the largest."""
    per = trials.groupBy("graph_id", "trial").agg(F.max(F.col("in_giant").cast("int")).alias("giant"), F.max(F.when(F.col("in_giant"), F.col("size")).otherwise(0)).alias("size"))
    return per.groupBy("graph_id").agg(F.avg("giant").alias("giant_probability"), F.avg("size").alias("mean_giant_size"))


def component_sizes(trials: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` most common component sizes of each graph over all trials."""
    sizes = trials.select("graph_id", "trial", "component", "size").distinct().groupBy("graph_id", "size").agg(F.count("*").alias("n"))
    return top_within(sizes, ["graph_id"], [F.desc("n"), "size"], top).drop("rank")


def critical_edges(edges: DataFrame, risks: DataFrame, threshold: float = 0.4, first: int = 10) -> DataFrame:
    """The first edges, by their order and not by risk, with both ends at or above the threshold."""
    r = risks.where(F.col("risk") >= threshold).select("graph_id", "node_id")
    e = edges.join(r.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(r.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    return top_within(e.select("graph_id", "src", "dst", "ord"), ["graph_id"], ["ord", "src", "dst"], first).select("graph_id", "src", "dst", "rank")


def control_system(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_steps: int = 50, tolerance: float = 1e-4, threshold: float = 0.4, direction: str = "reverse") -> DataFrame:
    """x <- clip(A x / (radius + 1e-9)), from the seeds, which aren't held."""
    h = spectral_header(nodes, edges).groupBy("graph_id").agg((1 / (F.max("lambda_max") + 1e-9)).alias("scale"))
    return _result("control_system", _mat_vec(nodes, edges, seeds, h, max_steps, tolerance, False, direction), seeds, threshold)


def stability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: the radius after normalisation, the margin 1 - radius, whether it is positive, and the cascade probability that
    falls linearly from .9 below a margin of .1 to .2 above .5."""
    h = spectral_header(nodes, edges).groupBy("graph_id").agg(F.max("lambda_max").alias("r")).withColumn("radius", F.col("r") / (F.col("r") + 1e-9))
    m = 1 - F.col("radius")
    return h.select("graph_id", "radius", m.alias("margin"), (m > 0).alias("stable"), F.when(m < 0.1, 0.9).when(m > 0.5, 0.2).otherwise(0.9 - (m - 0.1) / 0.4 * 0.7).alias("probability"))


def gnn(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, weights: dict | None = None, threshold: float = 0.4) -> DataFrame:
    """The graph convolution with trained ``weights``; without any, reachability stands in, at confidence 0.5."""
    if weights is None:
        return graph_traversal(nodes, edges, seeds).withColumn("model", F.lit("gnn"))
    from quellgraph.operators.gcn import features, forward

    return _result("gnn", forward(features(nodes, edges, seeds), edges, weights), seeds, threshold)


MODELS = {f.__name__: f for f in (graph_traversal, epidemic, spectral_cascade, percolation, control_system, gnn)}


def run_single(name: str, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; known: {', '.join(MODELS)}")
    return MODELS[name](nodes, edges, seeds, **options)


def run_all(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, use_gnn: bool = True, **options: dict) -> DataFrame:
    """The results of all models, kept; ``options`` by model name. What one model shuffled or wrote besides is gone before the next one runs."""
    done: dict[str, DataFrame] = {}
    for m in MODELS:
        if m == "gnn" and not use_gnn:
            continue
        if m == "gnn" and not options.get(m, {}).get("weights") and not options.get("graph_traversal"):  # the stand-in is there already
            done[m] = done["graph_traversal"].withColumn("model", F.lit(m))
        else:
            with scratch(nodes.sparkSession) as keep:
                done[m] = keep(written(run_single(m, nodes, edges, seeds, **options.get(m, {}))))
    return reduce(DataFrame.unionByName, done.values())
