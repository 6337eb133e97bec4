"""Attackers that dwell and move: one simulation per (graph, strategy, seed).

Walks are sequential; what is distributed is their number. On graphs that fit a task a walk is a task of its own;
on larger ones all walkers move on together, by joins of the nodes they are at with the edges.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions.rng import unit, unit_of
from quellgraph.operators.dense import small_graphs
from quellgraph.runtime import cut, place_within

HIGH = 0.8
#: Walkers up to which they are broadcast.
FEW = 200_000
JUMPS = ["ASSUME_ROLE", "AUTHENTICATE_AS"]
_OUT = "graph_id string, strategy string, seed int, time_step int, current_node string, action string, n_compromised int, detected boolean, strictness string, n_events int, high_reached boolean"


def _strictness(events: int, jumps: int, step: int) -> str:
    """From the running reading: all probes are allowed, so only their frequency and privileged edges count."""
    if not events:
        return "NOMINAL"
    score = round(0.3 * min(1.0, events / step / 5) + 0.2 * min(1.0, jumps / 3), 4)
    return "LOCKDOWN" if score > 0.8 else "ELEVATED" if score > 0.6 else "NOMINAL"


def walk(edges: pd.DataFrame, privilege: dict[str, float], start: str, strategy: str, seed: int, *, dwell: int = 3, detection: float = 0.1, steps: int = 100, blocked: frozenset = frozenset()) -> list[tuple]:
    """The timeline of one attacker."""
    out = {s: part.sort_values("dst") for s, part in edges.groupby("src")}
    at, been, waited, seen, events, jumps, high, rows = start, {start}, 0, False, 0, 0, False, []
    for t in range(1, steps + 1):
        action, noticed = "DWELL", False
        near = out.get(at)
        if seen:
            action = "CONTAINED"
        elif waited < dwell:
            waited += 1
            probes = [] if near is None else near.nsmallest(1, "weight", keep="first") if strategy == "stealthy" else near
            n = len(probes)
            events += n
            jumps += int(probes["edge_type"].isin(JUMPS).sum()) if n else 0
            noticed = any(unit_of(seed, strategy, "see", t, k) < detection for k in range(max(1, n)))
        else:
            waited = 0
            free = near[~near["dst"].isin(been)] if near is not None else None
            if free is None or not len(free):
                events += 0 if near is None else 1 if strategy == "stealthy" else len(near)
            else:
                if strategy == "greedy":
                    to = max(free["dst"], key=lambda v: privilege.get(v, 0.0))
                elif strategy == "stealthy":
                    to = free.nsmallest(1, "weight", keep="first")["dst"].iloc[0]
                else:
                    to = free["dst"].iloc[int(unit_of(seed, "go", t) * len(free))]
                if (at, to) not in blocked:
                    at, action = to, "MOVE"
                    been.add(to)
        high = high or any(privilege.get(v, 0.0) >= HIGH for v in been)
        if noticed and not seen:
            seen, action = True, "DETECTED"
        rows.append((t, at, action, len(been), noticed, _strictness(events, jumps, t), events, high))
    return rows


def simulate(nodes: DataFrame, edges: DataFrame, starts: DataFrame, runs: list[tuple[str, int]], *, blocked: DataFrame | None = None, **options) -> DataFrame:
    """Timelines of every run of ``runs`` (strategy, seed pairs) from the start (graph_id, node_id) of every graph, with or without edges."""
    fit = cut(small_graphs(nodes, edges))
    grid = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("seed")) for s, k in runs])
    todo = starts.select("graph_id", F.col("node_id").alias("start"), F.inline(grid))
    e = edges.select("graph_id", "src", "dst", "weight", "edge_type")
    e = e.join(blocked.select("graph_id", "src", "dst").distinct().withColumn("b", F.lit(True)), ["graph_id", "src", "dst"], "left") if blocked is not None else e.withColumn("b", F.lit(None).cast("boolean"))
    p = nodes.select("graph_id", "node_id", F.coalesce("privilege_level", F.lit(0.0)).alias("privilege_level"))
    near = e.join(fit, "graph_id", "left_semi").groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "weight", "edge_type", "b")).alias("e"))
    packed = p.join(fit, "graph_id", "left_semi").groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "privilege_level"))).alias("p")).join(near, "graph_id", "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in part.itertuples():
            df = pd.DataFrame([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (() if r.e is None else r.e)], columns=["src", "dst", "weight", "edge_type", "b"])
            stop = frozenset(zip(df.loc[df["b"] == True, "src"], df.loc[df["b"] == True, "dst"], strict=True))  # noqa: E712
            rows += [(r.graph_id, r.strategy, r.seed, *x) for x in walk(df, dict(r.p), r.start, r.strategy, int(r.seed), blocked=stop, **options)]
        return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in _OUT.split(",")])

    out = todo.join(packed, "graph_id").groupBy("graph_id", "strategy", "seed").applyInPandas(run, _OUT)
    big = todo.join(nodes.join(fit, "graph_id", "left_anti").select("graph_id").distinct(), "graph_id", "left_semi")
    if big.take(1):
        out = out.unionByName(_walks_joined(big, e.join(fit, "graph_id", "left_anti"), p, **options))
    return out


def _walks_joined(walkers: DataFrame, edges: DataFrame, privilege: DataFrame, *, dwell: int = 3, detection: float = 0.1, steps: int = 100) -> DataFrame:
    """:func:`walk` for graphs of any size, with the same draws. All walkers dwell and move at the same steps, so a round is ``dwell``
    steps and a move: one join to look at the edges of the node, one to fetch the edge taken. No node's edges are collected: an edge
    is picked by its place ``i`` among those of its source.
    """
    e = edges.join(privilege.select("graph_id", F.col("node_id").alias("dst"), F.col("privilege_level").alias("to_p")), ["graph_id", "dst"], "left")
    e = e.select(F.struct("graph_id", "src").alias("_k"), "dst", "weight", F.col("edge_type").isin(JUMPS).cast("int").alias("jump"), F.coalesce("b", F.lit(False)).alias("b"), F.coalesce("to_p", F.lit(0.0)).alias("to_p"))
    e = cut(place_within(e, "_k", ["dst"]).select("_k.graph_id", F.col("_k.src").alias("at"), "dst", "weight", "jump", "b", "to_p", "i"))
    key, kept = ["graph_id", "strategy", "seed", "start"], ["at", "been", "events", "jumps", "high"]
    first = privilege.select("graph_id", F.col("node_id").alias("start"), "privilege_level")
    x = cut(walkers.join(first, ["graph_id", "start"], "left").select(*key, F.col("start").alias("at"), F.array("start").alias("been"), F.lit(0).alias("events"), F.lit(0).alias("jumps"), (F.coalesce("privilege_level", F.lit(0.0)) >= HIGH).alias("high")))
    quiet, spent = F.col("strategy") == "stealthy", []
    for t0 in range(0, steps, dwell + 1):
        n = x.count()
        if not n:
            break
        few = F.broadcast if n <= FEW else (lambda df: df)
        last, moves = min(t0 + dwell, steps), t0 + dwell < steps
        free = ~F.array_contains("been", F.col("dst"))
        g = e.join(few(x), ["graph_id", "at"]).groupBy(*key).agg(
            F.count("*").alias("deg"), F.sum("jump").alias("deg_jumps"), F.min(F.struct("weight", "dst", "jump"))["jump"].alias("least_jump"), F.count_if(free).alias("n_free"), F.sort_array(F.collect_list(F.when(~free, F.col("i")))).alias("gone"),
            F.min(F.when(free, F.struct((-F.col("to_p")).alias("p"), "dst", "i")))["i"].alias("top"), F.min(F.when(free, F.struct("weight", "dst", "i")))["i"].alias("light"),
        )
        s = x.join(g, key, "left").fillna(0, ["deg", "deg_jumps", "least_jump", "n_free"])
        s = s.withColumn("n", F.when(quiet, F.least("deg", F.lit(1))).otherwise(F.col("deg")).cast("int")).withColumn("dj", F.when(quiet, F.col("least_jump")).otherwise(F.col("deg_jumps")).cast("int"))
        sees = lambda t: F.exists(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1), lambda k: unit(F.col("seed"), F.col("strategy"), F.lit("see"), t, k) < detection)
        caught = F.lit(None).cast("int")
        for t in range(last, t0, -1):
            caught = F.when(sees(F.lit(t)), t).otherwise(caught)
        pick = F.floor(unit(F.col("seed"), F.lit("go"), F.lit(t0 + dwell + 1)) * F.col("n_free"))
        # the pick-th of the free places: those taken before it shift it by one each
        pick = F.aggregate(F.coalesce("gone", F.array().cast("array<bigint>")), pick, lambda at, v: F.when(v <= at, at + 1).otherwise(at))
        place = F.when(F.col("strategy") == "greedy", F.col("top")).when(quiet, F.col("light")).otherwise(pick)
        s = cut(s.withColumn("caught", caught).withColumn("i", F.when(F.col("caught").isNull() & (F.col("n_free") > 0) & F.lit(moves), place)))
        taken = e.join(few(s.where("i is not null").select(*key, "at", "i")), ["graph_id", "at", "i"]).where("not b").select(*key, F.col("dst").alias("to"), "to_p")
        s = cut(s.select(*key, *kept, "n", "dj", "n_free", "caught").join(taken, key, "left"))
        spent.append(s.withColumns({"t0": F.lit(t0), "last": F.lit(last), "moves": F.lit(moves)}))
        went, stuck = F.col("to").isNotNull(), F.col("n_free") == 0
        x = s.where("caught is null").select(
            *key, F.coalesce("to", "at").alias("at"), F.when(went, F.concat("been", F.array("to"))).otherwise(F.col("been")).alias("been"), (F.col("events") + F.col("n") * (last - t0) + F.when(stuck, F.col("n")).otherwise(0)).alias("events"),
            (F.col("jumps") + F.col("dj") * (last - t0)).alias("jumps"), (F.col("high") | F.coalesce(F.col("to_p") >= HIGH, F.lit(False))).alias("high"),
        )
        x = cut(x)
    r = reduce(DataFrame.unionByName, spent)
    end = F.when(F.col("caught").isNotNull(), steps).otherwise(F.least(F.col("last") + F.col("moves").cast("int"), F.lit(steps)))
    r = r.withColumn("time_step", F.explode(F.sequence(F.col("t0") + 1, end)))
    t, caught = F.col("time_step"), F.col("caught")
    dwelt = F.least(t, F.coalesce(caught, t), "last") - F.col("t0")
    moving = caught.isNull() & F.col("moves") & (t > F.col("last"))
    went = moving & F.col("to").isNotNull()
    events = F.col("events") + F.col("n") * dwelt + F.when(moving & (F.col("n_free") == 0), F.col("n")).otherwise(0)
    jumps = F.col("jumps") + F.col("dj") * dwelt
    score = F.round(0.3 * F.least(F.lit(1.0), events / t / 5) + 0.2 * F.least(F.lit(1.0), jumps / 3), 4)
    return r.select(
        "graph_id", "strategy", "seed", "time_step", F.when(went, F.col("to")).otherwise(F.col("at")).alias("current_node"),
        F.when(t == caught, "DETECTED").when(t > caught, "CONTAINED").when(went, "MOVE").otherwise("DWELL").alias("action"), (F.size("been") + went.cast("int")).alias("n_compromised"), F.coalesce(t == caught, F.lit(False)).alias("detected"),
        F.when(events == 0, "NOMINAL").when(score > 0.8, "LOCKDOWN").when(score > 0.6, "ELEVATED").otherwise("NOMINAL").alias("strictness"), events.cast("int").alias("n_events"), (F.col("high") | (went & F.coalesce(F.col("to_p") >= HIGH, F.lit(False)))).alias("high_reached"),
    )


def outcomes(timeline: DataFrame, dwell: int = 3) -> DataFrame:
    """One row per run: detection and containment step, nodes then and finally, success, mean events a step."""
    g = timeline.groupBy("graph_id", "strategy", "seed").agg(
        F.min(F.when(F.col("action") == "DETECTED", F.col("time_step"))).alias("detected_at"), F.min(F.when(F.col("high_reached"), F.col("time_step"))).alias("high_at"), F.max("time_step").alias("steps"), F.max("n_compromised").alias("n_final"),
        F.max_by("n_events", "time_step").alias("_e"), F.min_by("n_compromised", F.when(F.col("action") == "DETECTED", F.col("time_step"))).alias("n_at_detection"),
    )
    won = F.col("high_at").isNotNull() & (F.col("detected_at").isNull() | (F.col("high_at") <= F.col("detected_at")))
    return g.select("graph_id", "strategy", "seed", "detected_at", F.least(F.col("detected_at") + dwell, "steps").alias("contained_at"), "n_at_detection", "n_final", won.alias("attacker_success"), F.round(F.col("_e") / F.col("steps"), 3).alias("mean_events_per_step"))
