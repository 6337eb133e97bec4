"""The graph convolution: features by joins, messages by one join and sum per layer, weights trained on the driver.

Training takes small graphs only (the sweeps' synthetic ones); inference is distributed and works on any graph.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellgraph.operators import dense
from quellgraph.operators.graph import clustering, degrees
from quellgraph.operators.traversal import betweenness
from quellgraph.runtime import cut, free, written
from quellgraph.schema import NODE_TYPES

N_FEATURES = 13


def features(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(graph_id, node_id, x)``: seed, privilege, sensitivity, 6 types, both degrees over n - 1, betweenness, clustering."""
    s = seeds.select("graph_id", "node_id").distinct().withColumn("_s", F.lit(1.0))
    n = nodes.groupBy("graph_id").agg(F.greatest(F.lit(1), F.count("*") - 1).alias("_m"))
    on = ["graph_id", "node_id"]
    parts = []
    for f in (degrees, betweenness, clustering):  # what one shuffled is freed before the next one runs
        parts.append(written(f(nodes, edges)))
        free(nodes.sparkSession)
    j = nodes.select(*on, "node_type", "privilege_level", "sensitivity").join(s, on, "left").join(n, "graph_id")
    for part in parts:
        j = j.join(part, on)
    z = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    kinds = [F.when(F.col("node_type") == t, 1.0).otherwise(0.0) for t in NODE_TYPES]
    return j.select(*on, F.array(z("_s"), z("privilege_level"), z("sensitivity"), *kinds, F.col("in_degree") / F.col("_m"), F.col("out_degree") / F.col("_m"), z("betweenness"), z("clustering")).alias("x"))


def _dense(x: Column, w: list[list[float]], b: list[float]) -> Column:
    """A linear layer: rows of ``w`` are outputs. The weights are literals of bounded size."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in w])
    dot = lambda r, i: F.aggregate(F.zip_with(r, x, lambda p, q: p * q), F.get(F.array(*[F.lit(float(v)) for v in b]), i), lambda a, v: a + v)
    return F.transform(rows, dot)


def _spread(h: DataFrame, edges: DataFrame) -> DataFrame:
    """Row-normalised (A + I) h: a node's value is the weighted mean of its own and those it points to."""
    own = h.select("graph_id", "node_id", F.lit(1.0).alias("w"), "x")
    to = edges.select("graph_id", F.col("src").alias("_n"), F.col("dst").alias("node_id"), F.col("weight").alias("w")).join(h, ["graph_id", "node_id"]).select("graph_id", F.col("_n").alias("node_id"), "w", "x")
    parts = own.unionByName(to).select("graph_id", "node_id", "w", F.posexplode("x").alias("k", "v"))
    mean = parts.groupBy("graph_id", "node_id", "k").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return mean.groupBy("graph_id", "node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("x"))  # as long as the layer


def forward(x: DataFrame, edges: DataFrame, weights: dict) -> DataFrame:
    """``(graph_id, node_id, risk)``: two convolutions with ReLU, one output, a sigmoid. Graphs that fit go one to a task, the others by joins."""
    x = written(x.select("graph_id", "node_id", "x"))
    free(x.sparkSession)
    fit = cut(dense.small_graphs(x, edges))

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        place = pd.Series(np.arange(len(v)), index=pd.Index(v["node_id"], dtype=object))
        e = e[e["src"].isin(place.index) & e["dst"].isin(place.index) & e["weight"].notna()]
        src, dst, w = place.reindex(e["src"]).to_numpy(np.int64), place.reindex(e["dst"]).to_numpy(np.int64), e["weight"].to_numpy(float)
        h, total = np.stack(v["x"].to_list()), 1 + np.bincount(src, w, len(v))
        for k in ("1", "2"):
            z = h @ np.array(weights["w" + k]).T + np.array(weights["b" + k])
            h = np.maximum(np.stack([(z[:, i] + np.bincount(src, w * z[dst, i], len(v))) / total for i in range(z.shape[1])], 1), 0.0)
        return pd.DataFrame({"node_id": v["node_id"], "risk": 1 / (1 + np.exp(-(h @ np.array(weights["w3"]).T + np.array(weights["b3"]))[:, 0]))})

    out = dense.per_graph(x.withColumn("ord", F.lit(0)), edges, kernel, "node_id string, risk double", ("x",), fit)
    big = x.join(fit, "graph_id", "left_anti")
    return out.unionByName(forward_joined(big, edges.join(fit, "graph_id", "left_anti"), weights)) if big.take(1) else out


def forward_joined(x: DataFrame, edges: DataFrame, weights: dict) -> DataFrame:
    """:func:`forward` for graphs of any size."""
    h = x
    for k in ("1", "2"):
        h = _spread(h.select("graph_id", "node_id", _dense(F.col("x"), weights["w" + k], weights["b" + k]).alias("x")), edges)
        h = h.select("graph_id", "node_id", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    return h.select("graph_id", "node_id", (1 / (1 + F.exp(-_dense(F.col("x"), weights["w3"], weights["b3"])[0]))).alias("risk"))


def _layers(rng: np.random.Generator, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    p = {}
    for k, (i, o) in enumerate(zip(sizes, sizes[1:], strict=False), 1):
        bound = 1 / np.sqrt(i)
        p[f"w{k}"], p[f"b{k}"] = rng.uniform(-bound, bound, (o, i)), rng.uniform(-bound, bound, o)
    return p


def _loss(p: dict, graphs: list, weight: float) -> tuple[float, dict, list]:
    """Mean weighted cross entropy, its gradient and the probabilities."""
    grad, total, out = {k: np.zeros_like(v) for k, v in p.items()}, 0.0, []
    for x, a, y in graphs:
        z1 = a @ (x @ p["w1"].T + p["b1"])
        h1 = np.maximum(z1, 0)
        z2 = a @ (h1 @ p["w2"].T + p["b2"])
        h2 = np.maximum(z2, 0)
        logit = (h2 @ p["w3"].T + p["b3"])[:, 0]
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out.append(q)
        total -= float(np.mean(weight * y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)))
        d = ((1 - y) * q - weight * y * (1 - q))[:, None] / len(y)
        grad["w3"] += d.T @ h2
        grad["b3"] += d.sum(0)
        d = a.T @ ((d @ p["w3"]) * (z2 > 0))
        grad["w2"] += d.T @ h1
        grad["b2"] += d.sum(0)
        d = a.T @ ((d @ p["w2"]) * (z1 > 0))
        grad["w1"] += d.T @ x
        grad["b1"] += d.sum(0)
    n = max(1, len(graphs))
    return total / n, {k: v / n for k, v in grad.items()}, out


def _macro_f1(probabilities: list, graphs: list, threshold: float) -> float:
    scores = []
    for q, (_, _, y) in zip(probabilities, graphs, strict=True):
        t = q >= threshold
        tp = float((t & (y > 0)).sum())
        scores.append(2 * tp / max(1.0, float(t.sum() + y.sum())))
    return float(np.mean(scores)) if scores else 0.0


def train(graphs: list, held_out: list, *, epochs: int = 80, rate: float = 1e-3, decay: float = 1e-4, weight: float = 3.0, clip: float = 1.0, patience: int = 10, threshold: float = 0.4, seed: int = 42) -> tuple[dict, float]:
    """``(weights, held-out macro F1)`` from (x, normalised adjacency, labels) triples: Adam, positives weighted, gradients clipped,
    the rate halved after 5 epochs without a better F1 and training stopped after ``patience``."""
    rng = np.random.default_rng(seed)
    p = _layers(rng, (N_FEATURES, 64, 32, 1))
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    best, kept, stale, t = -1.0, p, 0, 0
    for _ in range(epochs):
        order = rng.permutation(len(graphs))
        for low in range(0, len(order), 8):
            t += 1
            _, g, _ = _loss(p, [graphs[i] for i in order[low : low + 8]], weight)
            size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            for k in p:
                d = g[k] * min(1.0, clip / max(size, 1e-12)) + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        _, _, q = _loss(p, held_out, weight)
        f1 = _macro_f1(q, held_out, threshold)
        if f1 > best + 1e-6:
            best, kept, stale = f1, {k: w.copy() for k, w in p.items()}, 0
        else:
            stale += 1
            if stale % 5 == 0:
                rate *= 0.5
            if stale >= patience:
                break
    return {k: w.tolist() for k, w in kept.items()}, best


def training_graphs(nodes: DataFrame, edges: DataFrame, x: DataFrame, labels: DataFrame, most: int = 200_000) -> list:
    """Graphs as (x, normalised adjacency, labels) on the driver: for the sweeps' synthetic graphs, tens of nodes each. More than
    ``most`` nodes or edges are refused, not cut."""
    if max(nodes.limit(most + 1).count(), edges.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} nodes or edges; train on fewer graphs")
    n = nodes.join(x, ["graph_id", "node_id"]).join(labels.select("graph_id", "node_id", F.col("compromised").cast("double").alias("y")), ["graph_id", "node_id"]).select("graph_id", "node_id", "x", "y").toPandas()
    e = edges.select("graph_id", "src", "dst", "weight").toPandas()
    out, by = [], dict(list(e.groupby("graph_id")))
    for g, part in n.groupby("graph_id"):
        at = {v: i for i, v in enumerate(part["node_id"])}
        a = np.eye(len(part))
        if g in by:
            a[by[g]["src"].map(at), by[g]["dst"].map(at)] += by[g]["weight"].to_numpy()
        out.append((np.array(part["x"].tolist()), a / a.sum(1, keepdims=True), part["y"].to_numpy()))
    return out


def save(weights: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(weights, f)


def load(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
