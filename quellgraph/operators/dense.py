"""Graphs that fit in a task: one task per graph, many graphs at once, as sparse arrays.

Only graphs of at most ``SMALL_NODES`` nodes and ``SMALL_EDGES`` edges are given to these kernels as rows; larger ones take the
set-based form of the same operator, or are numbered by joins and go to the same kernel as numbers (:func:`by_number`). All forms
give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import cut, free, place_within, written

#: What one task may hold as rows.
SMALL_NODES, SMALL_EDGES = 200_000, 2_000_000
#: Nodes up to which all eigenpairs are computed; beyond, only the leading ones, by iteration to a tolerance.
EIGEN_NODES = 2_000
TOLERANCE = 1e-12


def small_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of graphs that fit a task; one row per graph."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL_NODES)
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    return n.join(m, "graph_id", "left").where(F.coalesce("m", F.lit(0)) <= SMALL_EDGES).select("graph_id")


class Sparse:
    """A graph as arrays: the node ids in the order of ``ord``, and ends and weights of its edges by place; one edge per ordered pair."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.ids = nodes.sort_values(["ord", "node_id"])["node_id"].tolist()
        self.n = len(self.ids)
        place = pd.Series(np.arange(self.n), index=pd.Index(self.ids, dtype=object))
        e = edges.drop_duplicates(["src", "dst"], keep="last")
        a, b = place.reindex(e["src"]).to_numpy(), place.reindex(e["dst"]).to_numpy()
        known = ~(np.isnan(a) | np.isnan(b)) if len(e) else np.zeros(0, bool)
        self.src, self.dst, self.w = a[known].astype(np.int64), b[known].astype(np.int64), e["weight"].to_numpy(float)[known]

    @classmethod
    def placed(cls, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Sparse:
        """A graph whose nodes are known by their places only, which are its ids."""
        a, order = cls.__new__(cls), np.lexsort((dst, src))
        a.ids, a.n, a.src, a.dst, a.w = np.arange(n), n, src[order].astype(np.int64), dst[order].astype(np.int64), w[order]
        return a

    def times(self, x: np.ndarray) -> np.ndarray:
        """A x: every node gets the weighted sum of those it points to."""
        return np.bincount(self.src, self.w * x[self.dst], self.n).astype(float)  # of no edges at all, it is whole numbers

    def back(self, x: np.ndarray) -> np.ndarray:
        """The product with the transpose."""
        return np.bincount(self.dst, self.w * x[self.src], self.n).astype(float)

    def matrix(self) -> np.ndarray:
        a = np.zeros((self.n, self.n))
        a[self.src, self.dst] = self.w
        return a

    def acyclic(self) -> bool:
        """Whether the edges with weight have no circle: nodes without an edge into them are taken away until none is left."""
        on = self.w > 0
        src, dst = self.src[on], self.dst[on]
        order = np.argsort(src, kind="stable")
        to, ends = dst[order].tolist(), np.searchsorted(src[order], np.arange(self.n + 1)).tolist()
        into = np.bincount(dst, minlength=self.n).tolist()
        free = [v for v, k in enumerate(into) if not k]
        for v in free:
            for w in to[ends[v] : ends[v + 1]]:
                into[w] -= 1
                if not into[w]:
                    free.append(w)
        return len(free) == self.n

    def leading(self) -> tuple[float, np.ndarray]:
        """The largest real part of an eigenvalue, and the moduli of its right eigenvector over their largest; 0 and zeros without circles."""
        if not self.n or self.acyclic():
            return 0.0, np.zeros(self.n)
        if self.n <= EIGEN_NODES:
            values, vectors = np.linalg.eig(self.matrix())
            k = int(values.real.argmax())
            v = np.abs(vectors[:, k])
            return float(values[k].real), v / v.max()
        x, top = np.ones(self.n), 1.0
        for _ in range(200_000):  # the shift by I keeps periodic graphs from swinging
            y = self.times(x) + x
            top = y.max()
            y /= top
            move, x = np.abs(y - x).max(), y
            if move < TOLERANCE:
                break
        return float(top - 1), x

    def gap(self, symmetrize: str) -> float:
        """Between the two largest eigenvalues of the symmetric matrix."""
        if self.n < 2:
            return 0.0
        if symmetrize == "lower":
            keep = self.src >= self.dst
            i, j, w = self.src[keep], self.dst[keep], self.w[keep]
            off = i != j
            rows, cols, w = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([w, w[off]])
        else:
            rows, cols, w = np.concatenate([self.src, self.dst]), np.concatenate([self.dst, self.src]), np.concatenate([self.w, self.w]) / 2
        if self.n <= EIGEN_NODES:
            s = np.zeros((self.n, self.n))
            np.add.at(s, (rows, cols), w)
            values = np.sort(np.linalg.eigvalsh(s))
            return max(0.0, float(values[-1] - values[-2]))
        return _top_gap(lambda x: np.stack([np.bincount(rows, w * x[cols, c], self.n).astype(float) for c in range(x.shape[1])], 1), self.n)


#: What the largest two eigenvalues are off at most, as a part of their size beyond 1.
GAP_TOLERANCE = 1e-8


def _top_gap(times: Callable[[np.ndarray], np.ndarray], n: int, block: int = 4) -> float:
    """The gap of the two largest eigenvalues of a symmetric matrix, equal ones too: the best of a block of vectors, their residuals and their last
    moves (locally optimal conjugate gradients), for as many steps as the residuals of both take."""
    b = min(block, n)
    q, first = np.linalg.qr(np.random.default_rng(1).standard_normal((n, b)))[0], True
    while True:
        image = times(q)
        values, c = np.linalg.eigh(q.T @ image)
        values, c = values[-b:], c[:, -b:]
        x = q @ c
        rest = image @ c - x * values
        size = np.linalg.norm(rest, axis=0)
        if size[-2:].max() <= GAP_TOLERANCE * max(1.0, np.abs(values).max()):
            return max(0.0, float(values[-1] - values[-2]))
        parts = [x, rest / np.maximum(size, 1e-300)] + ([] if first else [q[:, b:] @ c[b:]])
        q, first = np.linalg.qr(np.hstack(parts))[0], False


def per_graph(nodes: DataFrame, edges: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, columns: tuple[str, ...] = (), fit: DataFrame | None = None, edge_columns: tuple[str, ...] = (), beyond: Callable[[Sparse, dict[str, np.ndarray]], pd.DataFrame] | None = None) -> DataFrame:
    """``kernel(nodes, edges)`` for every small graph, or those of ``fit``; ``columns`` are those of the nodes that it needs besides id and
    ord, ``edge_columns`` those of the edges besides ends and weight. All other graphs go to ``beyond`` by :func:`by_number`; without it
    they have no rows, and the caller gives them another form."""
    if fit is None:
        fit = cut(small_graphs(nodes, edges)) if beyond else small_graphs(nodes, edges)
    n = nodes.select("graph_id", "node_id", "ord", *columns).join(fit, "graph_id", "left_semi")
    e = edges.select("graph_id", "src", "dst", "weight", *edge_columns).join(fit, "graph_id", "left_semi")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = kernel(a, b)
        out.insert(0, "graph_id", key[0])
        return out

    out = n.groupBy("graph_id").cogroup(e.groupBy("graph_id")).applyInPandas(run, f"graph_id string, {schema}")
    if beyond and (big := nodes.join(fit, "graph_id", "left_anti")).take(1):
        out = out.unionByName(by_number(big, edges.join(fit, "graph_id", "left_anti"), beyond, schema, columns))
    return out


def by_number(nodes: DataFrame, edges: DataFrame, kernel: Callable[[Sparse, dict[str, np.ndarray]], pd.DataFrame], schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(graph, values)`` for graphs of which a task can't hold the rows: their nodes are numbered and their edges joined with the
    numbers, so that the task gets 16 bytes an edge and no text. ``values`` are the ``columns`` of the nodes by place; a ``node_id`` that the
    kernel gives is a place, and becomes the id."""
    last = F.coalesce("ord", F.lit(2**63 - 1)).alias("ord")
    at = cut(place_within(nodes.select("graph_id", "node_id", last, *columns), "graph_id", ["ord", "node_id"], "place"))
    e = edges.dropDuplicates(["graph_id", "src", "dst"]).select("graph_id", "src", "dst", "weight")
    for end in ("src", "dst"):
        e = e.join(at.select("graph_id", F.col("node_id").alias(end), F.col("place").alias(f"{end}_place")), ["graph_id", end])

    def bytes_of(df: DataFrame, of_edges: bool, places: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for g, rows in batch.groupby("graph_id", sort=False):
                    cells = [rows[c].to_numpy(np.int32).tobytes() for c in places] + [rows[c].to_numpy(float).tobytes() for c in numbers]
                    yield pd.DataFrame({"graph_id": [g], "of_edges": [of_edges], "cells": [cells]})

        return df.select("graph_id", *places, *numbers).mapInPandas(pack, "graph_id string, of_edges boolean, cells array<binary>")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        def joined(of_edges: bool, i: int, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x[i], kind) for x in p.loc[p["of_edges"] == of_edges, "cells"])])

        order = np.argsort(joined(False, 0, np.int32))
        values = {c: joined(False, i, float)[order] for i, c in enumerate(columns, 1)}
        out = kernel(Sparse.placed(len(order), joined(True, 0, np.int32), joined(True, 1, np.int32), joined(True, 2, float)), values)
        out.insert(0, "graph_id", key[0])
        return out

    parts = bytes_of(at, False, ("place",), columns).unionByName(bytes_of(e, True, ("src_place", "dst_place"), ("weight",)))
    out = parts.groupBy("graph_id").applyInPandas(run, f"graph_id string, {schema.replace('node_id string', 'node_id bigint')}")
    if "node_id" not in out.columns:
        return out
    ids = at.select("graph_id", F.col("node_id").alias("_id"), F.col("place").alias("node_id"))
    return out.join(ids, ["graph_id", "node_id"]).withColumn("node_id", F.col("_id")).select(*out.columns)


def spectral_gap(nodes: DataFrame, edges: DataFrame, symmetrize: str = "lower", fit: DataFrame | None = None) -> DataFrame:
    """``(graph_id, spectral_gap)``: the two largest eigenvalues of the symmetric matrix, from the lower triangle mirrored
    (``lower``) or the mean with the transpose (``avg``); 0 below two nodes. For graphs of any size."""
    frame = lambda a: pd.DataFrame({"spectral_gap": [a.gap(symmetrize)]})
    return per_graph(nodes, edges, lambda n, e: frame(Sparse(n, e)), "spectral_gap double", (), fit, (), lambda a, _: frame(a))


def spectral_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, lambda_max, vector)`` of :meth:`Sparse.leading`."""

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = Sparse(n, e)
        value, vector = a.leading()
        return pd.DataFrame({"node_id": a.ids, "lambda_max": value, "vector": vector})

    return per_graph(nodes, edges, kernel, "node_id string, lambda_max double, vector double")


def component_roots(n: int, src: list[int], dst: list[int]) -> list[int]:
    """The smallest place of each node's component, directions aside."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(src, dst, strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def component_places(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """:func:`component_roots` of arrays: the roots at both ends of an edge are tied, the larger to the smaller, until all are the same."""
    root = np.arange(n)
    while True:
        a, b = root[src], root[dst]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def small_components(nodes: DataFrame, edges: DataFrame, fit: DataFrame) -> DataFrame:
    """``(graph_id, node_id, component)``: the smallest node id of the weakly connected component."""

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = Sparse(v, e)
        roots = component_roots(a.n, a.src.tolist(), a.dst.tolist())
        return pd.DataFrame({"node_id": a.ids, "component": [a.ids[r] for r in roots]})

    return per_graph(nodes.select("graph_id", "node_id", F.lit(0).alias("ord")), edges.withColumn("weight", F.lit(1.0)), kernel, "node_id string, component string", (), fit)


def _clustering(a: Sparse) -> np.ndarray:
    """2T / d(d - 1) of each node in the undirected graph, 0 below degree 2."""
    near: list[set[int]] = [set() for _ in range(a.n)]
    for x, y in zip(a.src.tolist(), a.dst.tolist(), strict=True):
        if x != y:
            near[x].add(y)
            near[y].add(x)
    rank = sorted(range(a.n), key=lambda v: (len(near[v]), v))
    place = [0] * a.n
    for i, v in enumerate(rank):
        place[v] = i
    later = [{w for w in near[v] if place[w] > place[v]} for v in range(a.n)]  # at most sqrt(2m) each
    triangles = [0] * a.n
    for v in range(a.n):
        for w in later[v]:
            for u in later[v] & later[w]:
                triangles[v] += 1
                triangles[w] += 1
                triangles[u] += 1
    return np.array([2.0 * t / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for t, s in zip(triangles, near, strict=True)])


def small_clustering(nodes: DataFrame, edges: DataFrame, fit: DataFrame) -> DataFrame:
    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = Sparse(v, e)
        return pd.DataFrame({"node_id": a.ids, "clustering": _clustering(a)})

    return per_graph(nodes, edges.withColumn("weight", F.lit(1.0)), kernel, "node_id string, clustering double", (), fit)


def structure(nodes: DataFrame, edges: DataFrame, fit: DataFrame) -> DataFrame:
    """``(graph_id, n_nodes, degree_entropy, density, clustering, spectral_gap)``: the parts of a fingerprint that need no paths, in one task per graph."""

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = Sparse(v, e)
        degree = np.bincount(a.src, minlength=a.n) + np.bincount(a.dst, minlength=a.n)
        p = degree[degree > 0] / max(1, degree.sum())
        density = len(a.src) / (a.n * (a.n - 1)) if a.n > 1 else 0.0
        return pd.DataFrame({"n_nodes": [a.n], "degree_entropy": [max(0.0, float(-(p * np.log2(p)).sum()))], "density": [density], "clustering": [float(_clustering(a).mean()) if a.n else 0.0], "spectral_gap": [a.gap("lower")]})

    return per_graph(nodes, edges, kernel, "n_nodes bigint, degree_entropy double, density double, clustering double, spectral_gap double", (), fit)


#: Sources x (nodes + edges) that one task counts the shortest paths of, and into how many tasks a graph is dealt at most: each holds all its edges.
TASK_PATHS, PATH_PARTS = 200_000_000, 24
#: (Source, edge) pairs and words of (source, edge) bits that a task holds at once.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 1_500_000, 2_000_000
#: Levels up to which all nodes are looked at in every level.
WIDE_LEVELS = 64


def path_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, parts)``: graphs whose shortest paths tasks count that hold all their edges and a part of their nodes as sources."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    parts = F.least(F.ceil(F.col("n") * (F.col("n") + F.coalesce("m", F.lit(0))) / TASK_PATHS), F.lit(PATH_PARTS))
    small = (F.col("n") <= SMALL_NODES) & (F.coalesce("m", F.lit(0)) <= SMALL_EDGES)
    return n.join(m, "graph_id", "left").where(small).select("graph_id", parts.cast("int").alias("parts"))


def _adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges without loops and repeats, by source: where each node's start, the other ends, each node's number."""
    pairs = np.unique((src * n + dst)[src != dst])
    src, dst = pairs // max(n, 1), pairs % max(n, 1)
    at = np.searchsorted(src, np.arange(n + 1))
    return at[:-1], dst, np.diff(at)


def _shortest(n: int, at: np.ndarray, to: np.ndarray, degree: np.ndarray, sources: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Brandes from all ``sources`` at once, level by level; a place is (number of the source) x n + node. Adds the dependencies to
    ``score`` and gives the sums of the distances and the numbers of other nodes reached, by source."""
    k = len(sources)
    own = np.arange(k) * n + sources
    dist, sigma = np.full(k * n, -1, np.int32), np.zeros(k * n)
    dist[own], sigma[own] = 0, 1.0
    total, found = np.zeros(k, np.int64), np.zeros(k, np.int64)
    front, row, level, steps = own, np.arange(k), 0, []
    while len(front):
        level += 1
        node = front - row * n
        deg = degree[node]
        i = np.repeat(np.arange(len(front)), deg)
        places = to[np.arange(len(i)) + (at[node] - np.cumsum(deg) + deg)[i]] + (row * n)[i]
        new = dist[places] < 0
        by, places = front[i[new]], places[new]
        dist[places] = level
        if len(places) > k * n // 4:
            sigma += np.bincount(places, sigma[by], k * n)
        else:
            np.add.at(sigma, places, sigma[by])
        front = np.unique(places) if len(places) < k * n // 16 else np.flatnonzero(dist == level)
        row = front // n
        steps.append((by, places))
        here = np.bincount(row, minlength=k)
        found += here
        total += level * here
    delta = np.zeros(k * n)
    for by, places in reversed(steps):
        np.add.at(delta, by, (1 + delta[places]) / sigma[places] * sigma[by])
    delta[own] = 0.0
    score += delta.reshape(k, n).sum(0)
    return total, found


def _path_sums(n: int, at: np.ndarray, to: np.ndarray, degree: np.ndarray, sources: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_shortest` of any number of sources."""
    total, found = np.zeros((2, len(sources)), np.int64)
    step = max(1, PAIRS_AT_ONCE // max(1, n + len(to)))
    for low in range(0, len(sources), step):
        total[low : low + step], found[low : low + step] = _shortest(n, at, to, degree, sources[low : low + step], score)
    return total, found


def _distance_sums(n: int, at: np.ndarray, to: np.ndarray, degree: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The sum of the distances to all nodes reached, by source; a bit per source and node, or :func:`_shortest` where there are many levels."""
    out, words = np.zeros(len(sources), np.int64), max(1, WORDS_AT_ONCE // (n + len(to)))
    some = np.flatnonzero(degree)
    for low in range(0, len(sources), 64 * words):
        part = sources[low : low + 64 * words]
        bits = np.zeros((n, -(-len(part) // 64) * 8), np.uint8)
        j = np.arange(len(part))
        bits[part, j // 8] = np.uint8(128) >> (j % 8).astype(np.uint8)
        front = bits.view(np.uint64)
        seen, level, far = front.copy(), 0, False
        while len(some):
            level += 1
            if far := level > WIDE_LEVELS:
                break
            near = np.zeros_like(front)
            near[some] = np.bitwise_or.reduceat(front[to], at[some], axis=0)
            near &= ~seen
            moved = near[near.any(1)]
            if not len(moved):
                break
            seen |= near
            front = near
            for i in range(0, len(moved), 4_096):
                out[low : low + len(part)] += level * np.unpackbits(moved[i : i + 4_096].view(np.uint8), axis=1)[:, : len(part)].sum(0, dtype=np.int64)
        if far:
            out[low : low + len(part)] = _path_sums(n, at, to, degree, part, np.zeros(n))[0]
    return out


def packed(nodes: DataFrame, edges: DataFrame, fit: DataFrame, columns: tuple[str, ...] = (), edge_columns: tuple[str, ...] = ()) -> DataFrame:
    """``(graph_id, parts, ids, n, src, dst, *columns, *edge_columns)``, one row per graph of ``fit`` (graph_id, parts), written: the sorted ids of its
    ``n`` nodes, behind them those of ends that are no nodes; the ends of its edges as places among them (int32); and the ``columns`` of nodes
    and edges as doubles, all as bytes. Whoever deals a graph to many tasks sends this and not its rows."""

    def run(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node_id")
        ids = v["node_id"].tolist()
        ids += sorted(set(e["src"]).union(e["dst"]).difference(ids))
        place = pd.Series(np.arange(len(ids), dtype=np.int32), index=pd.Index(ids, dtype=object))
        row = {"graph_id": key[0], "parts": int(v["parts"].iloc[0]) if len(v) else 0, "ids": ids, "n": len(v)}
        row |= {c: place.reindex(e[c]).to_numpy(np.int32).tobytes() for c in ("src", "dst")}
        row |= {c: v[c].to_numpy(float).tobytes() for c in columns} | {c: e[c].to_numpy(float).tobytes() for c in edge_columns}
        return pd.DataFrame([row] if len(v) else [], columns=list(row))

    n = nodes.select("graph_id", "node_id", *columns).join(fit, "graph_id")
    e = edges.where("src is not null and dst is not null").select("graph_id", "src", "dst", *edge_columns).join(fit, "graph_id", "left_semi")
    kinds = "".join(f", {c} binary" for c in ("src", "dst", *columns, *edge_columns))
    return written(n.groupBy("graph_id").cogroup(e.groupBy("graph_id")).applyInPandas(run, f"graph_id string, parts int, ids array<string>, n int{kinds}"))


#: Tasks that parts of graphs are dealt to; each has few bytes and much work, so that they mustn't be put together by size.
DEALT = 48


def dealt(graphs: DataFrame, run: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` for every ``part`` from 0 to ``parts`` - 1 of the rows of ``graphs``, which it gets one at a time."""
    each = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.repartition(DEALT, "graph_id", "part").groupBy("graph_id", "part").applyInPandas(run, schema)


def of_nodes(graphs: DataFrame, parts: DataFrame, run: Callable[[pd.Series, pd.DataFrame], dict], schema: str) -> DataFrame:
    """A row per node of what ``run`` makes of a graph's packed row and its parts, which it gets in order."""

    def kernel(key: tuple, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"graph_id": key[0], **run(g.iloc[0], p.sort_values("part"))})

    return graphs.groupBy("graph_id").cogroup(parts.groupBy("graph_id")).applyInPandas(kernel, f"graph_id string, {schema}")


def _largest_place(n: int, ids: list[str], src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which of the ``n`` nodes are in the largest weak component, of equally large ones that with the last first id."""
    known = (src < n) & (dst < n)
    roots = component_places(n, src[known], dst[known])
    size = np.bincount(roots, minlength=n)
    return roots == max(np.flatnonzero(size == size.max()), key=lambda i: ids[i])


def _strong(src: np.ndarray, dst: np.ndarray, inside: np.ndarray) -> bool:
    """Whether all places ``inside`` reach each other."""
    for a, b in ((src, dst), (dst, src)):
        at, to, degree = _adjacency(len(inside), a, b)
        seen, front = np.zeros(len(inside), bool), np.flatnonzero(inside)[:1]
        seen[front] = True
        while len(front):
            deg = degree[front]
            near = to[np.arange(deg.sum()) + np.repeat(at[front] - np.cumsum(deg) + deg, deg)]
            front = np.unique(near[~seen[near]])
            seen[front] = True
        if not seen[inside].all():
            return False
    return True


def path_counts(nodes: DataFrame, edges: DataFrame, fit: DataFrame | None = None, sums: bool = True) -> DataFrame:
    """``(graph_id, node_id, betweenness, directed_sum, directed_pairs, undirected_sum)``: per node as source, the sums of distances
    and the number of nodes reached, 0 without ``sums``. For graphs of :func:`path_graphs`; every part of the sources is a task."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, src, dst, sources = _unpacked(g.iloc[0])
        score, found = np.zeros(n), np.zeros((3, len(sources)), np.int64)
        found[0], found[1] = _path_sums(n, *_adjacency(n, src, dst), sources, score)
        if sums:
            found[2] = _distance_sums(n, *_adjacency(n, np.concatenate([src, dst]), np.concatenate([dst, src])), sources)
        return pd.DataFrame({"graph_id": [key[0]], "part": [key[1]], "score": [score.tobytes()], "found": [found.tobytes() if sums else None]})

    def total(g: pd.Series, p: pd.DataFrame) -> dict:
        score, n = sum(np.frombuffer(x) for x in p["score"]), int(g["n"])
        found = np.zeros((3, len(score)), np.int64)
        for part, x in zip(p["part"], p["found"], strict=True) if sums else ():
            found[:, part : n : len(p)] = np.frombuffer(x, np.int64).reshape(3, -1)
        kept = (score > 0) | (np.arange(len(score)) < n)
        d, pairs, u = found[:, kept]
        return {"node_id": np.asarray(g["ids"], object)[kept], "betweenness": score[kept] * (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0), "directed_sum": d, "directed_pairs": pairs, "undirected_sum": u}

    graphs = packed(nodes, edges, path_graphs(nodes, edges) if fit is None else fit)
    free(nodes.sparkSession)
    parts = dealt(graphs.select("graph_id", "parts", "n", F.size("ids").alias("all"), "src", "dst"), run, "graph_id string, part int, score binary, found binary")
    return of_nodes(graphs.select("graph_id", "ids", "n"), parts, total, "node_id string, betweenness double, directed_sum bigint, directed_pairs bigint, undirected_sum bigint")


def _unpacked(g: pd.Series) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of all places, the ends of the edges, and the sources of a dealt row's part."""
    src, dst = (np.frombuffer(g[c], np.int32).astype(np.int64) for c in ("src", "dst"))
    return int(g["all"]), src, dst, np.arange(int(g["part"]), int(g["n"]), int(g["parts"]))


def path_totals(nodes: DataFrame, edges: DataFrame, fit: DataFrame, variance: bool = True) -> DataFrame:
    """``(graph_id, avg_path_length, centrality_variance)`` as of :func:`quellgraph.operators.traversal.paths`, of the graphs of ``fit``; the variance is
    null unless asked for, as betweenness takes most of the time."""

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g in batch.to_dict("records"):
                src, dst = (np.frombuffer(g[c], np.int32).astype(np.int64) for c in ("src", "dst"))
                inside = np.zeros(len(g["ids"]), bool)
                inside[: g["n"]] = _largest_place(g["n"], list(g["ids"]), src, dst)
                rows.append({c: g[c] for c in ("graph_id", "parts", "n", "src", "dst")} | {"all": len(inside), "inside": np.packbits(inside).tobytes(), "k": int(inside.sum()), "strong": _strong(src, dst, inside)})
            yield pd.DataFrame(rows, columns=["graph_id", "parts", "n", "all", "src", "dst", "inside", "k", "strong"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.iloc[0]
        n, src, dst, sources = _unpacked(g)
        inside = sources[np.unpackbits(np.frombuffer(g["inside"], np.uint8), count=n).astype(bool)[sources]]
        a, b = (src, dst) if g["strong"] else (np.concatenate([src, dst]), np.concatenate([dst, src]))
        dist, score = int(_distance_sums(n, *_adjacency(n, a, b), inside).sum()) if g["k"] > 1 else 0, np.zeros(n if variance else 0)
        if variance:
            _path_sums(n, *_adjacency(n, src, dst), sources, score)
        return pd.DataFrame({"graph_id": [key[0]], "n": [g["n"]], "k": [g["k"]], "dist": [dist], "score": [score.tobytes()]})

    def total(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        n, k = int(p["n"].iloc[0]), int(p["k"].iloc[0])
        score = sum(np.frombuffer(x) for x in p["score"])
        score = np.concatenate([score[:n], score[n:][score[n:] > 0]]) * (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0)
        return pd.DataFrame({"graph_id": [key[0]], "avg_path_length": [p["dist"].sum() / (k * (k - 1)) if k > 1 else 0.0], "centrality_variance": [score.var() if variance else None]})

    graphs = packed(nodes, edges, fit)
    free(nodes.sparkSession)
    each = graphs.mapInPandas(largest, "graph_id string, parts int, n int, all int, src binary, dst binary, inside binary, k int, strong boolean")
    parts = dealt(each, run, "graph_id string, n int, k int, dist bigint, score binary")
    return parts.groupBy("graph_id").applyInPandas(total, "graph_id string, avg_path_length double, centrality_variance double")


#: Nodes up to which the pairs of a layout are added up one by one; beyond, those of far cells are summed by expansions.
PAIR_NODES = 500
#: Terms of an expansion, which leave less than 1e-14 of what a cell adds at NEAR + 1 cells or more; and pairs of near nodes held at once.
TERMS, NEAR, PAIRS_HELD = 28, 2, 500_000
#: Squared distance below which nodes push each other no harder.
CLOSEST = 1e-4


def _repel_pairs(place: np.ndarray, force: float) -> np.ndarray:
    """``force`` x the sum over all other nodes of the vector from them over its squared length."""
    out, (x, y) = np.empty_like(place), place.T.copy()
    for at in range(0, len(place), 1_000):  # so that no matrix of all pairs is held
        dx, dy = x[at : at + 1_000, None] - x, y[at : at + 1_000, None] - y
        over = force / np.maximum(dx * dx + dy * dy, CLOSEST)
        out[at : at + 1_000, 0], out[at : at + 1_000, 1] = (dx * over).sum(1), (dy * over).sum(1)
    return out


class Cells:
    """:func:`_repel_pairs` of many nodes to rounding, not from all pairs: the sum is the conjugate of that of 1 / (z - z_j), and nodes of a cell at
    least NEAR + 1 cells off enter by the powers of their places in it (fast multipole method on a grid, cells meeting by Fourier transform)."""

    def __init__(self, n: int):
        self.c = c = 2 ** min(7, max(3, round(math.log2(n / 4) / 2)))
        j = np.arange(2 * c)
        j = np.where(j < c, j, j - 2 * c)
        step = np.abs(j)
        far = (np.maximum(step[:, None], step[None]) > NEAR) & (step < c)[:, None] & (step < c)[None]
        over = np.where(far, 1 / np.where(far, j[None] + 1j * j[:, None], 1), 0)
        power, kernel = over.copy(), []
        for m in range(2 * TERMS - 1):
            kernel.append(np.fft.fft2(power).ravel() * math.factorial(m))
            power = power * over
        self.kernel, self.share = np.array(kernel), np.array([1 / math.factorial(m) for m in range(TERMS)])

    def repel(self, place: np.ndarray, force: float) -> np.ndarray:
        c, n = self.c, len(place)
        low = place.min(0)
        width = max(float((place.max(0) - low).max()), 1e-9) / c
        at = (place - low) / width
        cell = np.minimum(at.astype(np.int64), c - 1)
        order = np.argsort(cell[:, 1] * c + cell[:, 0], kind="stable")
        at, (col, row), (x, y) = at[order], cell[order].T.copy(), place[order].T.copy()
        number = row * c + col
        inside = (at[:, 0] - col - 0.5) + 1j * (at[:, 1] - row - 0.5)
        sums, power = np.zeros((TERMS, 2 * c, 2 * c), complex), np.ones(n, complex)
        for i in range(TERMS):
            sums[i, :c, :c] = (np.bincount(number, power.real, c * c) + 1j * np.bincount(number, power.imag, c * c)).reshape(c, c)
            power = power * inside
        sums = np.fft.fft2(sums).reshape(TERMS, -1) * self.share[:, None]
        far = np.zeros(n, complex)
        for i in reversed(range(TERMS)):
            term = np.einsum("kf,kf->f", sums, self.kernel[i : i + TERMS]) * self.share[i] * (-1) ** i
            far = far * inside + np.fft.ifft2(term.reshape(2 * c, 2 * c))[:c, :c].ravel()[number]
        out = np.stack([far.real, -far.imag], 1) / width
        start = np.searchsorted(number, np.arange(c * c + 1))
        for up in range(-NEAR, NEAR + 1):  # the cells of a row that are near lie side by side
            there = (row + up >= 0) & (row + up < c)
            base = np.where(there, row + up, 0) * c
            first = start[base + np.maximum(col - NEAR, 0)]
            count = np.where(there, start[base + np.minimum(col + NEAR, c - 1) + 1] - first, 0)
            total, a = np.cumsum(count), 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_HELD, "right")))
                k = count[a:b]
                i = np.repeat(np.arange(a, b), k)
                j = np.arange(len(i)) + np.repeat(first[a:b] - np.cumsum(k) + k, k)
                dx, dy = x[i] - x[j], y[i] - y[j]
                over = 1 / np.maximum(dx * dx + dy * dy, CLOSEST)
                out[a:b, 0] += np.bincount(i - a, dx * over, b - a)
                out[a:b, 1] += np.bincount(i - a, dy * over, b - a)
                a = b
        back = np.empty_like(out)
        back[order] = out * force
        return back


def layout(nodes: DataFrame, edges: DataFrame, k: float = 2.0, rounds: int = 50, seed: int = 42) -> DataFrame:
    """``(graph_id, node_id, x, y, z)``: a spring layout scaled to -10..10 in which every pair of nodes repels, and 10 x privilege as height; for
    graphs of any size."""

    def frame(a: Sparse, privilege: np.ndarray) -> pd.DataFrame:
        linked = (a.src != a.dst) & (a.w > 0)
        pairs = np.unique(np.minimum(a.src, a.dst)[linked] * a.n + np.maximum(a.src, a.dst)[linked])
        i, j = pairs // max(a.n, 1), pairs % max(a.n, 1)
        place = np.random.default_rng(seed).random((a.n, 2))
        repel = _repel_pairs if a.n <= PAIR_NODES else Cells(a.n).repel
        for step in range(rounds):
            move = repel(place, k * k)
            away = place[i] - place[j]
            pull = away * np.maximum(np.sqrt((away**2).sum(-1, keepdims=True)), 0.01) / k
            for c in (0, 1):
                move[:, c] += (np.bincount(j, pull[:, c], a.n) - np.bincount(i, pull[:, c], a.n)).astype(float)
            length = np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 0.01)
            place = place + move / length * 0.1 * (1 - step / (rounds + 1))
        low, high = (place.min(0), place.max(0)) if a.n else (0.0, 0.0)
        place = np.where(high > low, (place - low) / np.where(high > low, high - low, 1) * 20 - 10, 0.0)
        return pd.DataFrame({"node_id": a.ids, "x": place[:, 0].round(4), "y": place[:, 1].round(4), "z": (10 * np.where(np.isnan(privilege), 0.0, privilege)).round(4)})

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = Sparse(v, e)
        return frame(a, v.set_index("node_id").loc[a.ids, "privilege_level"].to_numpy(float))

    return per_graph(nodes, edges, kernel, "node_id string, x double, y double, z double", ("privilege_level",), None, (), lambda a, values: frame(a, values["privilege_level"]))
