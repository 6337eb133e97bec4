"""Selections, counts and set-based structure of graphs. Every operator works on all graphs of its tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.operators import dense
from quellgraph.runtime import cut, no_rows, place_within


def get_node(nodes: DataFrame, node_id: str, graph_id: str = "g") -> DataFrame:
    found = nodes.where((F.col("graph_id") == graph_id) & (F.col("node_id") == node_id))
    if no_rows(found):
        raise KeyError(node_id)
    return found


def get_edge(edges: DataFrame, src: str, dst: str, graph_id: str = "g") -> DataFrame:
    found = edges.where((F.col("graph_id") == graph_id) & (F.col("src") == src) & (F.col("dst") == dst))
    if no_rows(found):
        raise KeyError(f"{src}->{dst}")
    return found


def nodes_of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def high_privilege(nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Nodes at or above the threshold, highest first."""
    return nodes.where(F.col("privilege_level") >= threshold).orderBy(F.desc("privilege_level"), "ord", "node_id")


def neighbors(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(graph_id, node_id, neighbor)``; ``both`` is the union of both directions as a set."""
    out = edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("neighbor"))
    back = edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("neighbor"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is out, in or both, not {direction}")
    return {"out": out, "in": back, "both": out.unionByName(back).distinct()}[direction]


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The weighted adjacency matrix as coordinates ``(graph_id, i, j, weight)``, 0-based in the order of ``ord``."""
    at = place_within(nodes.select("graph_id", "node_id", "ord"), "graph_id", ["ord", "node_id"]).select("graph_id", "node_id", "i")
    a, b = at.select("graph_id", F.col("node_id").alias("src"), "i"), at.select("graph_id", F.col("node_id").alias("dst"), F.col("i").alias("j"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("graph_id", "i", "j", "weight")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("graph_id", column).agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame, high: float = 0.7) -> DataFrame:
    """One row per graph: counts, mean and largest privilege (0 without nodes), nodes of high privilege."""
    n = nodes.groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"), F.avg("privilege_level").alias("avg_privilege"), F.max("privilege_level").alias("max_privilege"), F.sum(F.when(F.col("privilege_level") >= high, 1).otherwise(0)).alias("n_high")
    )
    m = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.join(m, "graph_id", "full").select("graph_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_edges", "avg_privilege", "max_privilege", "n_high")])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, in_degree, out_degree, degree)``, 0 for nodes without edges."""
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    d = ends.groupBy("graph_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    j = nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left")
    z = [F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")]
    return j.select("graph_id", "node_id", *z).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_entropy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bits of the distribution of total degrees; 0 without edges. From counts per degree, so that nothing is sorted or windowed."""
    d = degrees(nodes, edges).groupBy("graph_id", "degree").agg(F.count("*").alias("n"))
    sums = d.groupBy("graph_id").agg(F.sum(F.col("n") * F.col("degree")).alias("s"), F.sum(F.when(F.col("degree") > 0, F.col("n") * F.col("degree") * F.log2(F.greatest("degree", F.lit(1))))).alias("t"))
    return sums.select("graph_id", F.when(F.col("s") > 0, F.log2("s") - F.coalesce("t", F.lit(0.0)) / F.col("s")).otherwise(0.0).alias("degree_entropy"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = summary(nodes, edges)
    return s.select("graph_id", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"))


def undirected(edges: DataFrame) -> DataFrame:
    """``(graph_id, a, b)`` with a < b, each pair once, without loops."""
    return edges.where("src != dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, triangles)`` for nodes in some triangle.

    Edges are pointed from the end of lower degree to the other, so that even a node with a third of all edges has few edges out
    of it, and the wedges to close stay within m * sqrt(m).
    """
    e = undirected(edges)
    d = e.select("graph_id", F.explode(F.array("a", "b")).alias("v")).groupBy("graph_id", "v").agg(F.count("*").alias("d"))
    e = e.join(d.select("graph_id", F.col("v").alias("a"), F.col("d").alias("da")), ["graph_id", "a"]).join(d.select("graph_id", F.col("v").alias("b"), F.col("d").alias("db")), ["graph_id", "b"])
    first = F.struct("da", "a") < F.struct("db", "b")
    o = cut(e.select("graph_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y")))
    left, right = o.alias("l"), o.alias("r")
    wedges = left.join(right, F.expr("l.graph_id = r.graph_id and l.x = r.x and l.y < r.y")).select("l.graph_id", F.col("l.x").alias("u"), F.col("l.y").alias("v"), F.col("r.y").alias("w"))
    closed = wedges.join(o.select("graph_id", F.least("x", "y").alias("v"), F.greatest("x", "y").alias("w")), ["graph_id", "v", "w"])
    return closed.select("graph_id", F.explode(F.array("u", "v", "w")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, clustering)`` on the undirected graph: 2T / d(d - 1), 0 below degree 2. One task per graph where it fits."""
    fit = cut(dense.small_graphs(nodes, edges))
    out, big = dense.small_clustering(nodes, edges, fit), nodes.join(fit, "graph_id", "left_anti")
    return out.unionByName(clustering_joined(big, edges.join(fit, "graph_id", "left_anti"))) if big.take(1) else out


def clustering_joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`clustering` for graphs of any size."""
    e = undirected(edges)
    d = e.select("graph_id", F.explode(F.array("a", "b")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("d"))
    j = nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").join(triangles(edges), ["graph_id", "node_id"], "left")
    return j.select("graph_id", "node_id", F.when(F.col("d") >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, component)``: the smallest node id of the weakly connected component. One task per graph where it fits."""
    fit = cut(dense.small_graphs(nodes, edges))
    out, big = dense.small_components(nodes, edges, fit), nodes.join(fit, "graph_id", "left_anti")
    return out.unionByName(components_joined(big, edges.join(fit, "graph_id", "left_anti"))) if big.take(1) else out


def components_joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`components` for graphs of any size.

    Alternating large-star and small-star steps until nothing moves: O(log n) rounds whatever the diameter, and each round is one group-by.
    """
    pairs = cut(undirected(edges).select("graph_id", F.col("a").alias("u"), F.col("b").alias("v")))
    before = None
    while True:
        both = pairs.unionByName(pairs.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("graph_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, ["graph_id", "u"]).where("v > u").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select("graph_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        small = down.join(least, ["graph_id", "u"]).where("v != m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("graph_id", "u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("graph_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.groupBy("graph_id", F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return nodes.select("graph_id", "node_id").join(roots, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("component", "node_id").alias("component"))


def keep_strongest(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair: the heaviest, the first among equals, by kind if they are equally early; loops are dropped."""
    rest = [c for c in edges.columns if c not in ("graph_id", "src", "dst")]
    best = edges.where("src != dst").groupBy("graph_id", "src", "dst").agg(F.max_by(F.struct(*rest), F.struct("weight", -F.col("ord"), *[c for c in ("edge_type",) if c in rest])).alias("e"))
    return best.select("graph_id", "src", "dst", *[F.col("e").getField(c).alias(c) for c in rest]).select(*edges.columns)


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the first by ``ord``."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("e"))
    return first.select(*keys, *[F.col("e").getField(c).alias(c) for c in rest]).select(*df.columns)


def merge_absent(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` and those rows of ``new`` whose key it lacks."""
    return have.unionByName(keep_first(new, keys).join(have, keys, "left_anti"), allowMissingColumns=True)


def add_edge(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` whose ends exist; a pair that is there already keeps the heavier of both."""
    for end in ("src", "dst"):
        new = new.join(nodes.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    return keep_strongest(edges.unionByName(new.select(*[c for c in edges.columns if c in new.columns]), allowMissingColumns=True))


def drop_edge(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti").select(*edges.columns)


def drop_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("node_id") != node_id), edges.where((F.col("src") != node_id) & (F.col("dst") != node_id))


def merge_graphs(nodes: DataFrame, edges: DataFrame, into: str) -> tuple[DataFrame, DataFrame]:
    """All graphs as one named ``into``, node ids prefixed by their graph; edge tags don't survive."""
    p = lambda c: F.concat_ws("_", "graph_id", c)
    n = nodes.withColumn("tags", F.map_concat(F.coalesce("tags", F.create_map().cast("map<string,string>")), F.create_map(F.lit("origin"), "graph_id"))).withColumn("node_id", p("node_id"))
    e = edges.withColumn("src", p("src")).withColumn("dst", p("dst")).withColumn("tags", F.lit(None).cast("map<string,string>"))
    return n.withColumn("graph_id", F.lit(into)), e.withColumn("graph_id", F.lit(into))
