"""Synthetic topologies from ``range`` and hashed draws: the structure of each archetype, any number of graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.functions.rng import draw_order, unit
from quellgraph.operators.graph import keep_first
from quellgraph.schema import EDGES, NODES, conform

_IN = (("SERVICE", 0.05, 0.45, "ASSUME_ROLE"), ("USER", 0.05, 0.3, "AUTHENTICATE_AS"), ("WORKLOAD", 0.1, 0.5, "ASSUME_ROLE"))
_OUT = (("SECRET", 0.5, 0.9, "SECRET_READ"), ("DEPLOYMENT", 0.55, 0.9, "DEPLOY_TO"), ("SERVICE", 0.3, 0.7, "TOKEN_MINT"))


def _between(low, high, *parts) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * unit(*parts)


def _whole(low, high, *parts) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (lo + F.floor((hi - lo + 1) * unit(*parts))).cast("int")


def _cycle(i: Column, table: tuple, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(row[k]) for row in table]), (i % len(table) + 1).cast("int"))


def graphs(spark: SparkSession, seeds: list[int] | range, topology: str) -> DataFrame:
    return spark.createDataFrame([(f"{topology.lower()}-{s}", int(s)) for s in seeds], "graph_id string, seed int")


def hub(g: DataFrame, n: int = 40) -> tuple[DataFrame, DataFrame]:
    """One role in the middle; half of the rest points at it, the other half is pointed at; no other edges."""
    inbound = (n - 1) // 2
    r = g.select("graph_id", "seed", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("i")).withColumn("in", F.col("i") <= inbound)
    k = F.when(F.col("in"), F.col("i") - 1).otherwise(F.col("i") - 1 - inbound)
    pick = lambda j: F.when(F.col("in"), _cycle(k, _IN, j)).otherwise(_cycle(k, _OUT, j))
    r = r.withColumn("node_id", F.format_string("n%03d", "i"))
    draw = lambda what, lo, hi: lo + (hi - lo) * unit("seed", "graph_id", F.lit(what), F.col("i")) if isinstance(lo, Column) else _between(lo, hi, "seed", "graph_id", F.lit(what), F.col("i"))
    nodes = r.select("graph_id", F.col("i").alias("ord"), "node_id", pick(0).alias("node_type"), draw("p", pick(1), pick(2)).alias("privilege_level"), F.when(F.col("in"), draw("s", 0.1, 0.5)).otherwise(draw("s", 0.4, 1.0)).alias("sensitivity"))
    middle = g.select("graph_id", F.lit(0).alias("ord"), F.lit("hub").alias("node_id"), F.lit("ROLE").alias("node_type"), F.lit(1.0).alias("privilege_level"), F.lit(1.0).alias("sensitivity"), F.create_map(F.lit("hub"), F.lit("true")).alias("tags"))
    edges = r.select(
        "graph_id", F.col("i").alias("ord"), F.when(F.col("in"), F.col("node_id")).otherwise(F.lit("hub")).alias("src"), F.when(F.col("in"), F.lit("hub")).otherwise(F.col("node_id")).alias("dst"), pick(3).alias("edge_type"),
        F.when(F.col("in"), draw("w", 0.6, 0.95)).otherwise(draw("w", 0.7, 1.0)).alias("weight"), F.when(F.col("in"), _whole(1, 3, "seed", "graph_id", F.lit("d"), F.col("i"))).otherwise(1).alias("delegation_depth_limit"),
        (F.col("in") & (draw("m", 0.0, 1.0) < 0.35)).alias("requires_mfa"), (~F.col("in") & (draw("c", 0.0, 1.0) < 0.3)).alias("is_conditional"),
    )
    return conform(middle, NODES).unionByName(conform(nodes, NODES)), conform(edges, EDGES)


def chain(g: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """A backbone of services with rising privilege, a secret or deployment at its end, roles hanging off it, users at its head and
    the rest of the services attached anywhere."""
    d = lambda what, lo, hi, *k: _between(lo, hi, "seed", "graph_id", F.lit(what), *k)
    g = g.withColumn("len", _whole(8, min(15, n - 5), "seed", "graph_id", F.lit("len"))).withColumn("roles", _whole(1, 2, "seed", "graph_id", F.lit("roles"))).withColumn("users", _whole(2, 3, "seed", "graph_id", F.lit("users")))
    i = F.col("i")
    at = lambda c: F.format_string("c%03d", c)
    back = g.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    end_is_secret = unit("seed", "graph_id", F.lit("end")) < 0.5
    role = g.select("*", F.explode(F.sequence(F.lit(0), F.col("roles") - 1)).alias("i")).withColumn("pos", ((_whole(0, F.col("len") - 3, "seed", "graph_id", F.lit("mid")) + i) % (F.col("len") - 2) + 1).cast("int"))
    user = g.select("*", F.explode(F.sequence(F.lit(0), F.col("users") - 1)).alias("i"))
    left = F.lit(n) - F.col("len") - 1 - F.col("roles") - F.col("users")
    rest = g.where(left > 0).select("*", F.explode(F.sequence(F.lit(0), left - 1)).alias("i")).withColumn("pos", _whole(0, F.col("len") - 1, "seed", "graph_id", F.lit("at"), i))
    kinds = [
        back.select("graph_id", i.alias("ord"), at(i).alias("node_id"), F.lit("SERVICE").alias("node_type"), F.least(F.lit(0.7), 0.1 + 0.06 * i).alias("privilege_level"), d("s", 0.2, 0.6, i).alias("sensitivity"), F.create_map(F.lit("chain_position"), i.cast("string")).alias("tags")),
        g.select("graph_id", F.col("len").alias("ord"), F.lit("end").alias("node_id"), F.when(end_is_secret, "SECRET").otherwise("DEPLOYMENT").alias("node_type"), d("pe", 0.85, 1.0).alias("privilege_level"), d("se", 0.9, 1.0).alias("sensitivity"), F.create_map(F.lit("chain_terminal"), F.lit("true")).alias("tags")),
        role.select("graph_id", (i + 100).alias("ord"), F.format_string("r%03d", i).alias("node_id"), F.lit("ROLE").alias("node_type"), d("pr", 0.5, 0.75, i).alias("privilege_level"), d("sr", 0.4, 0.7, i).alias("sensitivity")),
        user.select("graph_id", (i + 200).alias("ord"), F.format_string("u%03d", i).alias("node_id"), F.lit("USER").alias("node_type"), d("pu", 0.05, 0.25, i).alias("privilege_level"), d("su", 0.1, 0.3, i).alias("sensitivity")),
        rest.select("graph_id", (i + 300).alias("ord"), F.format_string("f%03d", i).alias("node_id"), F.lit("SERVICE").alias("node_type"), d("pf", 0.1, 0.4, i).alias("privilege_level"), d("sf", 0.1, 0.4, i).alias("sensitivity")),
    ]
    links = [
        back.where("i > 0").select("graph_id", i.alias("ord"), at(i - 1).alias("src"), at(i).alias("dst"), F.lit("TOKEN_MINT").alias("edge_type"), d("w", 0.7, 0.95, i).alias("weight"), F.col("len").alias("delegation_depth_limit")),
        g.select("graph_id", F.col("len").alias("ord"), at(F.col("len") - 1).alias("src"), F.lit("end").alias("dst"), F.when(end_is_secret, "SECRET_READ").otherwise("DEPLOY_TO").alias("edge_type"), d("we", 0.8, 1.0).alias("weight"), F.lit(1).alias("delegation_depth_limit")),
        role.select("graph_id", (i + 100).alias("ord"), at(F.col("pos")).alias("src"), F.format_string("r%03d", i).alias("dst"), F.lit("ASSUME_ROLE").alias("edge_type"), d("wr", 0.6, 0.9, i).alias("weight"), F.lit(2).alias("delegation_depth_limit")),
        user.select("graph_id", (i + 200).alias("ord"), F.format_string("u%03d", i).alias("src"), at(F.lit(0)).alias("dst"), F.lit("AUTHENTICATE_AS").alias("edge_type"), d("wu", 0.4, 0.8, i).alias("weight"), F.lit(1).alias("delegation_depth_limit"), (d("mu", 0.0, 1.0, i) < 0.4).alias("requires_mfa")),
        rest.select("graph_id", (i + 300).alias("ord"), at(F.col("pos")).alias("src"), F.format_string("f%03d", i).alias("dst"), F.lit("TOKEN_MINT").alias("edge_type"), d("wf", 0.3, 0.7, i).alias("weight"), F.lit(2).alias("delegation_depth_limit")),
    ]
    return _all(kinds, NODES), _all(links, EDGES)


def _all(parts: list[DataFrame], schema) -> DataFrame:
    out = conform(parts[0], schema)
    for p in parts[1:]:
        out = out.unionByName(conform(p, schema))
    return out


def dense_cluster(g: DataFrame, n: int = 40) -> tuple[DataFrame, DataFrame]:
    """Three or four clusters of 8 to 12 nodes, each node pointing at a third to two thirds of its cluster, and a bridge or two from
    each cluster to the next."""
    key = ["seed", "graph_id"]
    g = g.withColumn("clusters", _whole(3, 4, *key, F.lit("clusters")))
    c = g.select("*", F.explode(F.sequence(F.lit(0), F.col("clusters") - 1)).alias("c")).withColumn("size", _whole(8, F.least(F.lit(12), F.greatest(F.lit(8), F.floor(F.lit(n) / F.col("clusters"))) + 2), *key, F.lit("size"), F.col("c")))
    m = c.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    roll = unit(*key, F.lit("kind"), F.col("c"), F.col("i"))
    d = lambda what, lo, hi, *k: _between(lo, hi, *key, F.lit(what), *k)
    name = lambda cc, ii: F.format_string("k%d_%02d", cc, ii)
    ci = (F.col("c"), F.col("i"))
    nodes = m.select(
        "graph_id", (F.col("c") * 100 + F.col("i")).alias("ord"), name(*ci).alias("node_id"), F.when(roll < 0.6, "SERVICE").when(roll < 0.8, "ROLE").otherwise("SECRET").alias("node_type"),
        F.when(roll < 0.6, d("p", 0.1, 0.55, *ci)).when(roll < 0.8, d("p", 0.5, 0.85, *ci)).otherwise(d("p", 0.4, 0.8, *ci)).alias("privilege_level"), d("s", 0.3, 0.9, *ci).alias("sensitivity"), F.create_map(F.lit("cluster"), F.col("c").cast("string")).alias("tags"),
    )
    m = m.withColumn("k", _whole(F.greatest(F.lit(1), F.floor(F.col("size") / 3)), F.greatest(F.lit(2), F.floor(F.col("size") * 0.65)), *key, F.lit("k"), *ci))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: j != F.col("i")), lambda j: F.struct(draw_order("seed", "graph_id", F.lit("to"), F.col("c"), F.col("i"), j).alias("o"), j.alias("j")))
    e = m.select("*", F.explode(F.slice(F.array_sort(others), F.lit(1), F.col("k"))).alias("t")).withColumn("j", F.col("t.j"))
    cij = (*ci, F.col("j"))
    kinds = F.array(*[F.lit(x) for x in ("ASSUME_ROLE", "TOKEN_MINT", "SECRET_READ", "AUTHENTICATE_AS")])
    inner = e.select(
        "graph_id", (F.col("c") * 10_000 + F.col("i") * 100 + F.col("j")).alias("ord"), name(*ci).alias("src"), name(F.col("c"), F.col("j")).alias("dst"), F.element_at(kinds, _whole(1, 4, *key, F.lit("t"), *cij)).alias("edge_type"),
        d("w", 0.6, 0.95, *cij).alias("weight"), _whole(1, 3, *key, F.lit("d"), *cij).alias("delegation_depth_limit"), (unit(*key, F.lit("c"), *cij) < 0.2).alias("is_conditional"),
    )
    nxt = c.select("graph_id", (F.col("c") - 1).alias("c"), F.col("size").alias("size2"))
    b = c.join(nxt, ["graph_id", "c"]).select("*", F.explode(F.sequence(F.lit(1), _whole(1, 2, *key, F.lit("bridges"), F.col("c")))).alias("b"))
    cb = (F.col("c"), F.col("b"))
    bridge = b.select(
        "graph_id", (F.col("c") * 10 + F.col("b") + 1_000_000).alias("ord"), name(F.col("c"), _whole(0, F.col("size") - 1, *key, F.lit("bs"), *cb)).alias("src"), name(F.col("c") + 1, _whole(0, F.col("size2") - 1, *key, F.lit("bd"), *cb)).alias("dst"),
        F.when(unit(*key, F.lit("bt"), *cb) < 0.5, "ASSUME_ROLE").otherwise("DEPLOY_TO").alias("edge_type"), d("bw", 0.5, 0.8, *cb).alias("weight"), F.lit(1).alias("delegation_depth_limit"), F.create_map(F.lit("bridge"), F.lit("true")).alias("tags"),
    )
    return conform(nodes, NODES), keep_first(_all([inner, bridge], EDGES), ["graph_id", "src", "dst"])


def mixed(g: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """A hub, a chain and clusters of a third each, and a bridge from the first to the second and from there to the third."""
    third = max(10, n // 3)
    parts = {"hub": hub(g, third), "chain": chain(g, third), "cluster": dense_cluster(g, third)}
    nodes, edges = None, None
    for k, (label, (a, b)) in enumerate(parts.items()):
        pre = lambda c: F.concat(F.lit(f"{label}_"), c)  # noqa: B023, E731
        a = a.withColumn("node_id", pre("node_id")).withColumn("ord", F.col("ord") + k * 1_000_000).withColumn("tags", F.map_concat(F.coalesce("tags", F.create_map().cast("map<string,string>")), F.create_map(F.lit("origin"), F.lit(label))))
        b = b.withColumn("src", pre("src")).withColumn("dst", pre("dst")).withColumn("ord", F.col("ord") + k * 10_000_000).withColumn("tags", F.lit(None).cast("map<string,string>"))
        nodes, edges = (a, b) if nodes is None else (nodes.unionByName(a), edges.unionByName(b))
    pick = lambda label, what: nodes.where(F.col("node_id").startswith(f"{label}_")).groupBy("graph_id").agg(F.min_by("node_id", draw_order(F.lit(what), "graph_id", "node_id")).alias(what))
    for k, (a, b) in enumerate((("hub", "chain"), ("chain", "cluster"))):
        j = pick(a, "src").join(pick(b, "dst"), "graph_id")
        j = j.select("graph_id", F.lit(100_000_000 + k).alias("ord"), "src", "dst", F.lit("ASSUME_ROLE").alias("edge_type"), _between(0.4, 0.75, "graph_id", F.lit(f"bridge{k}")).alias("weight"), F.lit(2).alias("delegation_depth_limit"), F.create_map(F.lit("cross_topology_bridge"), F.lit("true")).alias("tags"))
        edges = edges.unionByName(conform(j, EDGES))
    return nodes, edges.withColumn("edge_id", F.concat_ws("->", "src", "dst"))


TOPOLOGIES = {"HUB": hub, "CHAIN": chain, "DENSE_CLUSTER": dense_cluster, "MIXED": mixed}


def generate(spark: SparkSession, topology: str, n: int = 40, seeds: list[int] | range = (42,)) -> tuple[DataFrame, DataFrame]:
    if topology not in TOPOLOGIES:
        raise ValueError(topology)
    return TOPOLOGIES[topology](graphs(spark, seeds, topology), n)
