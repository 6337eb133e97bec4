"""Graph snapshots as JSON, uploads merged into them, and the files that reports are exported to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.operators.graph import keep_first
from quellgraph.schema import EDGE_TYPES, EDGES, NODE_TYPES, NODES, conform

_STATE = """struct<nodes:array<struct<node_id:string,node_type:string,name:string,privilege_level:double,sensitivity:double,compromise_status:boolean,cascade_risk:double,tags:map<string,string>>>,
edges:array<struct<source:string,target:string,edge_id:string,edge_type:string,weight:double,delegation_depth_limit:int,requires_mfa:boolean,is_conditional:boolean,conditions:string,tags:map<string,string>>>,breach_seed:string>"""


def load_state(docs: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, seeds)`` of JSON snapshots (graph_id, content). Edges without both their ends are left out."""
    d = docs.select("graph_id", F.from_json("content", _STATE).alias("s"))
    n = d.select("graph_id", F.posexplode("s.nodes").alias("ord", "n")).select("graph_id", "ord", "n.*")
    n = n.withColumn("name", F.coalesce("name", "node_id")).withColumn("privilege_level", F.coalesce("privilege_level", F.lit(0.5))).withColumn("sensitivity", F.coalesce("sensitivity", F.lit(0.5)))
    nodes = keep_first(conform(n.fillna({"compromise_status": False, "cascade_risk": 0.0}), NODES), ["graph_id", "node_id"])
    e = d.select("graph_id", F.posexplode("s.edges").alias("ord", "e")).select("graph_id", "ord", "e.*").withColumnsRenamed({"source": "src", "target": "dst"})
    e = e.withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("->", "src", "dst"))).withColumn("edge_type", F.coalesce("edge_type", F.lit("ASSUME_ROLE"))).withColumn("weight", F.coalesce("weight", F.lit(0.7)))
    e = e.withColumn("delegation_depth_limit", F.coalesce("delegation_depth_limit", F.lit(depth))).fillna(False, ["requires_mfa", "is_conditional"])
    for end in ("src", "dst"):
        e = e.join(nodes.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    last = e.groupBy("graph_id", "src", "dst").agg(F.max("ord").alias("ord"))  # a later edge takes the place of an earlier one
    edges = conform(e.join(last, ["graph_id", "src", "dst", "ord"], "left_semi"), EDGES)
    seeds = d.where("s.breach_seed is not null").select("graph_id", F.col("s.breach_seed").alias("node_id"))
    return nodes, edges, seeds


def _in_order(rows: Column) -> Column:
    """By ``ord`` alone: the maps in the rows can't be compared."""
    return F.array_sort(rows, lambda a, b: F.signum(a["ord"] - b["ord"]).cast("int"))


def snapshots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, content)``: each graph as JSON, in the order of insertion. One row per graph, so that a graph beyond a task is an error."""
    from quellgraph.operators.dense import small_graphs

    large = nodes.join(small_graphs(nodes, edges), "graph_id", "left_anti").select("graph_id").take(1)
    if large:
        raise ValueError(f"graph {large[0][0]} doesn't fit one row; export its tables")
    n = nodes.groupBy("graph_id").agg(_in_order(F.collect_list(F.struct("ord", F.struct(*[c for c in nodes.columns if c not in ("graph_id", "ord")]).alias("x")))).alias("n"))
    named = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    e = named.groupBy("graph_id").agg(_in_order(F.collect_list(F.struct("ord", F.struct(*[c for c in named.columns if c not in ("graph_id", "ord")]).alias("x")))).alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct(F.transform("n", lambda r: r["x"]).alias("nodes"), F.coalesce(F.transform("e", lambda r: r["x"]), F.array()).alias("edges"))).alias("content"))


def _clean(c: str) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 2)


def merge_upload(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an upload adds to a snapshot: nodes and edges that it lacks, clamped and rounded to 2 places, unknown types replaced."""
    n = new_nodes.join(nodes, ["graph_id", "node_id"], "left_anti").select(*NODES.names)
    n = n.withColumn("node_type", F.when(F.col("node_type").isin(*NODE_TYPES), F.col("node_type")).otherwise("SERVICE")).withColumn("privilege_level", _clean("privilege_level")).withColumn("sensitivity", _clean("sensitivity"))
    every = conform(nodes, NODES).unionByName(n)
    e = new_edges.join(edges, ["graph_id", "src", "dst"], "left_anti").select(*EDGES.names)
    e = e.withColumn("edge_type", F.when(F.col("edge_type").isin(*EDGE_TYPES), F.col("edge_type")).otherwise("ASSUME_ROLE")).withColumn("weight", _clean("weight"))
    for end in ("src", "dst"):
        e = e.join(every.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi").select(*EDGES.names)
    return every, conform(edges, EDGES).unionByName(e)


def export_csv(df: DataFrame, path: str) -> None:
    """A report of a row per node as CSV with a header, sorted by graph and node in as many files as the sort makes."""
    df.orderBy("graph_id", "node_id").write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_script(snaps: DataFrame, path: str, variable: str = "GRAPH_DATA") -> None:
    """``(graph_id, content)`` as a line of script per graph."""
    snaps.select(F.concat(F.lit(f"window.{variable} = "), "content", F.lit(";")).alias("value")).write.mode("overwrite").text(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Appends scored predictions, in folders by topology so that later reads of one topology skip the rest."""
    rows.write.mode("append").partitionBy("topology_type").parquet(path)


def upsert_weights(spark: SparkSession, weights: DataFrame, path: str) -> None:
    """Replaces the weights of the topologies in ``weights`` and leaves the others; only those folders are written."""
    weights.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topology_type").parquet(path)


def render(rows: DataFrame, columns: list[str], style: str = "markdown", most: int = 1000) -> str:
    """A small result as a Markdown or LaTeX table. Results are aggregates; one of more than ``most`` rows is refused, not cut."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    cells = [[f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in got]
    if style == "markdown":
        return "\n".join(["| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *cells]])
    tex = lambda r: " & ".join(x.replace("_", r"\_").replace("%", r"\%") for x in r) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", r"\toprule", tex(columns), r"\midrule", *map(tex, cells), r"\bottomrule", r"\end{tabular}"])
