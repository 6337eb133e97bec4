"""Nodes and edges of typed, directed, weighted graphs, many graphs to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPES = ("USER", "SERVICE", "ROLE", "WORKLOAD", "SECRET", "DEPLOYMENT")
EDGE_TYPES = ("ASSUME_ROLE", "TOKEN_MINT", "SECRET_READ", "DEPLOY_TO", "AUTHENTICATE_AS")
TOPOLOGIES = ("HUB", "CHAIN", "DENSE_CLUSTER", "MIXED")
MODELS = ("graph_traversal", "epidemic", "spectral_cascade", "percolation", "control_system", "gnn")

#: ``ord`` is the order of insertion: it fixes matrix order and the order among ties.
NODES = T.StructType([
    T.StructField("graph_id", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("node_id", T.StringType()), T.StructField("node_type", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("privilege_level", T.DoubleType()), T.StructField("sensitivity", T.DoubleType()), T.StructField("compromise_status", T.BooleanType()), T.StructField("cascade_risk", T.DoubleType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
EDGES = T.StructType([
    T.StructField("graph_id", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("edge_id", T.StringType()),
    T.StructField("edge_type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("delegation_depth_limit", T.IntegerType()), T.StructField("requires_mfa", T.BooleanType()),
    T.StructField("is_conditional", T.BooleanType()), T.StructField("conditions", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
_DEFAULTS = {"compromise_status": False, "cascade_risk": 0.0, "requires_mfa": False, "is_conditional": False, "ord": 0, "delegation_depth_limit": 1, "graph_id": "g"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its types; absent ones get their default or null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def check(nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
    """What breaks the model: unknown types, repeated nodes or edges, edges without their ends. One pass each, counts only."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return {
        "node_type": nodes.where(~F.col("node_type").isin(*NODE_TYPES)).count(),
        "edge_type": edges.where(~F.col("edge_type").isin(*EDGE_TYPES)).count(),
        "repeated_nodes": nodes.groupBy("graph_id", "node_id").count().where("count > 1").count(),
        "repeated_edges": edges.groupBy("graph_id", "src", "dst").count().where("count > 1").count(),
        "dangling_ends": ends.join(nodes, ["graph_id", "node_id"], "left_anti").count(),
    }
