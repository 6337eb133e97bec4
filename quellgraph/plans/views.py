"""Graphs in the driver's tables: one from the star schema, and one per organisation. Each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.operators.evaluation import pick_seeds
from quellgraph.runtime import table, trimmed, written_once
from quellgraph.schema import EDGES, NODES, conform

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f]+|[\s\p{{Z}}\x1c-\x1f]+$', '', 'g')"


def sql_trim(c: str) -> str:
    return _TRIM.format(c)


def _org_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A node per organisation and id, whatever its spans."""
    n = table(spark, d, "org_graph").where("org_id is not null and node_id is not null")
    g = n.groupBy(F.col("org_id").alias("graph_id"), trimmed(F.col("node_id")).alias("node_id")).agg(
        F.coalesce(F.max("node_type"), F.lit("SERVICE")).alias("node_type"), F.coalesce(F.max("name"), F.lit("")).alias("name"), F.coalesce(F.max("privilege_level"), F.lit(0.0)).alias("privilege_level"), F.coalesce(F.max("sensitivity"), F.lit(0.5)).alias("sensitivity")
    )
    return conform(g, NODES)


def _org_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge per organisation and ordered pair of known nodes."""
    e = table(spark, d, "org_edges").where("org_id is not null and source is not null and target is not null")
    e = e.withColumns({"graph_id": F.col("org_id"), "src": trimmed(F.col("source")), "dst": trimmed(F.col("target"))})
    # By source for both the sums and the first look at known nodes, so that edges travel twice and not three times.
    e = e.select("graph_id", "src", "dst", "edge_id", "edge_type", "weight", "delegation_depth_limit").repartition("graph_id", "src").groupBy("graph_id", "src", "dst").agg(
        F.min("edge_id").alias("ord"), F.min("edge_type").alias("edge_type"), F.coalesce(F.max("weight"), F.lit(0.5)).alias("weight"), F.max("delegation_depth_limit").alias("delegation_depth_limit")
    )
    known = org_nodes(spark, d).select("graph_id", "node_id")
    for end in ("src", "dst"):
        e = e.join(known.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return conform(e.withColumn("edge_id", F.concat_ws("->", "src", "dst")), EDGES)


def org_nodes(spark: SparkSession, d: str) -> DataFrame:
    """:func:`_org_nodes`, made once in a session."""
    return written_once(spark, "org_nodes", [f"{d}/org_graph.parquet"], lambda: _org_nodes(spark, d))


def org_edges(spark: SparkSession, d: str) -> DataFrame:
    return written_once(spark, "org_edges", [f"{d}/org_graph.parquet", f"{d}/org_edges.parquet"], lambda: _org_edges(spark, d))


def org_seeds(spark: SparkSession, d: str) -> DataFrame:
    return written_once(spark, "org_seeds", [f"{d}/org_graph.parquet"], lambda: pick_seeds(org_nodes(spark, d)))


ORG_SQL = rf"""
    nodes AS (
        SELECT org_id AS graph_id, {sql_trim('node_id')} AS node_id, coalesce(max(node_type), 'SERVICE') AS node_type, coalesce(max(privilege_level), 0.0) AS privilege_level, coalesce(max(sensitivity), 0.5) AS sensitivity
        FROM org_graph WHERE org_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2
    ),
    raw_edges AS (
        SELECT org_id AS graph_id, {sql_trim('source')} AS src, {sql_trim('target')} AS dst, min(edge_id) AS ord, min(edge_type) AS edge_type, coalesce(max(weight), 0.5) AS weight, max(delegation_depth_limit) AS lim
        FROM org_edges WHERE org_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3
    ),
    edges AS (
        SELECT e.* FROM raw_edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = e.graph_id AND n.node_id = e.src) AND EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = e.graph_id AND n.node_id = e.dst)
    ),
    seeds AS (
        SELECT graph_id, arg_min(node_id, (privilege_level, node_id)) AS node_id FROM (SELECT *, max(node_type = 'SERVICE') OVER (PARTITION BY graph_id) AS has_service FROM nodes) WHERE node_type = 'SERVICE' OR NOT has_service GROUP BY 1
    )"""


def star_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users, nations as roles, regions as deployments, suppliers as services, parts as secrets."""
    balance = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) + 1000) / 11000)), 4)
    row = lambda df, p, k, t, priv, sens: df.select(F.lit("star").alias("graph_id"), F.concat(F.lit(p), k).alias("node_id"), F.lit(t).alias("node_type"), priv.alias("privilege_level"), F.lit(sens).alias("sensitivity"))
    out = row(table(spark, d, "customer"), "user:", "c_custkey", "USER", balance("c_acctbal"), 0.2)
    out = out.unionByName(row(table(spark, d, "nation"), "role:", "n_nationkey", "ROLE", F.round(0.5 + F.col("n_nationkey") / 50, 2), 0.8)).unionByName(row(table(spark, d, "region"), "deploy:", "r_regionkey", "DEPLOYMENT", F.round(0.6 + F.col("r_regionkey") / 20, 2), 0.7))
    return conform(out.unionByName(row(table(spark, d, "supplier"), "svc:", "s_suppkey", "SERVICE", balance("s_acctbal"), 0.5)).unionByName(row(table(spark, d, "part"), "secret:", "p_partkey", "SECRET", F.round(F.col("p_size") / 50, 2), 0.9)), NODES)


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    node = lambda p, k: F.concat(F.lit(p), k)
    row = lambda df, a, b, t, w, lim: df.select(F.lit("star").alias("graph_id"), a.alias("src"), b.alias("dst"), F.lit(t).alias("edge_type"), w.alias("weight"), lim.cast("int").alias("delegation_depth_limit"))
    c, n, s = (table(spark, d, t) for t in ("customer", "nation", "supplier"))
    reads = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = row(c, node("user:", "c_custkey"), node("role:", "c_nationkey"), "ASSUME_ROLE", F.round((50 + F.col("c_custkey") % 50) / 100, 2), 1 + F.col("c_custkey") % 6)
    out = out.unionByName(row(n, node("deploy:", "n_regionkey"), node("role:", "n_nationkey"), "ASSUME_ROLE", F.lit(0.6), F.lit(6))).unionByName(row(n, node("role:", "n_nationkey"), node("deploy:", "n_regionkey"), "DEPLOY_TO", F.lit(0.8), F.lit(6)))
    out = out.unionByName(row(s, node("role:", "s_nationkey"), node("svc:", "s_suppkey"), "TOKEN_MINT", F.round((40 + F.col("s_suppkey") % 60) / 100, 2), 1 + F.col("s_suppkey") % 6))
    out = out.unionByName(row(reads, node("svc:", "l_suppkey"), node("secret:", "l_partkey"), "SECRET_READ", F.round((30 + F.col("l_partkey") % 70) / 100, 2), 1 + F.col("l_suppkey") % 6))
    return conform(out, EDGES)


STAR_SQL = """
    snodes AS (
        SELECT 'star' AS graph_id, 'user:' || c_custkey AS node_id, 'USER' AS node_type, round(least(1.0, greatest(0.0, (c_acctbal + 1000) / 11000)), 4) AS privilege_level FROM customer
        UNION ALL SELECT 'star', 'role:' || n_nationkey, 'ROLE', round(0.5 + n_nationkey / 50.0::DOUBLE, 2) FROM nation
        UNION ALL SELECT 'star', 'deploy:' || r_regionkey, 'DEPLOYMENT', round(0.6 + r_regionkey / 20.0::DOUBLE, 2) FROM region
        UNION ALL SELECT 'star', 'svc:' || s_suppkey, 'SERVICE', round(least(1.0, greatest(0.0, (s_acctbal + 1000) / 11000)), 4) FROM supplier
        UNION ALL SELECT 'star', 'secret:' || p_partkey, 'SECRET', round(p_size / 50.0::DOUBLE, 2) FROM part
    ),
    sedges AS (
        SELECT 'star' AS graph_id, 'user:' || c_custkey AS src, 'role:' || c_nationkey AS dst, 'ASSUME_ROLE' AS edge_type, round((50 + c_custkey % 50) / 100.0::DOUBLE, 2) AS weight, 1 + c_custkey % 6 AS lim FROM customer
        UNION ALL SELECT 'star', 'deploy:' || n_regionkey, 'role:' || n_nationkey, 'ASSUME_ROLE', 0.6, 6 FROM nation
        UNION ALL SELECT 'star', 'role:' || n_nationkey, 'deploy:' || n_regionkey, 'DEPLOY_TO', 0.8, 6 FROM nation
        UNION ALL SELECT 'star', 'role:' || s_nationkey, 'svc:' || s_suppkey, 'TOKEN_MINT', round((40 + s_suppkey % 60) / 100.0::DOUBLE, 2), 1 + s_suppkey % 6 FROM supplier
        UNION ALL SELECT 'star', 'svc:' || l_suppkey, 'secret:' || l_partkey, 'SECRET_READ', round((30 + l_partkey % 70) / 100.0::DOUBLE, 2), 1 + l_suppkey % 6 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    )"""


def guard_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as token attempts on guarded edges: who, which kind of edge, how deep, how old, and the decision of a nominal guard."""
    from quellgraph.functions.tokens import guard_decision

    e = table(spark, d, "events")
    kinds = F.array(*[F.lit(x) for x in ("ASSUME_ROLE", "TOKEN_MINT", "SECRET_READ", "DEPLOY_TO", "AUTHENTICATE_AS")])
    e = e.select("event_id", "ts", "user_id", "event_type", F.concat(F.lit("g"), F.col("user_id") % 7).alias("graph_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("edge_type"), (F.col("event_id") % 7).alias("depth"), F.lit(5).alias("max_depth"),
                 (F.col("event_id") % 400).cast("double").alias("age"), (F.col("user_id") % 3 == 0).alias("approved"), F.concat_ws("-", "user_id", F.col("event_id") % 97).alias("nonce"))
    base = F.when(F.col("event_type") == "error", "invalid_signature").when(F.col("age") > 300, "token_expired").when(F.col("depth") > F.col("max_depth"), "depth_exceeded").otherwise("valid")
    strict = F.element_at(F.array(*[F.lit(x) for x in ("NOMINAL", "ELEVATED", "LOCKDOWN")]), (F.col("user_id") % 3 + 1).cast("int"))
    e = e.withColumn("base", base).withColumn("strictness", strict)
    return e.withColumn("_d", guard_decision(F.col("base"), F.col("strictness"), F.col("depth"), F.col("max_depth"), F.col("age"), F.col("approved"))).select("*", "_d.decision", "_d.reason").drop("_d")


GUARD_SQL = """
    attempts AS (
        SELECT event_id, ts, user_id, event_type, 'g' || (user_id % 7) AS graph_id, (['ASSUME_ROLE', 'TOKEN_MINT', 'SECRET_READ', 'DEPLOY_TO', 'AUTHENTICATE_AS'])[event_id % 5 + 1] AS edge_type, event_id % 7 AS depth, 5 AS max_depth,
            (event_id % 400)::DOUBLE AS age, user_id % 3 = 0 AS approved, user_id || '-' || (event_id % 97) AS nonce, (['NOMINAL', 'ELEVATED', 'LOCKDOWN'])[user_id % 3 + 1] AS strictness
        FROM events
    ),
    based AS (SELECT *, CASE WHEN event_type = 'error' THEN 'invalid_signature' WHEN age > 300 THEN 'token_expired' WHEN depth > max_depth THEN 'depth_exceeded' ELSE 'valid' END AS base FROM attempts),
    decided AS (
        SELECT *, CASE WHEN base <> 'valid' THEN 'BLOCKED' WHEN strictness <> 'NOMINAL' AND (depth > max_depth - 1 OR age > 60) THEN 'BLOCKED' WHEN strictness = 'LOCKDOWN' AND NOT approved THEN 'BLOCKED' WHEN strictness = 'LOCKDOWN' THEN 'FLAGGED' ELSE 'ALLOWED' END AS decision,
            CASE WHEN base <> 'valid' THEN 'base_check:' || base WHEN strictness <> 'NOMINAL' AND depth > max_depth - 1 THEN 'elevated:depth_exceeds_strict_limit' WHEN strictness <> 'NOMINAL' AND age > 60 THEN 'elevated:token_age_exceeds_60s'
                WHEN strictness = 'LOCKDOWN' AND NOT approved THEN 'lockdown:origin_not_in_whitelist' WHEN strictness = 'LOCKDOWN' THEN 'lockdown:flagged_for_review' ELSE 'all_checks_passed' END AS reason
        FROM based
    )"""
