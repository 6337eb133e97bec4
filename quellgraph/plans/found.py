"""The pN_ queries of the core: each problem's operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.operators import drift, key_states, nested, orphans, packed_fields, same_records
from quellgraph.operators.json_walk import fields_of
from quellgraph.plans import found_sql as sql
from quellgraph.plans.registry import query
from quellgraph.runtime import global_index, table, trimmed, written


@query(sql.P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed_fields.split_packed(table(spark, sf_dir, "model_history"), "id", ["predicted_nodes", "actual_nodes"])
    return rows.select("id", "field_name", "pos", F.col("value").alias("node_id"))


@query()
def p1_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed_fields.split_packed(table(spark, sf_dir, "model_history"), "id", ["predicted_nodes", "actual_nodes"])
    return rows.groupBy("field_name", "dialect").agg(F.sum(F.when(F.col("pos") == 1, 1).otherwise(0)).alias("n_fields"), F.count("*").alias("n_values"))


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _edge_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "org_edges")
    ends = F.array(*[F.struct(F.lit(c).alias("ref_field"), trimmed(F.col(c)).alias("ref_key")) for c in ("source", "target")])
    refs = edges.select(F.col("edge_id").alias("ref_id"), trimmed(F.col("org_id")).alias("org"), _micros("seen_at").alias("at"), F.date_format("seen_at", "yyyy-MM").alias("ref_month"), F.inline(ends))
    return refs.where("ref_key is not null")


def _edge_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "org_graph").select(trimmed(F.col("org_id")).alias("org"), trimmed(F.col("node_id")).alias("node"), _micros("added_at").alias("a"), _micros("removed_at").alias("b"))
    found = orphans.match_runs(_edge_refs(spark, sf_dir), ["org", "ref_key"], "at", nodes, ["org", "node"], "a", "b")
    found = found.withColumn("reason", orphans.orphan_reason("at")).where("reason is not null")
    return found.select(F.lit("org_edges").alias("ref_table"), "ref_id", "ref_field", "ref_key", "reason", "ref_month")


def _policy_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps are numbered in the order of accounts and instants; an account's policy exists at the numbers of the dumps that list it."""
    dumps = table(spark, sf_dir, "account_dump").select("dump_id", "account_id", _micros("captured_at").alias("at"), F.date_format("captured_at", "yyyy-MM").alias("ref_month"), "dump")
    order = ["account_id", "at", "dump_id"]
    numbers = global_index(dumps.select(*order).distinct(), order, "nr")
    arns = nested.policy_arns(dumps, [*order, "ref_month"]).where("policy_arn != ''").withColumnRenamed("policy_arn", "ref_key").distinct()
    arns = written(arns.join(numbers, order, "left"))
    refs, own = arns.where("not listed").drop("listed"), arns.where("listed").select("account_id", "ref_key", "nr")
    catalog = table(spark, sf_dir, "policy_catalog").select(trimmed(F.col("policy_arn")).alias("policy_arn"), _micros("created_at").alias("a"), _micros("retired_at").alias("b"))
    found = orphans.match_runs(refs, ["account_id", "ref_key"], "nr", own, ["account_id", "ref_key"], "nr", None, prefix="own_")
    found = written(found.where("own_run_end is null or nr >= own_run_end"))
    found = orphans.match_runs(found, ["ref_key"], "at", catalog, ["policy_arn"], "a", "b", prefix="cat_").where("cat_run_end is null or at >= cat_run_end")
    before = (F.col("own_first_start") < F.col("nr")) | (F.col("cat_first_start") <= F.col("at"))
    known = F.col("own_first_start").isNotNull() | F.col("cat_first_start").isNotNull()
    reason = F.when(before, "deleted").when(known, "late").otherwise("missing")
    return found.select(F.lit("account_dump").alias("ref_table"), F.col("dump_id").alias("ref_id"), F.lit("PolicyArn").alias("ref_field"), "ref_key", reason.alias("reason"), "ref_month")


@query(sql.P2_FOUND)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_orphans(spark, sf_dir).unionByName(_policy_orphans(spark, sf_dir)).distinct()


@query(sql.P2_REPORT)
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, sf_dir))


@query(sql.P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.items(table(spark, sf_dir, "account_dump"), ["dump_id"]).distinct()


@query(sql.P3_ENTITIES)
def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.entities(table(spark, sf_dir, "account_dump"), ["dump_id", "account_id", "captured_at"]).distinct()


@query(sql.P3_DOCUMENTS)
def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policy documents of the dumps, with their parents: inline, trust and versions."""
    docs = nested.documents(table(spark, sf_dir, "account_dump"), ["dump_id"])
    return docs.select("dump_id", "parent_list", "parent_pos", "kind", "doc_pos", "doc_name", "version").distinct()


@query(sql.P3_STATEMENTS)
def p3_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nested.documents(table(spark, sf_dir, "account_dump").select("dump_id", "dump").distinct(), ["dump_id"])
    return nested.statements(docs, ["dump_id"]).withColumns({c: F.array_join(c, "\n") for c in ("actions", "resources")})


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource values in the permission statements of the lambda files, each file once, whatever the feed calls the field."""
    files = table(spark, sf_dir, "policy_files").where("family = 'lambda_execution_role'").select("file_id", "content").distinct()
    fields = fields_of(files, ["file_id"], "content", values=True).select("file_id", F.inline("fields"))
    name = F.lower(F.element_at(F.split("path", r"\."), -1))
    fields = fields.where(name.startswith("resource") & F.lower("path").contains("statement") & ~F.lower("path").startswith("trust"))
    return fields.select(F.explode("items").alias("resource"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history = table(spark, sf_dir, "model_history")
    return key_states.key_states(history, "topology_type", ["precision_score", "recall_score", "f1_score"]), key_states.key_states(_resources(spark, sf_dir), "resource")


@query(sql.P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    topologies, resources = (key_states.dominating(s) for s in _states(spark, sf_dir))
    named = [s.select(F.lit(n).alias("field_name"), "key_value") for n, s in (("topology_type", topologies), ("Resource", resources))]
    return named[0].unionByName(named[1])


@query(sql.P4_STATES)
def p4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    topologies, resources = _states(spark, sf_dir)
    cols = ["key_value", "n_rows", F.round("share", 9).alias("share"), *[F.round(f"avg_{m}", 6).alias(f"avg_{m}") for m in ("precision_score", "recall_score", "f1_score")]]
    return topologies.select(F.lit("topology_type").alias("field_name"), *cols).unionByName(resources.select(F.lit("Resource").alias("field_name"), "key_value", "n_rows", F.round("share", 9).alias("share")), allowMissingColumns=True)


@query(sql.P5)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = drift.read_files(table(spark, sf_dir, "policy_files"))
    return drift.changes(files).select("file_id", "change_kind", "field_path", "new_path").distinct()


@query()
def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = drift.read_files(table(spark, sf_dir, "policy_files"), values=True, keep=["family"])
    return drift.consistent(files, drift.changes(files), keep=["family"])


@query(sql.P6)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = same_records.same_records(table(spark, sf_dir, "role_statements"), "record_id", "family", "raw_text")
    return same.where("id != first_id").select("first_id", F.col("id").alias("copy_id"))


@query(sql.P6_DISTINCT)
def p6_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_records.distinct_records(table(spark, sf_dir, "role_statements"), "record_id", "family", "raw_text").withColumnRenamed("part", "family")

