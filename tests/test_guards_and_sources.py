"""Guards, tokens, mutation, streams and the sources, on small inputs."""

import hashlib
import hmac
import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_graphs import make, seed

from quellgraph.functions import tokens
from quellgraph.operators import evaluation, guards, mutation, propagation, traversal
from quellgraph.runtime import cut
from quellgraph.sources import iam, k8s, state, terraform
from quellgraph.streaming import monitor


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def test_hmac_and_frame(spark):
    key = bytes(range(32))
    assert one(spark, tokens.hmac_sha256(key, F.lit("héllo"))) == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
    token = F.struct(F.lit("tid").alias("token_id"), F.lit("a").alias("origin_node"), F.lit("b").alias("target_node"), F.lit(300).alias("delegation_depth"), F.lit(5).alias("max_depth"), F.lit(1_700_000_000.7).alias("timestamp"), F.lit(99_999.0).alias("ttl_seconds"), F.lit("0a0b").alias("nonce"), F.lit("SECRET_READ").alias("edge_type"))
    h = lambda s, n: hashlib.sha256(s.encode()).digest()[:n]
    message = struct.pack("<16s8s8sBBIH8sBB", h("tid", 16), h("a", 8), h("b", 8), 255, 5, 1_700_000_000, 65535, b"\x0a\x0b", 3, 2)
    frame = bytes(one(spark, tokens.device_frame(token, F.lit("ELEVATED"), key)))
    assert frame == message + hmac.new(key, message, hashlib.sha256).digest() and len(frame) == 82


@pytest.mark.parametrize(("answer", "want"), [("FRAME OK\nHMAC FAIL", "BLOCKED"), ("ACCESS OK depth=2", "ALLOWED"), ("REPLAY", "BLOCKED"), ("", "BLOCKED")])
def test_device_answers(spark, answer, want):
    assert one(spark, tokens.device_decision(F.lit(answer)))["decision"] == want


@pytest.mark.parametrize(
    ("base", "strictness", "depth", "age", "approved", "want"),
    [("token_expired", "NOMINAL", 0, 0.0, True, "BLOCKED"), ("valid", "NOMINAL", 5, 200.0, False, "ALLOWED"), ("valid", "ELEVATED", 5, 0.0, True, "BLOCKED"), ("valid", "ELEVATED", 1, 61.0, True, "BLOCKED"), ("valid", "ELEVATED", 1, 1.0, False, "ALLOWED"), ("valid", "LOCKDOWN", 1, 1.0, False, "BLOCKED"), ("valid", "LOCKDOWN", 1, 1.0, True, "FLAGGED")],
)
def test_guard_matrix(spark, base, strictness, depth, age, approved, want):
    assert one(spark, tokens.guard_decision(F.lit(base), F.lit(strictness), F.lit(depth), F.lit(5), F.lit(age), F.lit(approved)))["decision"] == want


def test_sensor_and_consensus(spark):
    ev = [("BLOCKED", "base_check:depth_exceeded", "TOKEN_MINT")] * 8 + [("ALLOWED", "ok", "ASSUME_ROLE")] * 2
    r = guards.sensor(spark.createDataFrame(ev, "decision string, reason string, edge_type string").withColumn("k", F.lit(1)), ["k"], 1.0).first()
    assert r["anomaly_score"] == 0.8833 and r["anomaly"]
    d = spark.createDataFrame([("x", "ALLOWED"), ("x", "ALLOWED"), ("x", "BLOCKED"), ("y", "ALLOWED"), ("y", "FLAGGED"), ("y", "BLOCKED")], "k string, decision string")
    assert rows(guards.agree(d, ["k"]), "k", "consensus") == {("x", "ALLOWED"), ("y", "BLOCKED")}


def sets(spark, ids):
    return spark.createDataFrame([("g", x) for x in ids], "graph_id string, node_id string")


def test_containment(spark):
    r = guards.containment(sets(spark, "AB"), sets(spark, "A"), sets(spark, "ABCD")).first()
    assert (r["natural_blocks"], r["guard_blocks"], r["combined"], r["success_rate"]) == (2, 1, 0.75, 0.5)
    r = guards.containment(sets(spark, "AB"), sets(spark, "A")).first()
    assert (r["natural_blocks"], r["guard_blocks"], r["combined"]) == (0, 1, 0.0)


@pytest.fixture(scope="module")
def services(spark):
    n, e = make(spark, [(f"s{i}", "SERVICE", i / 10, 0.5) for i in range(10)], [(f"s{i}", f"s{i + 1}", "TOKEN_MINT", 0.9, 6) for i in range(9)])
    return n, e


def test_feedback_and_containment_run(spark, services):
    n, e = services
    s, sure = seed(spark, "s0"), e.withColumn("weight", F.lit(1.0))
    scores = n.select("graph_id", "node_id", F.lit(1.0).alias("exploitability"))
    risky = lambda nodes, *_: nodes.select("graph_id", "node_id", F.lit(0.9).alias("risk"), F.lit(True).alias("compromised"))
    r = guards.contain(n, sure, s, scores, risky, traversal.bfs(e, s), 2)
    assert rows(r["after"], "node_id") == {("s0",)} and rows(r["log"], "cycle", "strictness") == {(0, "LOCKDOWN"), (1, "LOCKDOWN")}
    m = r["metrics"].first()
    assert (m["missed"], m["guard_blocks"], m["natural_blocks"]) == (1, 6, 3)
    assert rows(guards.transitions(r["log"]), "before", "after") == {("NOMINAL", "LOCKDOWN")}
    # Low risk stays nominal and blocks nothing.
    calm = guards.feedback(n, sure, s, r["guards"], lambda nodes, *_: risky(nodes).withColumn("risk", F.lit(0.1)), 1)
    assert guards.blocked(calm[0]).count() == 0 and rows(calm[2], "strictness") == {("NOMINAL",)}


def test_mutations(spark, services):
    n, e = services
    for strategy, more in (("EDGE_SPLITTING", 3), ("CHAIN_OBFUSCATION", 3), ("PRIVILEGE_DILUTION", 3)):
        a, b = mutation.mutate(n, e, strategy, 0.3)
        assert a.count() == 10 + more and b.count() == 9 + more
        if strategy != "PRIVILEGE_DILUTION":
            assert traversal.bfs(b, seed(spark, "s0")).where("node_id like 's_'").count() == 10
        assert rows(mutation.mutate(n, e, strategy, 0.0)[0], "node_id") == rows(n, "node_id")
    with pytest.raises(ValueError):
        mutation.mutate(n, e, "OTHER")
    assert rows(evaluation.pick_seeds(n), "node_id") == {("s0",)}


def test_streams_equal_batches(spark, tmp_path):
    data = [(i, f"2025-01-01 00:{i % 60:02d}:00", "BLOCKED" if i % 3 else "ALLOWED", "depth", "ASSUME_ROLE", f"n{i % 40}", 0.9 if i > 50 else 0.1) for i in range(100)]
    df = spark.createDataFrame(data, "id int, t string, decision string, reason string, edge_type string, nonce string, risk double").withColumn("ts", F.to_timestamp("t")).withColumn("graph_id", F.lit("g")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = rows(monitor.sensor_windows(df, width="10 minutes"))
    got = rows(monitor.run_available(monitor.sensor_windows(stream, width="10 minutes"), "t_sensor", "complete"))
    assert got == batch and len(batch) == 6
    once = monitor.run_available(monitor.first_uses(stream.select("graph_id", "nonce", "ts"), ["graph_id", "nonce"]), f"t_nonce{tmp_path.name}")
    assert once.count() == 40 == monitor.first_uses(df.select("graph_id", "nonce", "ts", "id"), ["graph_id", "nonce"]).count()
    s = monitor.run_available(monitor.strictness_stream(stream.select("graph_id", "ts", "risk")), f"t_strict{tmp_path.name}")
    assert s.count() >= 1 and rows(s, "after") <= {("ELEVATED",), ("LOCKDOWN",), ("NOMINAL",)}
    edges = spark.createDataFrame([(0, "a", "b"), (1, "b", "c")], "idx long, src string, dst string")
    ticks = spark.range(400).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp"))
    pings = cut(monitor.traffic(spark, edges, ticks))
    assert 120 < pings.count() < 240
    assert rows(monitor.checked(pings, edges.where("src = 'a'")), "src", "status") == {("a", "blocked"), ("b", "allowed")}


def test_sinks_of_a_stream(spark, tmp_path):
    """Fan-out, breaches as a table however many, replay, weights learnt from a batch, progress."""
    events = spark.createDataFrame([(f"p{i}", "use" if i % 2 else "see", i) for i in range(3_000)], "principal string, action string, n long")
    breaches = spark.createDataFrame([("use",)], "action string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen, hit = [], []
    sink = monitor.fan_out(lambda b, k: seen.append((k, b.count())), monitor.on_breach(lambda who: hit.append(who.count())))
    q = monitor.replay(stream, breaches, ["action"]).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [(0, 3_000)] and hit == [1_500]
    assert monitor.progress(q).agg(F.sum("input_rows")).first()[0] == 3_000
    monitor.on_breach(lambda who: hit.append("never"))(monitor.replay(events, breaches.limit(0), ["action"]), 1)
    assert hit == [1_500]
    from quellgraph.schema import MODELS

    scored = spark.createDataFrame([(i, "HUB", m, 0.9 if m == "gnn" else 0.3) for i, m in enumerate(MODELS * 6)], "id long, topology_type string, model_name string, f1_score double")
    monitor.learn(str(tmp_path / "history"), str(tmp_path / "weights"))(scored, 0)
    w = {r["model"]: round(r["weight"], 6) for r in spark.read.parquet(str(tmp_path / "weights")).collect()}
    assert w["gnn"] == 0.375 and w["epidemic"] == 0.125


TRUST = {"Version": "2012-10-17", "Statement": [{"Effect": "Allow", "Principal": {"Service": "lambda.amazonaws.com"}, "Action": "sts:AssumeRole"}]}


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{i}", json.dumps(c) if not isinstance(c, str) else c) for i, c in enumerate(contents)], "graph_id string, content string")


def test_policy_sources(spark):
    n, e = iam.load_policies(docs(spark, {"PolicyVersion": {"Document": {"Statement": [{"Effect": "Allow", "Action": ["s3:Get*", "s3:List*"], "Resource": "*"}, {"Effect": "Deny", "Action": "*", "Resource": "x"}]}}}, {"Statement": {"Action": "*", "Resource": "*"}}))
    assert rows(e, "graph_id", "dst", "edge_type", "weight") == {("d0", "aws:resource:wildcard", "AUTHENTICATE_AS", 0.25), ("d1", "aws:resource:wildcard", "ASSUME_ROLE", 1.0)}
    role = {"RoleName": "r", "RoleArn": "arn:aws:iam::1:role/r", "TrustPolicy": TRUST, "PermissionPolicies": [{"Document": {"Statement": [
        {"Effect": "Allow", "Action": "secretsmanager:GetSecretValue", "Resource": ["arn:aws:secretsmanager:x:1:secret:s"], "Condition": {"StringEquals": {"a": "b"}}}, {"Effect": "Allow", "Action": "sts:AssumeRole", "Resource": "arn:aws:iam::2:role/other"}]}}]}
    n, e = iam.load_role_bundles(docs(spark, role))
    assert rows(e, "src", "dst", "edge_type", "weight", "is_conditional") == {
        ("lambda.amazonaws.com", "iam:role:r", "ASSUME_ROLE", 0.85, False), ("iam:role:r", "secretsmanager:secret:s:secret:s", "SECRET_READ", 0.56, True), ("iam:role:r", "iam:role:other", "ASSUME_ROLE", 0.85, False)
    }
    assert rows(n.where("node_id = 'iam:role:r'"), "privilege_level", "sensitivity") == {(0.85, 0.6)}


def test_account_source(spark):
    dump = {"UserDetailList": [{"UserName": "u", "Arn": "arn:aws:iam::1:user/u", "GroupList": ["g"], "AttachedManagedPolicies": [{"PolicyName": "P", "PolicyArn": "p"}, {"PolicyName": "Gone", "PolicyArn": "gone"}]}], "GroupDetailList": [{"GroupName": "g", "GroupPolicyList": [{"PolicyName": "AdminStuff", "PolicyDocument": {"Statement": [{"Effect": "Allow", "Action": "iam:PassRole", "Resource": "*"}]}}]}],
            "RoleDetailList": [{"RoleName": "r", "Arn": "arn:aws:iam::1:role/r", "AssumeRolePolicyDocument": TRUST}], "Policies": [{"Arn": "p", "PolicyVersionList": [{"IsDefaultVersion": False, "Document": {}}, {"IsDefaultVersion": True, "Document": "%7B%22Statement%22%3A%5B%7B%22Action%22%3A%22s3%3APutObject%22%2C%22Resource%22%3A%22arn%3Aaws%3As3%3A%3A%3Ab%22%7D%5D%7D"}]}]}
    d = docs(spark, dump)
    n, e = iam.load_account_dumps(d)
    assert rows(e, "src", "dst", "edge_type", "weight") == {("iam:user:u", "iam:group:g", "AUTHENTICATE_AS", 0.5), ("iam:user:u", "s3:b:b", "AUTHENTICATE_AS", 0.5), ("iam:group:g", "aws:resource:wildcard", "AUTHENTICATE_AS", 0.9), ("lambda.amazonaws.com", "iam:role:r", "ASSUME_ROLE", 0.85)}
    assert rows(n.where("node_id in ('iam:group:g', 'iam:user:u', 'iam:role:r')"), "node_id", "privilege_level") == {("iam:group:g", 0.9), ("iam:user:u", 0.5), ("iam:role:r", 0.2)}
    assert rows(docs(spark, dump, {"Statement": []}, {"RoleName": 1}, {"apiVersion": 1, "kind": 2}, {"planned_values": 1}, {"PolicyVersion": {"Document": {}}}, {}, "no").select("graph_id", iam.detect_format(F.col("content")))) == {("d0", "account_auth_dump"), ("d1", "policy_doc"), ("d2", "role_bundle"), ("d3", "k8s_rbac"), ("d4", "terraform_plan"), ("d5", "mamip_policy"), ("d6", "unknown"), ("d7", "unknown")}


def test_cluster_source(spark):
    pytest.importorskip("yaml")
    text = """
apiVersion: v1
kind: List
items:
- kind: ClusterRole
  metadata: {name: monitor}
  rules: [{resources: [pods/exec, pods/attach], verbs: [create, get]}]
- kind: ServiceAccount
  metadata: {name: app, namespace: web}
---
kind: ClusterRoleBinding
metadata: {name: b}
roleRef: {kind: ClusterRole, name: cluster-admin}
subjects: [{kind: Group, name: "system:masters"}]
---
kind: RoleBinding
metadata: {name: c, namespace: web}
roleRef: {kind: ClusterRole, name: monitor}
subjects: [{kind: ServiceAccount, name: app}]
"""
    n, e = k8s.load(docs(spark, text, "a: [broken"))
    assert rows(e, "src", "dst", "weight", "delegation_depth_limit") == {("k8s:group:system:masters", "clusterrole:cluster-admin", 1.0, 5), ("sa:web:app", "clusterrole:monitor", 0.85, 3), ("clusterrole:monitor", "k8s:pod:exec", 0.75, 2)}
    assert rows(n.where("node_id = 'clusterrole:monitor'"), "privilege_level", "sensitivity") == {(0.8, 0.75)}


def test_terraform_source(spark):
    tf = '''
resource "aws_iam_user" "chris" { name = "chris-${var.id}" }
resource "aws_iam_role" "mgr" {
  name = "mgr"
  assume_role_policy = jsonencode({ Statement = [{ Effect = "Allow", Principal = { AWS = aws_iam_user.chris.arn }, Action = "sts:AssumeRole" }] })
}
resource "aws_iam_role" "debug" {
  name = "debug"
  assume_role_policy = data.aws_iam_policy_document.d.json
  managed_policy_arns = ["arn:aws:iam::aws:policy/AdministratorAccess"]
}
data "aws_iam_policy_document" "d" {
  statement {
    actions = ["sts:AssumeRole"]
    principals {
      type = "Service"
      identifiers = ["lambda.amazonaws.com"]
    }
  }
}
resource "aws_iam_policy" "p" { policy = jsonencode({ Statement = [{ Effect = "Allow", Action = ["lambda:*", "iam:PassRole"], Resource = "*" }] }) }
resource "aws_iam_role_policy_attachment" "a" {
  role = aws_iam_role.mgr.name
  policy_arn = aws_iam_policy.p.arn
}
'''
    n, e, s = terraform.load(spark.createDataFrame([("sc", "a.tf", tf)], "graph_id string, path string, content string"))
    assert rows(e, "src", "dst", "edge_type") == {
        ("iam:user:chris", "iam:role:mgr", "ASSUME_ROLE"), ("iam:role:mgr", "lambda:function:wildcard", "AUTHENTICATE_AS"), ("service:lambda", "iam:role:debug", "ASSUME_ROLE"),
        ("iam:role:debug", "aws:resource:wildcard", "ASSUME_ROLE"), ("iam:role:mgr", "iam:role:debug", "AUTHENTICATE_AS"),
    }
    assert rows(s, "node_id") == {("iam:user:chris",)}
    pats = spark.createDataFrame([("sc", "CHRIS"), ("sc", "debug")], "graph_id string, pattern string")
    assert terraform.matched_patterns(traversal.bfs(e, s).select("graph_id", "node_id"), pats).first()["detected"]


def test_state_round_trip(spark, services, tmp_path):
    n, e = services
    snap = state.snapshots(n, e)
    a, b, _ = state.load_state(snap)
    assert rows(a, "node_id", "privilege_level") == rows(n, "node_id", "privilege_level") and rows(b, "src", "dst", "weight") == rows(e, "src", "dst", "weight")
    odd = docs(spark, {"nodes": [{"node_id": "x", "node_type": "USER"}], "edges": [{"source": "x", "target": "gone"}], "breach_seed": "x"})
    a, b, s = state.load_state(odd)
    assert b.count() == 0 and rows(s) == {("d0", "x")} and rows(a, "privilege_level") == {(0.5,)}
    more, _ = state.merge_upload(n, e, n.unionByName(n.withColumn("node_id", F.concat(F.lit("new"), "node_id")).withColumn("node_type", F.lit("ODD"))), e)
    assert more.count() == 20 and more.where("node_type = 'ODD'").count() == 0
    state.export_csv(n.select("graph_id", "node_id"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 10
    w = spark.createDataFrame([("HUB", "a", 1.0)], "topology_type string, model string, weight double")
    state.upsert_weights(spark, w, str(tmp_path / "w"))
    state.upsert_weights(spark, w.withColumn("topology_type", F.lit("CHAIN")), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    assert state.render(w, ["model", "weight"]).splitlines()[-1] == "| a | 1 |" and "toprule" in state.render(w, ["model"], "latex")


def test_all_policy_files_become_graphs(spark, small):
    from quellgraph import plans

    f = spark.read.parquet(f"{small}/policy_files.parquet").dropDuplicates(["file_id"]).withColumn("format", iam.detect_format(F.col("content"))).select(F.col("file_id").cast("string").alias("graph_id"), "family", "format")
    bundles, q = f.where("format = 'role_bundle'"), plans.QUERIES
    assert bundles.where("family = 'codepipeline_role'").count()
    ids = rows(bundles, "graph_id")
    assert rows(q["role_bundle_nodes"](spark, small), "graph_id") == ids and rows(q["role_bundle_edges"](spark, small), "graph_id") == ids
    known = rows(f.where("format != 'unknown'"), "graph_id")
    assert rows(q["policy_file_nodes"](spark, small), "graph_id") == known and rows(q["policy_file_edges"](spark, small), "graph_id") <= known
