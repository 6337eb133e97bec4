"""Cluster role bindings in YAML into nodes and edges. YAML is read in Python, everything after is relational."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions import iam
from quellgraph.operators.graph import keep_first, keep_strongest
from quellgraph.schema import EDGES, NODES, conform

# Privilege of well-known roles.
KNOWN = {
    "cluster-admin": 1.0, "admin": 0.9, "edit": 0.7, "view": 0.25, "system:kube-controller-manager": 0.85, "system:kube-scheduler": 0.6, "system:kube-proxy": 0.4, "system:kube-dns": 0.35,
    "system:node": 0.5, "system:monitoring": 0.3, "system:basic-user": 0.1, "system:discovery": 0.1, "system:public-info-viewer": 0.1, "system:service-account-issuer-discovery": 0.2,
}
# Edges that rights on a resource give: kind, target, weight.
RESOURCE_EDGES = {
    "secrets": ("SECRET_READ", "k8s:secret:*", 0.8), "serviceaccounts/token": ("TOKEN_MINT", "k8s:sa:token", 0.85), "pods/exec": ("TOKEN_MINT", "k8s:pod:exec", 0.75),
    "pods/attach": ("TOKEN_MINT", "k8s:pod:exec", 0.7), "pods/portforward": ("TOKEN_MINT", "k8s:pod:pf", 0.6), "clusterrolebindings": ("ASSUME_ROLE", "k8s:rbac:*", 0.9), "rolebindings": ("ASSUME_ROLE", "k8s:rbac:*", 0.8),
}

_ROW = "graph_id string, ord bigint, kind string, name string, namespace string, verbs array<string>, resources array<string>, n_rules int, ref_kind string, ref_name string, subjects array<struct<kind:string,name:string,namespace:string>>"


def parse(docs: DataFrame) -> DataFrame:
    """``docs`` (graph_id, content) of YAML, with several documents and lists, as one row per resource; broken YAML gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for graph, content in zip(batch["graph_id"], batch["content"], strict=True):
                try:
                    found = [d for d in yaml.safe_load_all(content or "") if isinstance(d, dict)]
                except yaml.YAMLError:
                    continue
                flat = [x for d in found for x in ((d.get("items") or []) if d.get("kind") == "List" else [d]) if x]
                for i, r in enumerate(flat):
                    meta, ref, rules = r.get("metadata") or {}, r.get("roleRef") or {}, r.get("rules") or []
                    union = lambda k: sorted({str(x) for rule in rules for x in rule.get(k) or []})  # noqa: B023, E731
                    subjects = [{"kind": s.get("kind", "User"), "name": s.get("name", ""), "namespace": s.get("namespace")} for s in r.get("subjects") or []]
                    rows.append((graph, i, r.get("kind", ""), meta.get("name"), meta.get("namespace"), union("verbs"), union("resources"), len(rules), ref.get("kind", "ClusterRole"), ref.get("name", ""), subjects))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("graph_id", "ord", "kind", "name", "namespace", "verbs", "resources", "n_rules", "ref_kind", "ref_name", "subjects")])

    return docs.select("graph_id", "content").mapInPandas(run, _ROW)


def _known(name, other) -> F.Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])[name], other)


def load(docs: DataFrame, infer: bool = True) -> tuple[DataFrame, DataFrame]:
    r = parse(docs)
    tags = lambda **kv: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv.items()]))
    roles = r.where("kind in ('Role', 'ClusterRole')")
    role_id = F.when((F.col("kind") == "ClusterRole") | F.col("namespace").isNull(), F.concat(F.lit("clusterrole:"), "name")).otherwise(F.concat_ws(":", F.lit("role"), "namespace", "name"))
    roles = roles.withColumn("node_id", role_id)
    role_nodes = roles.select(
        "graph_id", "ord", "node_id", F.lit("ROLE").alias("node_type"), "name", _known(F.col("name"), iam.k8s_privilege(F.col("verbs"), F.col("resources"), F.col("n_rules"))).alias("privilege_level"),
        iam.k8s_sensitivity(F.col("resources"), F.col("n_rules")).alias("sensitivity"), tags(kind=F.col("kind"), namespace=F.coalesce("namespace", F.lit("cluster")), source=F.lit("k8s_rbac")).alias("tags"),
    )
    ns = F.coalesce("namespace", F.lit("default"))
    accounts = r.where("kind = 'ServiceAccount'").select(
        "graph_id", "ord", F.concat_ws(":", F.lit("sa"), ns, "name").alias("node_id"), F.lit("USER").alias("node_type"), F.concat_ws("/", ns, "name").alias("name"), F.lit(0.3).alias("privilege_level"), F.lit(0.4).alias("sensitivity"),
        tags(kind=F.lit("ServiceAccount"), namespace=ns, source=F.lit("k8s_rbac")).alias("tags"),
    )
    first = keep_first(role_nodes.unionByName(accounts), ["graph_id", "node_id"])
    binds = r.where("kind in ('RoleBinding', 'ClusterRoleBinding')").withColumn("_ns", F.coalesce("namespace", F.lit("cluster")))
    binds = binds.withColumn("role_id", F.when(F.col("ref_kind") == "ClusterRole", F.concat(F.lit("clusterrole:"), "ref_name")).otherwise(F.concat_ws(":", F.lit("role"), "_ns", "ref_name")))
    later = 1 << 40
    made = binds.select(
        "graph_id", (F.col("ord") + later).alias("ord"), F.col("role_id").alias("node_id"), F.lit("ROLE").alias("node_type"), F.col("ref_name").alias("name"), _known(F.col("ref_name"), F.lit(0.5)).alias("privilege_level"),
        F.lit(0.5).alias("sensitivity"), tags(kind=F.col("ref_kind"), source=F.lit("k8s_rbac_binding")).alias("tags"),
    )
    subj = binds.select("graph_id", "ord", "kind", "role_id", "_ns", F.explode("subjects").alias("s"))
    s_ns = F.coalesce("s.namespace", "_ns")
    account, user = F.col("s.kind") == "ServiceAccount", F.col("s.kind") == "User"
    subj = subj.withColumn("node_id", F.when(account, F.concat_ws(":", F.lit("sa"), s_ns, "s.name")).when(user, F.concat(F.lit("k8s:user:"), "s.name")).otherwise(F.concat(F.lit("k8s:group:"), "s.name")))
    strong = F.col("s.name").isin("system:masters", "cluster-admin")
    people = subj.select(
        "graph_id", (F.col("ord") + later).alias("ord"), "node_id", F.when(account | user, "USER").otherwise("WORKLOAD").alias("node_type"), F.when(account, F.concat_ws("/", s_ns, "s.name")).otherwise(F.col("s.name")).alias("name"),
        F.when(strong, 0.85).otherwise(0.3).alias("privilege_level"), F.when(strong, 0.5).otherwise(0.3).alias("sensitivity"), tags(kind=F.col("s.kind"), source=F.lit("k8s_rbac")).alias("tags"),
    )
    nodes = keep_first(conform(first.unionByName(made).unionByName(people), NODES), ["graph_id", "node_id"])
    power = nodes.select("graph_id", F.col("node_id").alias("role_id"), "privilege_level")
    edges = subj.join(power, ["graph_id", "role_id"]).select(
        "graph_id", "ord", F.col("node_id").alias("src"), F.col("role_id").alias("dst"), F.lit("ASSUME_ROLE").alias("edge_type"), F.round(F.least(F.lit(1.0), F.col("privilege_level") + 0.05), 4).alias("weight"),
        F.when(F.col("kind") == "ClusterRoleBinding", 5).otherwise(3).alias("delegation_depth_limit"),
    )
    if infer:
        verb = lambda *vs: F.arrays_overlap("verbs", F.array(*[F.lit(v) for v in vs]))
        every = F.array_contains("resources", "*") & verb("*", "create")
        table = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("resource"), F.lit(t).alias("edge_type"), F.lit(d).alias("dst"), F.lit(w).alias("weight")) for i, (k, (t, d, w)) in enumerate(RESOURCE_EDGES.items())]
        allowed = lambda x: F.array_contains("resources", x["resource"]) & F.when(x["edge_type"] == "SECRET_READ", verb("get", "list", "watch", "*")).otherwise(verb("create", "get", "*", "update", "patch"))
        wild = F.array(F.struct(F.lit(0).alias("i"), F.lit("*").alias("resource"), F.lit("ASSUME_ROLE").alias("edge_type"), F.lit("k8s:rbac:*").alias("dst"), F.lit(0.95).alias("weight")))
        got = roles.select("graph_id", "ord", F.col("node_id").alias("src"), F.inline(F.when(every, wild).otherwise(F.filter(F.array(*table), allowed))))
        star = F.col("resource") == "*"
        got = got.withColumn("ord", F.col("ord") * (1 << 8) + F.col("i") + 2 * later)
        extra = got.select(
            "graph_id", "ord", F.col("dst").alias("node_id"), F.when(star, "ROLE").when(F.col("edge_type") == "SECRET_READ", "SECRET").otherwise("WORKLOAD").alias("node_type"), F.when(star, "k8s-cluster-wildcard").otherwise(F.col("dst")).alias("name"),
            F.when(star, 1.0).otherwise(0.5).alias("privilege_level"), F.when(star, 1.0).when(F.col("edge_type") == "SECRET_READ", 0.9).otherwise(0.7).alias("sensitivity"), tags(source=F.lit("k8s_rbac_derived")).alias("tags"),
        )
        edges = edges.unionByName(got.select("graph_id", "ord", "src", "dst", "edge_type", "weight", F.when(star, 6).otherwise(2).alias("delegation_depth_limit")))
        nodes = keep_first(nodes.unionByName(conform(extra, NODES)), ["graph_id", "node_id"])
    edges = edges.withColumn("edge_id", F.concat_ws("->", "src", "dst")).withColumn("tags", tags(source=F.lit("k8s_rbac")))
    return nodes, keep_strongest(conform(edges, EDGES))
