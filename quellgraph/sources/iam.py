"""Access policies in JSON into nodes and edges: bare and wrapped policies, role bundles, and whole account dumps.

Documents come as ``(graph_id, content)``. Everything is one projection into statements, and two explodes into edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.functions import iam
from quellgraph.operators.graph import keep_first, keep_strongest
from quellgraph.operators.nested import as_list, decoded, dump_body
from quellgraph.schema import EDGES, NODES, conform

_STATEMENT = "struct<Effect:string,Action:string,Resource:string,Principal:string,Condition:string>"
_PRINCIPAL = "struct<AWS:string,Service:string,Federated:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_id, content)`` of JSON files, one graph per file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("graph_id"), F.col("value").alias("content"))


def detect_format(content: Column) -> Column:
    """What a document is, the most specific first."""
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    has = lambda *ks: F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks]))
    wrapped = F.coalesce(F.json_object_keys(F.get_json_object(content, "$.PolicyVersion")), F.array().cast("array<string>"))
    return (
        F.when(has("UserDetailList", "RoleDetailList", "GroupDetailList", "Policies"), "account_auth_dump").when(has("apiVersion") & has("kind"), "k8s_rbac")
        .when(has("resource_changes", "planned_values"), "terraform_plan").when(has("RoleName", "TrustPolicy"), "role_bundle")
        .when(has("PolicyVersion") & F.array_contains(wrapped, "Document"), "mamip_policy").when(has("Statement"), "policy_doc").otherwise("unknown")
    )


def unwrap(document: Column) -> Column:
    """The bare policy of a document that may be wrapped, as JSON text."""
    d = F.from_json(document, "struct<Statement:string,PolicyVersion:struct<Document:string>,Document:string>")
    return F.when(d["Statement"].isNotNull(), document).otherwise(F.coalesce(d["PolicyVersion"]["Document"], d["Document"]))


def principals(principal: Column) -> Column:
    """The names in a Principal: text, a list, or an object of lists by kind; ``*`` where an object names none."""
    o = F.from_json(F.when(F.ltrim(principal).startswith("{"), principal), _PRINCIPAL)
    none = F.array().cast("array<string>")
    named = F.concat(*[F.coalesce(as_list(o[k], "string"), none) for k in ("AWS", "Service", "Federated")])
    return F.when(o.isNull(), as_list(principal, "string")).when(F.size(named) > 0, named).otherwise(F.array(F.lit("*")))


def statements(policies: DataFrame) -> DataFrame:
    """``policies`` (graph_id, ord, subject_id, subject_arn, document) as one row per allowing statement."""
    listed = policies.select("graph_id", "ord", "subject_id", "subject_arn", F.posexplode(as_list(F.from_json(decoded(F.col("document")), "struct<Statement:string>")["Statement"], _STATEMENT)).alias("_i", "s"))
    s = listed.where(F.coalesce("s.Effect", F.lit("Allow")) == "Allow")
    trust = F.col("s.Principal").isNotNull()
    default = F.when(trust, F.array(F.lit("sts:AssumeRole"))).otherwise(F.array(F.lit("*")))
    condition = F.coalesce(F.json_object_keys("s.Condition"), F.array().cast("array<string>"))
    return s.select(
        "graph_id", (F.col("ord").cast("bigint") * (1 << 20) + F.col("_i")).alias("ord"), "subject_id", "subject_arn", trust.alias("trust"), F.coalesce(as_list(F.col("s.Action"), "string"), default).alias("actions"),
        F.coalesce(as_list(F.col("s.Resource"), "string"), F.array(F.lit("*"))).alias("resources"), F.when(trust, principals(F.col("s.Principal"))).alias("principals"), condition.alias("condition_keys"),
        F.coalesce("s.Condition", F.lit("{}")).alias("conditions"),
    )


def raw_edges(st: DataFrame) -> DataFrame:
    """An edge per principal or resource of each statement, and what its other end is called."""
    kind, keys = iam.dominant_edge_type(F.col("actions")), F.col("condition_keys")
    e = st.withColumn("edge_type", kind).withColumn("weight", iam.statement_weight(F.col("actions"), keys))
    e = e.withColumn("other_arn", F.explode(F.when(F.col("trust"), F.col("principals")).otherwise(F.col("resources"))))
    other = F.when(~F.col("trust") & (F.col("other_arn") == "*"), iam.WILDCARD).otherwise(iam.arn_node_id(F.col("other_arn")))
    depth = F.create_map(*[F.lit(x) for kv in iam.DEPTH_BY_TYPE.items() for x in kv])
    return e.withColumn("other_id", other).select(
        "graph_id", "ord", F.when(F.col("trust"), F.col("other_id")).otherwise(F.col("subject_id")).alias("src"), F.when(F.col("trust"), F.col("subject_id")).otherwise(F.col("other_id")).alias("dst"), "edge_type", "weight",
        depth[F.col("edge_type")].alias("delegation_depth_limit"), iam.has_mfa(keys).alias("requires_mfa"), (F.size(keys) > 0).alias("is_conditional"), "conditions", "other_id", "other_arn",
    )


def _named_nodes(df: DataFrame, node_id: str, arn: str, ord_: str, source: str) -> DataFrame:
    kind = iam.arn_node_type(F.col(arn))
    return df.select(
        "graph_id", F.col(ord_).alias("ord"), F.col(node_id).alias("node_id"), kind.alias("node_type"), iam.arn_name(F.col(arn)).alias("name"), F.when(kind == "ROLE", 0.5).otherwise(0.3).alias("privilege_level"),
        iam.arn_sensitivity(F.col(arn)).alias("sensitivity"), F.create_map(F.lit("arn"), F.col(arn), F.lit("source"), F.lit(source)).alias("tags"),
    )


def _finish(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    e = keep_strongest(conform(edges.withColumn("edge_id", F.concat_ws("->", "src", "dst")).withColumn("tags", F.create_map(F.lit("source"), F.lit(source))), EDGES))
    return keep_first(conform(nodes, NODES), ["graph_id", "node_id"]), e


def load_policies(docs: DataFrame, subject_id: str = "iam:policy:policy-subject", subject_arn: str = "policy-subject") -> tuple[DataFrame, DataFrame]:
    """Bare and wrapped policies, each about one subject."""
    p = docs.select("graph_id", F.lit(1).alias("ord"), F.lit(subject_id).alias("subject_id"), F.lit(subject_arn).alias("subject_arn"), unwrap(F.col("content")).alias("document")).where("document is not null")
    e = raw_edges(statements(p))
    nodes = _named_nodes(p.withColumn("ord", F.lit(0)), "subject_id", "subject_arn", "ord", "aws_iam").unionByName(_named_nodes(e, "other_id", "other_arn", "ord", "aws_iam"))
    return _finish(nodes, e, "aws_iam")


def load_role_bundles(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles with their trust and permission policies; a role's privilege becomes the largest weight of its edges out."""
    b = docs.select("graph_id", F.from_json("content", "struct<RoleName:string,RoleArn:string,TrustPolicy:string,PermissionPolicies:string>").alias("b"))
    has_arn = F.coalesce("b.RoleArn", F.lit("")) != ""
    role = F.when(has_arn, iam.arn_node_id(F.col("b.RoleArn"))).otherwise(F.concat(F.lit("iam:role:"), F.coalesce("b.RoleName", F.lit("unknown-role"))))
    b = b.withColumn("subject_id", role)
    perms = F.transform(as_list(F.col("b.PermissionPolicies"), "struct<Document:string>"), lambda p, i: F.struct((i + 2).alias("ord"), unwrap(p["Document"]).alias("document")))
    docs_of = F.concat(F.array(F.struct(F.lit(1).alias("ord"), F.col("b.TrustPolicy").alias("document"))), F.coalesce(perms, F.array().cast("array<struct<ord:int,document:string>>")))
    p = b.select("graph_id", "subject_id", F.col("subject_id").alias("subject_arn"), F.inline(docs_of)).where("document is not null")
    e = raw_edges(statements(p))
    own = b.select(
        "graph_id", F.lit(0).alias("ord"), F.col("subject_id").alias("node_id"), F.lit("ROLE").alias("node_type"), F.coalesce("b.RoleName", F.lit("unknown-role")).alias("name"), F.lit(0.5).alias("privilege_level"),
        F.lit(0.6).alias("sensitivity"), F.create_map(F.lit("arn"), F.coalesce("b.RoleArn", F.lit("")), F.lit("source"), F.lit("aws_iam_role_config")).alias("tags"),
    )
    nodes, edges = _finish(own.unionByName(_named_nodes(e, "other_id", "other_arn", "ord", "aws_iam")), e, "aws_iam")
    best = edges.join(own.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").groupBy("graph_id", F.col("src").alias("node_id")).agg(F.round(F.max("weight"), 4).alias("_p"))
    nodes = nodes.join(best, ["graph_id", "node_id"], "left").withColumn("privilege_level", F.coalesce("_p", "privilege_level")).select(*nodes.columns)
    return nodes, edges


_ENTITY = "struct<UserName:string,GroupName:string,RoleName:string,Arn:string,GroupList:string,AttachedManagedPolicies:string,UserPolicyList:string,GroupPolicyList:string,RolePolicyList:string,AssumeRolePolicyDocument:string>"
_POLICY = "struct<PolicyName:string,PolicyArn:string,PolicyDocument:string>"
_MANAGED = "struct<Arn:string,PolicyVersionList:string>"
_VERSION = "struct<IsDefaultVersion:boolean,Document:string>"


def load_account_dumps(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole account dumps: users, groups and roles with memberships, inline and managed policies and trust documents.

    Attached policies are joined to the default versions that the dump lists; one that isn't listed gives nothing.
    """
    body = docs.select("graph_id", dump_body(F.col("content")).alias("b"))
    none = F.array().cast(f"array<{_POLICY}>")
    per = []
    for rank, (kind, name, inline) in enumerate((("UserDetailList", "UserName", "UserPolicyList"), ("GroupDetailList", "GroupName", "GroupPolicyList"), ("RoleDetailList", "RoleName", "RolePolicyList"))):
        e = body.select("graph_id", F.posexplode(as_list(F.col(f"b.{kind}"), _ENTITY)).alias("_i", "e"))
        arn = F.coalesce("e.Arn", F.lit(""))
        by_name = F.concat(F.lit(f"iam:{name[:-4].lower()}:"), F.coalesce(f"e.{name}", F.lit(f"unknown-{name[:-4].lower()}")))
        node = by_name if kind == "GroupDetailList" else F.when(arn != "", iam.arn_node_id(arn)).otherwise(by_name)
        per.append(e.select(
            "graph_id", F.lit(kind).alias("kind"), (F.col("_i").cast("bigint") + F.lit(rank << 28)).alias("ord"), node.alias("subject_id"), F.when(arn == "", node).otherwise(arn).alias("subject_arn"),
            F.coalesce(as_list(F.col(f"e.{inline}"), _POLICY), none).alias("inline"), F.coalesce(as_list(F.col("e.AttachedManagedPolicies"), _POLICY), none).alias("attached"),
            as_list(F.col("e.GroupList"), "string").alias("groups"), F.col("e.AssumeRolePolicyDocument").alias("trust_doc"),
        ))
    ents = per[0].unionByName(per[1]).unionByName(per[2])
    names = F.transform(F.concat("inline", "attached"), lambda p: F.coalesce(p["PolicyName"], F.lit("")))
    own = ents.select(
        "graph_id", "ord", F.col("subject_id").alias("node_id"), F.when(F.col("kind") == "UserDetailList", "USER").otherwise("ROLE").alias("node_type"), iam.arn_name(F.col("subject_arn")).alias("name"),
        iam.policy_name_privilege(names).alias("privilege_level"), iam.arn_sensitivity(F.col("subject_arn")).alias("sensitivity"), F.create_map(F.lit("arn"), F.col("subject_arn"), F.lit("source"), F.lit("aws_iam_account_dump")).alias("tags"),
    )
    managed = body.select("graph_id", F.explode(as_list(F.col("b.Policies"), _MANAGED)).alias("p")).select("graph_id", F.col("p.Arn").alias("arn"), F.get(F.filter(as_list(F.col("p.PolicyVersionList"), _VERSION), lambda v: v["IsDefaultVersion"]), F.lit(0))["Document"].alias("document"))
    managed = managed.where("arn != '' and document is not null").groupBy("graph_id", "arn").agg(F.last("document").alias("document"))
    inline = ents.select("graph_id", "ord", "subject_id", "subject_arn", F.posexplode("inline").alias("_j", "p")).select("graph_id", (F.col("ord") * (1 << 12) + F.col("_j")).alias("ord"), "subject_id", "subject_arn", F.col("p.PolicyDocument").alias("document"))
    attached = ents.select("graph_id", "ord", "subject_id", "subject_arn", F.posexplode("attached").alias("_j", "p")).select("graph_id", (F.col("ord") * (1 << 12) + (1 << 11) + F.col("_j")).alias("ord"), "subject_id", "subject_arn", F.col("p.PolicyArn").alias("arn")).join(managed, ["graph_id", "arn"])
    rights = raw_edges(statements(inline.unionByName(attached.select(*inline.columns))).where("not trust"))
    trust = raw_edges(statements(ents.select("graph_id", (F.col("ord") * (1 << 12)).alias("ord"), "subject_id", "subject_arn", F.col("trust_doc").alias("document")).where("document is not null")).where("trust"))
    member = ents.where("kind = 'UserDetailList'").select("graph_id", "ord", F.col("subject_id").alias("src"), F.explode("groups").alias("g")).select(
        "graph_id", "ord", "src", F.concat(F.lit("iam:group:"), "g").alias("dst"), F.lit("AUTHENTICATE_AS").alias("edge_type"), F.lit(0.5).alias("weight"), F.lit(2).alias("delegation_depth_limit"),
        F.lit(False).alias("requires_mfa"), F.lit(False).alias("is_conditional"),
    )
    groups = _named_nodes(member.withColumn("ord", F.col("ord") + (1 << 50)), "dst", "dst", "ord", "aws_iam_account_dump").withColumn("node_type", F.lit("ROLE")).withColumn("privilege_level", F.lit(0.4))
    ends = _named_nodes(rights.unionByName(trust).withColumn("ord", F.lit(1 << 60)), "other_id", "other_arn", "ord", "aws_iam_account_dump")
    wild = F.col("node_id") == iam.WILDCARD
    ends = ends.withColumn("node_type", F.when(wild, "SECRET").otherwise(F.col("node_type"))).withColumn("privilege_level", F.when(wild, 1.0).otherwise(F.col("privilege_level"))).withColumn("sensitivity", F.when(wild, 1.0).otherwise(F.col("sensitivity")))
    edges = rights.unionByName(trust).unionByName(member, allowMissingColumns=True)
    return _finish(own.unionByName(groups).unionByName(ends), edges, "aws_iam_account_dump")


def load_any(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document by its format; formats that aren't JSON policies give nothing."""
    d = docs.withColumn("_f", detect_format(F.col("content")))
    parts = [load_policies(d.where("_f in ('policy_doc', 'mamip_policy')")), load_role_bundles(d.where("_f = 'role_bundle'")), load_account_dumps(d.where("_f = 'account_auth_dump'"))]
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges
