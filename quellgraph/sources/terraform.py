"""Terraform scenarios into nodes, edges and entry points.

Files are read by a small parser for the part of the language that resources are written in; scenarios are a few files each and
parsed one to a task. What it finds becomes rows: principals, allowed statements and trusts; the edges are relational.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.functions import iam
from quellgraph.operators.graph import keep_first
from quellgraph.runtime import cut
from quellgraph.schema import EDGES, NODES, conform

# What managed policies allow, as far as graphs need it.
MANAGED = {
    "arn:aws:iam::aws:policy/AdministratorAccess": ["*"],
    "arn:aws:iam::aws:policy/AmazonS3FullAccess": ["s3:*"],
    "arn:aws:iam::aws:policy/service-role/AmazonEC2ContainerServiceforEC2Role": ["ecs:*", "ec2:Describe*"],
    "arn:aws:iam::aws:policy/IAMReadOnlyAccess": ["iam:Get*", "iam:List*"],
    "arn:aws:iam::aws:policy/ReadOnlyAccess": ["*:Describe*", "*:List*", "*:Get*"],
    "arn:aws:iam::aws:policy/AWSGlueConsoleFullAccess": ["glue:*", "iam:PassRole"],
    "arn:aws:iam::aws:policy/AmazonSSMFullAccess": ["ssm:*"],
}
DEPTH = 4


class Hcl:
    """A reader of blocks, attributes, lists, objects, strings, heredocs and calls; anything else is kept as its text."""

    _SKIP = re.compile(r"(?:\s+|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
    _NAME = re.compile(r"[A-Za-z_][\w\-]*")
    _HERE = re.compile(r"<<-?(\w+)\n(.*?)\n\s*\1(?=\s|\Z)", re.S)

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def skip(self) -> str:
        self.i = self._SKIP.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def string(self) -> str:
        j, depth, out = self.i + 1, 0, []
        while j < len(self.s) and (self.s[j] != '"' or depth):
            if self.s[j] == "\\" and not depth:
                out.append({"n": "\n", "t": "\t"}.get(self.s[j + 1], self.s[j + 1]))
                j += 2
                continue
            depth += self.s.startswith("${", j) - (depth > 0 and self.s[j] == "}")
            out.append(self.s[j])
            j += 1
        self.i = j + 1
        return "".join(out)

    def expression(self):
        c = self.skip()
        if c == '"':
            return self.string()
        if here := self._HERE.match(self.s, self.i):
            self.i = here.end()
            return here[2]
        if c == "[":
            self.i += 1
            out = []
            while self.skip() not in ("]", ""):
                out.append(self.expression())
                if self.skip() == ",":
                    self.i += 1
            self.i += 1
            return out
        if c == "{":
            self.i += 1
            return self.body("}", True)
        start = self.i
        if name := self._NAME.match(self.s, self.i):
            end = name.end()
            if self.s[end : end + 1] == "(":
                self.i = end + 1
                args = []
                while self.skip() not in (")", ""):
                    args.append(self.expression())
                    if self.skip() == ",":
                        self.i += 1
                self.i += 1
                if name[0] == "jsonencode" and args:
                    return args[0]
                return {"__call__": name[0], "args": args}
            if name[0] in ("true", "false"):
                self.i = end
                return name[0] == "true"
        depth = 0
        while self.i < len(self.s):
            c = self.s[self.i]
            if not depth and c in ",\n]})":
                break
            depth += (c in "([{") - (c in ")]}")
            self.i += 1
        raw = self.s[start : self.i].strip()
        self.i += not raw  # never stand still
        return "${" + raw + "}"

    def body(self, end: str, plain: bool = False) -> dict:
        out: dict = {}
        while (c := self.skip()) not in (end, ""):
            if c == ",":
                self.i += 1
                continue
            if c == '"':
                key = self.string()
            elif name := self._NAME.match(self.s, self.i):
                key, self.i = name[0], name.end()
            else:
                self.i += 1
                continue
            c = self.skip()
            if c in "=:" and c:
                self.i += 1
                out[key] = self.expression()
            elif not plain:
                labels = []
                while self.skip() == '"':
                    labels.append(self.string())
                if self.skip() == "{":
                    self.i += 1
                    out.setdefault(key, []).append((labels, self.body("}")))
        self.i += 1
        return out


def _name(ref: str) -> str:
    m = re.search(r"aws_iam_(?:role|user|policy|instance_profile)\.(\w+)", ref)
    return m[1] if m else ref.strip().strip('"').strip()


def _placeholders(text: str) -> str:
    def put(m: re.Match) -> str:
        k = re.match(r"aws_iam_(user|role|policy)\.(\w+)\.", m[1])
        return f"__IAM_{k[1].upper()}_{k[2]}__" if k else "__tf_ref__"

    return re.sub(r"\$\{([^}]+)\}", put, text)


def _document(value, files: dict[str, str], data: dict[str, dict]) -> dict | None:
    if isinstance(value, dict):
        if value.get("__call__") == "file" and value["args"]:
            found = next((c for p, c in files.items() if p.endswith(str(value["args"][0]).rpartition("./")[2])), None)
            value = found or ""
        elif "__call__" in value:
            return None
        else:
            return json.loads(_placeholders(json.dumps(value)))
    if not isinstance(value, str):
        return None
    if ref := re.search(r"data\.aws_iam_policy_document\.(\w+)", value):
        return data.get(ref[1])
    try:
        return json.loads(_placeholders(value))
    except ValueError:
        return None


def _listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _from_data(attrs: dict) -> dict:
    out = []
    for _, s in attrs.get("statement", []):
        stmt = {"Effect": s.get("effect", "Allow"), "Action": _listed(s.get("actions")), "Resource": _listed(s.get("resources")) or ["*"]}
        for _, p in s.get("principals", []):
            stmt["Principal"] = {p.get("type", "Service"): _listed(p.get("identifiers"))}
        out.append(stmt)
    return {"Statement": out}


def scenario_rows(files: dict[str, str]) -> list[tuple]:
    """``(kind, subject, payload)`` of one scenario: principals, statements, trusts and what else matters for entry points."""
    res: dict[str, dict[str, dict]] = {}
    data: dict[str, dict] = {}
    for path in sorted(p for p in files if p.endswith(".tf")):
        top = Hcl(files[path]).body("\0")
        for labels, attrs in top.get("resource", []):
            if len(labels) == 2:
                res.setdefault(labels[0], {})[labels[1]] = attrs
        for labels, attrs in top.get("data", []):
            if len(labels) == 2 and labels[0] == "aws_iam_policy_document":
                data[labels[1]] = json.loads(_placeholders(json.dumps(_from_data(attrs))))
    rows: list[tuple] = []
    ids: dict[str, dict[str, str]] = {"user": {}, "role": {}}
    for kind in ids:
        for tf, attrs in res.get(f"aws_iam_{kind}", {}).items():
            name = re.sub(r"\$\{[^}]+\}", "", str(attrs.get("name", tf))).strip("-_")
            ids[kind][tf] = f"iam:{kind}:{name}"
            rows.append((kind, ids[kind][tf], name))
    policies = {tf: d for tf, a in res.get("aws_iam_policy", {}).items() if (d := _document(a.get("policy"), files, data))}

    def policy(ref) -> dict | None:
        ref = str(ref).strip().strip('"')
        if _name(ref) in policies:
            return policies[_name(ref)]
        hit = next((a for m, a in MANAGED.items() if m == ref), None) or next((a for m, a in MANAGED.items() if ref and (ref.lower() in m.lower() or m.lower() in ref.lower())), None)
        return {"Statement": [{"Effect": "Allow", "Action": hit, "Resource": "*"}]} if hit else None

    def whose(kind: str, ref) -> str | None:
        return ids[kind].get(_name(str(ref))) or next((v for k, v in ids[kind].items() if ref and k in str(ref)), None)

    def allow(subject: str | None, doc: dict | None) -> None:
        for s in _listed((doc or {}).get("Statement")) if subject else []:
            if isinstance(s, dict) and s.get("Effect", "Allow") == "Allow":
                rows.append(("statement", subject, json.dumps({"actions": _listed(s.get("Action")), "resources": _listed(s.get("Resource")) or ["*"], "condition_keys": list(s.get("Condition") or {})})))

    for a in res.get("aws_iam_user_policy_attachment", {}).values():
        allow(ids["user"].get(_name(str(a.get("user", "")))), policy(a.get("policy_arn", "")))
    for a in res.get("aws_iam_user_policy", {}).values():
        allow(whose("user", a.get("user", "")), _document(a.get("policy"), files, data))
    for a in res.get("aws_iam_role_policy_attachment", {}).values():
        allow(ids["role"].get(_name(str(a.get("role", "")))), policy(a.get("policy_arn", "")))
    for tf, a in res.get("aws_iam_role", {}).items():
        for ref in _listed(a.get("managed_policy_arns")):
            allow(ids["role"][tf], policy(ref))
    for a in res.get("aws_iam_role_policy", {}).values():
        allow(whose("role", a.get("role", "")), _document(a.get("policy"), files, data))
    for tf, a in res.get("aws_iam_role", {}).items():
        for s in _listed((_document(a.get("assume_role_policy"), files, data) or {}).get("Statement")):
            if s.get("Effect", "Allow") != "Allow":
                continue
            who = s.get("Principal") or {}
            for p in [who] if isinstance(who, str) else [x for v in who.values() for x in _listed(v)]:
                p = str(p).strip('"')
                if m := re.match(r"^__IAM_(USER|ROLE)_(\w+)__$", p):
                    p = ids[m[1].lower()].get(m[2])
                elif ".amazonaws.com" in p or p == "__tf_ref__":
                    p = "service:" + p.replace("__tf_ref__", "lambda.amazonaws.com").split(".")[0]
                elif "iam:user" not in p and "iam:role" not in p:
                    p = ids["user"].get(_name(p)) or ids["role"].get(_name(p))
                if p:
                    rows.append(("trust", p, ids["role"][tf]))
    rows += [("profile", "service:ec2", "")] * bool(res.get("aws_iam_instance_profile"))
    rows += [("ecs", "service:ecs-tasks", "")] * bool(res.get("aws_ecs_task_definition") or res.get("aws_ecs_service"))
    return rows


def read_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """``(graph_id, path, content)`` of the files below ``root/<scenario>/``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tf,json}").text(root, wholetext=True)
    path = F.input_file_name()
    return files.select(F.regexp_extract(path, r"([^/]+)/(?:terraform/)?[^/]+$", 1).alias("graph_id"), path.alias("path"), F.col("value").alias("content"))


def _resource_id(resource, actions) -> F.Column:
    low = F.transform(actions, F.lower)
    some = lambda *ws: F.exists(low, lambda a: F.lit(False) if not ws else _or([a.contains(w) for w in ws]))
    wild = F.when(some("s3"), "s3:bucket:wildcard").when(some("lambda"), "lambda:function:wildcard").when(some("ecs"), "ecs:task:wildcard").when(some("iam", "sts"), "iam:resource:wildcard").otherwise("aws:resource:wildcard")
    parts = F.split(resource, ":")
    arn = F.concat_ws(":", F.when(F.size(parts) > 2, F.get(parts, F.lit(2))).otherwise("aws"), F.translate(F.element_at(parts, -1), "/", ":"))
    return F.when(resource == "*", wild).when(resource.startswith("arn:"), arn).otherwise(F.concat(F.lit("resource:"), F.translate(resource, "/", ":")))


def _or(cs):
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def _resource_type(actions) -> F.Column:
    low = F.transform(actions, F.lower)
    some = lambda *ws: F.exists(low, lambda a: _or([a.contains(w) for w in ws]))
    return (
        F.when(some("sts:", "iam:"), "ROLE").when(some("secretsmanager:", "ssm:", "kms:"), "SECRET").when(some("s3:"), "SECRET").when(some("lambda:", "ecs:", "ec2:"), "WORKLOAD")
        .when(some("codedeploy:", "codepipeline:"), "DEPLOYMENT").otherwise("SERVICE")
    )


def load(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, seeds)`` of ``files`` (graph_id, path, content). Of several edges between two nodes the first stays."""

    def parse(part: pd.DataFrame) -> pd.DataFrame:
        rows = scenario_rows(dict(zip(part["path"], part["content"], strict=True)))
        return pd.DataFrame([(part["graph_id"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["graph_id", "ord", "kind", "subject", "payload"])

    r = files.groupBy("graph_id").applyInPandas(parse, "graph_id string, ord bigint, kind string, subject string, payload string")
    r = cut(r)
    src = lambda s: F.create_map(F.lit("source"), F.lit(s))
    who = r.where("kind in ('user', 'role')").select(
        "graph_id", "ord", F.col("subject").alias("node_id"), F.upper("kind").alias("node_type"), F.col("payload").alias("name"), F.when(F.col("kind") == "user", 0.3).otherwise(0.5).alias("privilege_level"),
        F.when(F.col("kind") == "user", 0.4).otherwise(0.6).alias("sensitivity"), src("terraform").alias("tags"),
    )
    st = r.where("kind = 'statement'").withColumn("s", F.from_json("payload", "struct<actions:array<string>,resources:array<string>,condition_keys:array<string>>"))
    st = st.select("graph_id", "subject", F.col("s.actions").alias("actions"), F.col("s.condition_keys").alias("keys"), "ord", F.posexplode("s.resources").alias("_i", "resource")).withColumn("resource", F.trim("resource"))
    st = st.withColumn("dst", _resource_id(F.col("resource"), F.col("actions"))).withColumn("ord", F.col("ord") * (1 << 20) + F.col("_i"))
    things = st.select(
        "graph_id", (F.col("ord") + (1 << 52)).alias("ord"), F.col("dst").alias("node_id"), _resource_type(F.col("actions")).alias("node_type"), F.element_at(F.split("dst", ":"), -1).alias("name"), iam.action_privilege(F.col("actions")).alias("privilege_level"),
        iam.arn_sensitivity(F.col("resource")).alias("sensitivity"), src("terraform_policy").alias("tags"),
    )
    trust = r.where("kind = 'trust'")
    services = trust.where("subject like 'service:%'").select(
        "graph_id", (F.col("ord") + (2 << 52)).alias("ord"), F.col("subject").alias("node_id"), F.lit("SERVICE").alias("node_type"), F.concat(F.substr("subject", F.lit(9)), F.lit(".amazonaws.com")).alias("name"), F.lit(0.3).alias("privilege_level"), F.lit(0.3).alias("sensitivity"), src("terraform_trust").alias("tags")
    )
    nodes = keep_first(conform(who.unionByName(things).unionByName(services), NODES), ["graph_id", "node_id"])
    rights = st.select("graph_id", "ord", F.col("subject").alias("src"), "dst", iam.dominant_edge_type(F.col("actions")).alias("edge_type"), iam.statement_weight(F.col("actions"), F.col("keys")).alias("weight"), F.lit(DEPTH).alias("delegation_depth_limit"))
    assume = trust.select("graph_id", (F.col("ord") + (2 << 52)).alias("ord"), F.col("subject").alias("src"), F.col("payload").alias("dst"), F.lit("ASSUME_ROLE").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit(DEPTH).alias("delegation_depth_limit"))
    known = nodes.select("graph_id", F.col("node_id").alias("src"))
    assume = assume.join(known, ["graph_id", "src"], "left_semi").select(*assume.columns)
    edges = keep_first(conform(rights.unionByName(assume), EDGES), ["graph_id", "src", "dst"])
    roles = r.where("kind = 'role'").select("graph_id", F.col("subject").alias("dst"))

    def lateral(have: DataFrame, strong: DataFrame, targets: DataFrame, weight: float, base: int) -> DataFrame:
        new = strong.distinct().join(targets.distinct(), "graph_id").where("src != dst").join(have, ["graph_id", "src", "dst"], "left_anti")
        new = new.select("graph_id", F.lit(base).alias("ord"), "src", "dst", F.lit("AUTHENTICATE_AS").alias("edge_type"), F.lit(weight).alias("weight"), F.lit(3).alias("delegation_depth_limit"))
        return have.unionByName(conform(new, EDGES))

    low = F.lower("dst")
    tasks = nodes.where("node_type = 'ROLE' and lower(node_id) like '%privd%'").select("graph_id", F.col("node_id").alias("dst"))
    edges = lateral(edges, edges.where(low.contains("ecs")).select("graph_id", "src"), tasks, 0.6, 3 << 52)
    by_src = edges.groupBy("graph_id", "src").agg(F.max(low.contains("lambda")).alias("l"), F.max(low.contains("wildcard")).alias("w"), F.max(low.contains("iam:resource")).alias("i"))
    edges = lateral(edges, by_src.where("(l or w) and (l or i)").select("graph_id", "src"), roles, 0.7, 4 << 52)

    entry = r.where("kind = 'user'").select("graph_id", F.col("subject").alias("node_id")).unionByName(r.where("kind in ('profile', 'ecs')").select("graph_id", F.col("subject").alias("node_id")).join(nodes, ["graph_id", "node_id"], "left_semi")).distinct()
    fallback = nodes.withColumn("_rank", F.when(F.col("node_id").startswith("service:"), 0).when(F.col("node_type") == "ROLE", 1).otherwise(2)).join(entry, "graph_id", "left_anti").groupBy("graph_id").agg(F.min_by("node_id", F.struct("_rank", "ord", "node_id")).alias("node_id"))
    return nodes, edges.withColumn("edge_id", F.concat_ws("->", "src", "dst")), entry.unionByName(fallback)


def matched_patterns(detected: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per graph: how many of its (graph_id, pattern) occur in some detected node id, whatever the case. Patterns are a short list."""
    j = patterns.join(detected, "graph_id", "left").withColumn("hit", F.coalesce(F.lower("node_id").contains(F.lower("pattern")), F.lit(False)))
    g = j.groupBy("graph_id", "pattern").agg(F.max("hit").alias("hit")).groupBy("graph_id").agg(F.sum(F.col("hit").cast("int")).alias("found"), F.count("*").alias("total"))
    return g.select("graph_id", "found", "total", ((F.col("found") == F.col("total")) & (F.col("total") > 0)).alias("detected"), ((F.col("found") > 0) & (F.col("found") < F.col("total"))).alias("partial"))


def walkthrough_steps(readme: F.Column) -> F.Column:
    """The numbered items of a README's walkthrough section."""
    section = F.regexp_extract(readme, r"(?is)#+[^\n]*(?:walkthrough|exploitation|route)[^\n]*\n(.*?)(?=\n#|\z)", 1)
    return F.regexp_extract_all(section, F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), F.lit(1))
