"""Scores and names for access policies, as expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of lower-case actions by the kind of edge they make.
ACTION_PREFIXES = {
    "ASSUME_ROLE": ("sts:assumerole", "sts:assumerolewithwebidentity", "sts:assumerolewithsaml"),
    "TOKEN_MINT": ("lambda:invoke", "lambda:invokeasync", "lambda:invokeurl", "apigateway:invoke", "states:startexecution", "states:startsynccexecution", "events:put", "sqs:sendmessage", "sns:publish"),
    "SECRET_READ": (
        "secretsmanager:getsecretvalue", "secretsmanager:getrandompassword", "ssm:getparameter", "ssm:getparameters", "ssm:getparametersbypath", "ssm:getsecretvalue", "kms:decrypt", "kms:generatedata",
    ),
    "DEPLOY_TO": (
        "codedeploy:", "codepipeline:", "codebuild:", "ecr:initiatelayerupload", "ecs:updateservice", "ecs:registercontainerinstance", "eks:", "lambda:updatefunctioncode", "lambda:createfunction",
        "lambda:publishversion", "elasticbeanstalk:updateenvironment", "cloudformation:create", "cloudformation:update", "cloudformation:execute",
    ),
}
# Which kind of edge wins among several actions.
EDGE_PRIORITY = {"ASSUME_ROLE": 5, "SECRET_READ": 4, "DEPLOY_TO": 3, "TOKEN_MINT": 2, "AUTHENTICATE_AS": 1}
# Delegation depth by kind of edge.
DEPTH_BY_TYPE = {"ASSUME_ROLE": 6, "TOKEN_MINT": 3, "SECRET_READ": 1, "DEPLOY_TO": 2, "AUTHENTICATE_AS": 2}
# Action prefixes and verbs of the privilege ladder.
STRONG_PREFIXES = ("iam:", "sts:", "organizations:", "kms:create", "kms:delete", "kms:schedule", "ec2:*", "eks:", "ecs:register", "lambda:create", "lambda:delete", "lambda:update", "cloudformation:")
SECRET_PREFIXES = ("secretsmanager:", "ssm:getparam", "kms:decrypt")
WRITE_VERBS = ("create", "delete", "update", "put", "write", "invoke", "attach", "detach", "modify", "start", "stop", "reboot")
# Words in policy names that tell of wide rights.
STRONG_NAMES = ("admin", "poweruser", "fullaccess", "administrator", "iam", "root", "sudo", "owner")
# Resources and verbs of cluster roles.
K8S_SENSITIVE = ("secrets", "serviceaccounts/token", "clusterrolebindings", "rolebindings", "clusterroles", "roles")
K8S_EXEC = ("pods/exec", "pods/attach", "pods/portforward")
K8S_WRITE = ("create", "delete", "deletecollection", "update", "patch", "*")

WILDCARD = "aws:resource:wildcard"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _starts(c: Column, prefixes) -> Column:
    return _any(c.startswith(p) for p in prefixes)


def _has(c: Column, parts) -> Column:
    return _any(c.contains(p) for p in parts)


def action_edge_type(action: Column) -> Column:
    """The kind of edge that an action makes; ``*`` assumes roles, unknown actions authenticate."""
    a = F.lower(F.trim(action))
    out = F.when(a == "*", "ASSUME_ROLE")
    for kind, prefixes in ACTION_PREFIXES.items():
        out = out.when(_starts(a, prefixes), kind)
    return out.otherwise("AUTHENTICATE_AS")


def dominant_edge_type(actions: Column) -> Column:
    """The kind of edge with the highest priority among an array of actions; AUTHENTICATE_AS if empty."""
    ranked = F.transform(actions, lambda a: F.create_map(*[F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv])[action_edge_type(a)])
    best = F.coalesce(F.array_max(ranked), F.lit(1))
    names = {v: k for k, v in EDGE_PRIORITY.items()}
    return F.element_at(F.array(*[F.lit(names[i]) for i in range(1, 6)]), best)


_ARN = r"^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)"


def parse_arn(arn: Column) -> Column:
    """``struct(partition, service, region, account, resource_type, resource_name)``; null if it isn't an ARN."""
    part = lambda i: F.regexp_extract(arn, _ARN, i)
    resource = part(5)
    kind = F.substring_index(resource, "/", 1)
    name = F.when(resource.contains("/"), F.regexp_replace(resource, "^[^/]*/", "")).otherwise(resource)
    fields = F.struct(part(1).alias("partition"), part(2).alias("service"), part(3).alias("region"), part(4).alias("account"), kind.alias("resource_type"), name.alias("resource_name"))
    return F.when(arn.rlike(_ARN), fields)


def arn_node_id(arn: Column) -> Column:
    """``service:type:name``, ``iam:root:account`` for a root, and anything that isn't an ARN as it is."""
    p = parse_arn(arn)
    return F.when(p.isNull(), arn).when(p["resource_type"] == "root", F.concat(F.lit("iam:root:"), p["account"])).otherwise(F.concat_ws(":", p["service"], p["resource_type"], p["resource_name"]))


def arn_node_type(arn: Column) -> Column:
    a = F.lower(arn)
    return (
        F.when(a.contains(":role/") | a.endswith(":role"), "ROLE").when(a.contains(":user/"), "USER").when(_has(a, ("lambda", "apigateway", "states")), "SERVICE")
        .when(_has(a, ("secretsmanager", "/secret:", "ssm", "kms")), "SECRET").when(_has(a, ("ec2", "ecs", "eks", "pod")), "WORKLOAD").when(_has(a, ("codepipeline", "codebuild", "codedeploy")), "DEPLOYMENT")
        .when(a.contains("s3"), "SECRET").when(a.contains(".amazonaws.com"), "SERVICE").otherwise("USER")
    )


def arn_sensitivity(arn: Column) -> Column:
    a = F.lower(arn)
    return (
        F.when(_has(a, ("secretsmanager", "ssm", "kms")), 0.9).when(_has(a, (":role/", "iam:")), 0.8).when(_has(a, ("lambda", "ec2", "eks", "ecs")), 0.6)
        .when(a.contains("s3"), 0.5).when(_has(a, ("logs", "cloudwatch", "cloudtrail")), 0.3).otherwise(0.4)
    )


def arn_name(arn: Column) -> Column:
    """The last part after ``/`` and ``:``, or all of it where that is empty."""
    last = F.element_at(F.split(F.element_at(F.split(arn, "/"), -1), ":"), -1)
    return F.when(last == "", arn).otherwise(last)


def action_privilege(actions: Column) -> Column:
    """The privilege ladder over an array of actions."""
    low = F.transform(actions, F.lower)
    some = lambda f: F.exists(low, f)
    return (
        F.when(some(lambda a: a == "*"), 1.0).when(some(lambda a: a.startswith("iam:")), 0.9).when(some(lambda a: a.startswith("sts:")), 0.85).when(some(lambda a: _starts(a, STRONG_PREFIXES)), 0.75)
        .when(some(lambda a: _starts(a, SECRET_PREFIXES)), 0.7).when(some(lambda a: a.endswith(":*")), 0.65).when(some(lambda a: _has(a, WRITE_VERBS)), 0.5).otherwise(0.25)
    )


def statement_weight(actions: Column, condition_keys: Column) -> Column:
    """The edge weight of a statement: its privilege, less with conditions, less again if a top-level condition key names MFA."""
    keys = F.coalesce(condition_keys, F.array().cast("array<string>"))
    base = action_privilege(actions) * F.when(F.size(keys) > 0, 0.8).otherwise(1.0) * F.when(has_mfa(keys, "multifactorauthpresent"), 0.7).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), base)), 4)


def has_mfa(condition_keys: Column, word: str = "multifactor") -> Column:
    return F.coalesce(F.exists(condition_keys, lambda k: _has(F.lower(k), (word, "mfa"))), F.lit(False))


def policy_name_privilege(names: Column) -> Column:
    """0.9 if a policy name tells of wide rights, 0.5 if there are policies, else 0.2."""
    n = F.coalesce(names, F.array().cast("array<string>"))
    return F.when(F.exists(n, lambda x: _has(F.lower(F.coalesce(x, F.lit(""))), STRONG_NAMES)), 0.9).when(F.size(n) > 0, 0.5).otherwise(0.2)


def _lits(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def k8s_privilege(verbs: Column, resources: Column, n_rules: Column) -> Column:
    any_verb, all_things = F.array_contains(verbs, "*"), F.array_contains(resources, "*")
    sensitive, write = F.arrays_overlap(resources, _lits(K8S_SENSITIVE)), F.arrays_overlap(verbs, _lits(K8S_WRITE))
    return F.when(n_rules == 0, 0.1).when(any_verb & all_things, 1.0).when(any_verb, 0.9).when(sensitive & write, 0.85).when(F.arrays_overlap(resources, _lits(K8S_EXEC)), 0.8).when(sensitive, 0.7).when(write, 0.55).otherwise(0.25)


def k8s_sensitivity(resources: Column, n_rules: Column) -> Column:
    return (
        F.when(n_rules == 0, 0.1).when(F.array_contains(resources, "*"), 0.9).when(F.arrays_overlap(resources, _lits(K8S_SENSITIVE)), 0.8).when(F.arrays_overlap(resources, _lits(K8S_EXEC)), 0.75)
        .when(F.arrays_overlap(resources, _lits(("nodes", "persistentvolumes"))), 0.6).otherwise(0.4)
    )
