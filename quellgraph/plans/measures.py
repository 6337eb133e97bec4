"""Queries on scores, sweeps, calibration, policy functions and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.functions import iam
from quellgraph.operators import evaluation as ev
from quellgraph.operators import packed_fields
from quellgraph.operators import traversal as t
from quellgraph.operators import verification as ve
from quellgraph.plans.found_sql import P3_DOCS
from quellgraph.plans.registry import query
from quellgraph.plans.views import ORG_SQL, org_edges, org_nodes, org_seeds
from quellgraph.runtime import cut, table
from quellgraph.sources import iam as iam_source
from quellgraph.sources import k8s, simulate

# The node lists split by rule, and each list as a set of flags per node.
LISTS_SQL = r"""
    raw AS (SELECT id, model_name, topology_type, 'predicted_nodes' AS f, predicted_nodes AS r FROM model_history UNION ALL SELECT id, model_name, topology_type, 'actual_nodes', actual_nodes FROM model_history),
    body AS (SELECT *, regexp_replace(regexp_replace(r, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[\[\(\{](.*)[\]\)\}]$', '\1', 's') AS b, regexp_matches(r, '^[\s\p{Z}]*[\[\(\{][\s\p{Z}]*''') AS single FROM raw WHERE r IS NOT NULL),
    toks AS (SELECT id, model_name, topology_type, f, single, CASE WHEN single THEN regexp_extract_all(b, '''(?:[^''\\]|\\.|'''')*''|[^,;|；，、\s\p{Z}]+') ELSE regexp_extract_all(b, '"(?:[^"\\]|\\.|"")*"|[^,;|；，、\s\p{Z}]+') END AS a FROM body),
    items AS (SELECT id, model_name, topology_type, f, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS t, single FROM toks),
    clean AS (SELECT id, model_name, topology_type, f, pos, CASE WHEN length(t) > 1 AND t[1] = (CASE WHEN single THEN '''' ELSE '"' END) AND t[-1] = t[1] THEN replace(regexp_replace(t[2:-2], '\\(.)', '\1', 'g'), t[1] || t[1], t[1]) ELSE t END AS v FROM items),
    split_ids AS (SELECT id, model_name, topology_type, f, row_number() OVER (PARTITION BY id, f ORDER BY pos) AS pos, regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS node_id FROM clean WHERE regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '')"""
FLAG_SQL = f"{LISTS_SQL}, pairs AS (SELECT id, model_name, topology_type, node_id, bool_or(f = 'predicted_nodes') AS p, bool_or(f = 'actual_nodes') AS a FROM split_ids GROUP BY ALL)"


def _lists(spark, d) -> DataFrame:
    """The node lists of every prediction as flags per node."""
    h = table(spark, d, "model_history")
    v = packed_fields.split_packed(h, "id", ["predicted_nodes", "actual_nodes"])
    return v.groupBy("id", F.col("value").alias("node_id")).agg(F.max(F.col("field_name") == "predicted_nodes").alias("predicted"), F.max(F.col("field_name") == "actual_nodes").alias("actual"))


def _metric_sql(by: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
        round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1"""


_COUNTS = "sum((p AND a)::INT)::BIGINT AS tp, sum((p AND NOT a)::INT)::BIGINT AS fp, sum((a AND NOT p)::INT)::BIGINT AS fn"


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {FLAG_SQL}, c AS (SELECT id, {_COUNTS} FROM pairs GROUP BY 1) {_metric_sql('id')} FROM c")
def prf_set(spark, d):
    return _r6(ve.prf(_lists(spark, d), ["id"]), "precision", "recall", "f1")


@query(f"WITH {FLAG_SQL}, c AS (SELECT id, {_COUNTS} FROM pairs GROUP BY 1) SELECT id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fp = 0 THEN 0.0 WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM c")
def prf_calibration(spark, d):
    return _r6(ve.prf(_lists(spark, d), ["id"], "calibration"), "precision", "recall", "f1")


@query(f"WITH {FLAG_SQL}, c AS (SELECT model_name, {_COUNTS} FROM pairs GROUP BY 1) {_metric_sql('model_name')} FROM c")
def prf_micro(spark, d):
    names = table(spark, d, "model_history").select("id", "model_name")
    return _r6(ve.prf(_lists(spark, d).join(names, "id"), ["model_name"]), "precision", "recall", "f1")


@query(f"WITH {FLAG_SQL}, c AS (SELECT id, model_name, {_COUNTS} FROM pairs GROUP BY 1, 2), m AS ({_metric_sql('model_name')} FROM c) SELECT model_name, round(avg(f1), 5) AS macro_f1, count(*) AS n FROM m GROUP BY 1")
def prf_macro(spark, d):
    names = table(spark, d, "model_history").select("id", "model_name")
    m = _r6(ve.prf(_lists(spark, d).join(names, "id"), ["id", "model_name"]), "f1")
    return m.groupBy("model_name").agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.count("*").alias("n"))


@query(f"WITH {FLAG_SQL} SELECT id, round(sum((p AND a)::INT) / count(*)::DOUBLE, 6) AS iou FROM pairs GROUP BY 1")
def iou(spark, d):
    return _r6(ve.iou(_lists(spark, d), ["id"]), "iou")


def _scored(spark, d):
    h = table(spark, d, "model_history").where("topology_type in ('HUB', 'CHAIN', 'DENSE_CLUSTER', 'MIXED') and precision_score is not null and recall_score is not null and f1_score is not null")
    return h.select(F.col("model_name").alias("model"), F.col("topology_type").alias("topology"), F.col("precision_score").alias("precision"), F.col("recall_score").alias("recall"), F.col("f1_score").alias("f1"))


_SCORED = "s AS (SELECT model_name AS model, topology_type AS topology, precision_score AS precision, recall_score AS recall, f1_score AS f1 FROM model_history WHERE topology_type IN ('HUB', 'CHAIN', 'DENSE_CLUSTER', 'MIXED') AND precision_score IS NOT NULL AND recall_score IS NOT NULL AND f1_score IS NOT NULL)"


@query(f"""WITH {_SCORED}, c AS (SELECT * FROM (VALUES ('graph_traversal', 1.0), ('epidemic', 0.2608), ('spectral_cascade', 0.2974), ('percolation', 0.7279), ('control_system', 0.1267), ('gnn', 0.62)) t(model, confidence)),
    g AS (SELECT model, topology, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS n FROM s GROUP BY GROUPING SETS ((model, topology), (model)))
    SELECT model, topology, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n, confidence::DOUBLE AS confidence, round(abs(confidence - f1), 6) AS error, abs(confidence - f1) < 0.05 AS calibrated FROM g LEFT JOIN c USING (model)""")
def calibration(spark, d):
    from quellgraph.operators.propagation import CONFIDENCE

    stated = spark.createDataFrame(list(CONFIDENCE.items()), "model string, confidence double")
    return _r6(ev.calibration(_scored(spark, d), stated), "precision", "recall", "f1", "error")


@query(f"WITH {_SCORED} SELECT model, topology, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, min(f1) AS min, max(f1) AS max, count(f1) AS n FROM s GROUP BY 1, 2")
def sweep_stats(spark, d):
    return _r6(ev.sweep_stats(_scored(spark, d), ["model", "topology"], "f1"), "mean", "std")


@query("""WITH g AS (SELECT o_orderpriority AS stage, count(*)::DOUBLE AS n, sum(o_totalprice) AS total_ms FROM orders GROUP BY 1, o_custkey), s AS (SELECT stage, regr_slope(ln(total_ms), ln(n)) AS slope FROM g GROUP BY 1)
    SELECT stage, round(slope, 6) AS slope, CASE WHEN slope < 1.1 THEN 'O(n)' WHEN slope < 1.25 THEN 'O(n log n)' WHEN slope < 1.75 THEN 'O(n^1.5)' ELSE 'O(n^2)' END AS label FROM s""")
def complexity_fit(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), "o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total_ms"))
    return _r6(ev.complexity(g, ["stage"]), "slope")


@query(f"WITH {ORG_SQL} SELECT * FROM seeds")
def pick_seeds(spark, d):
    return org_seeds(spark, d)


@query(f"WITH {ORG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY graph_id) AS n FROM nodes) SELECT graph_id, node_id FROM r WHERE i = 7 % n")
def nth_node_seed(spark, d):
    return ev.nth_node(org_nodes(spark, d), 7)


@query(f"""WITH RECURSIVE {ORG_SQL}, reach AS (SELECT graph_id, node_id FROM seeds UNION SELECT r.graph_id, e.dst FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node_id), pat AS (SELECT graph_id, p FROM (SELECT DISTINCT graph_id FROM nodes) CROSS JOIN (VALUES ('S3:Bucket'), ('kms'), ('no-such')) t(p)),
    h AS (SELECT pat.graph_id, p, coalesce(bool_or(contains(lower(node_id), lower(p))), false) AS hit FROM pat LEFT JOIN reach USING (graph_id) GROUP BY 1, 2) SELECT graph_id, sum(hit::INT)::BIGINT AS found, count(*) AS total, bool_and(hit) AS detected, sum(hit::INT) > 0 AND NOT bool_and(hit) AS partial FROM h GROUP BY 1""")
def path_pattern_match(spark, d):
    from quellgraph.sources.terraform import matched_patterns

    n = org_nodes(spark, d)
    pats = n.select("graph_id").distinct().select("graph_id", F.explode(F.array(*[F.lit(x) for x in ("S3:Bucket", "kms", "no-such")])).alias("pattern"))
    return matched_patterns(t.bfs(org_edges(spark, d), org_seeds(spark, d)).select("graph_id", "node_id"), pats)


@query(f"""WITH {ORG_SQL}, strong AS (SELECT DISTINCT graph_id, src FROM edges WHERE contains(lower(dst), 'lambda')), roles AS (SELECT graph_id, node_id AS dst FROM nodes WHERE node_type = 'ROLE' AND privilege_level >= 0.8)
    SELECT s.graph_id, s.src, r.dst FROM strong s JOIN roles r USING (graph_id) WHERE s.src <> r.dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = s.graph_id AND e.src = s.src AND e.dst = r.dst)""")
def passrole_lateral(spark, d):
    e, n = org_edges(spark, d), org_nodes(spark, d)
    strong = e.where(F.lower("dst").contains("lambda")).select("graph_id", "src").distinct()
    roles = n.where("node_type = 'ROLE' and privilege_level >= 0.8").select("graph_id", F.col("node_id").alias("dst"))
    return strong.join(roles, "graph_id").where("src != dst").join(e, ["graph_id", "src", "dst"], "left_anti")


_ACTION = r'"([A-Za-z0-9-]+:[A-Za-z0-9*]+)"'
_EXTRA = ("*", "sts:TagSession", "ec2:*", "s3:*", "events:PutRule", "lambda:InvokeAsync", "secretsmanager:GetRandomPassword", "eks:DescribeCluster", "kms:ScheduleKeyDeletion", "organizations:ListRoots", "rds:RebootDBInstance")
_ACTIONS_SQL = f"a AS (SELECT DISTINCT unnest(regexp_extract_all(content, '{_ACTION}', 1)) AS action FROM policy_files UNION SELECT unnest([{', '.join(repr(x) for x in _EXTRA)}]))"


def _actions(spark, d) -> DataFrame:
    """Everything in the policy files that reads like an action, and some that they lack."""
    found = table(spark, d, "policy_files").select(F.explode(F.regexp_extract_all("content", F.lit(_ACTION), F.lit(1))).alias("action"))
    return found.unionByName(spark.createDataFrame([(x,) for x in _EXTRA], "action string")).distinct()


# The prefixes below are stated here again, and not taken from the functions that they check.
@query(f"""WITH {_ACTIONS_SQL}, l AS (SELECT action, lower(trim(action)) AS x FROM a) SELECT action, CASE WHEN x = '*' THEN 'ASSUME_ROLE' WHEN starts_with(x, 'sts:assumerole') THEN 'ASSUME_ROLE'
    WHEN regexp_matches(x, '^(lambda:invoke|apigateway:invoke|states:startexecution|states:startsynccexecution|events:put|sqs:sendmessage|sns:publish)') THEN 'TOKEN_MINT'
    WHEN regexp_matches(x, '^(secretsmanager:getsecretvalue|secretsmanager:getrandompassword|ssm:getparameter|ssm:getsecretvalue|kms:decrypt|kms:generatedata)') THEN 'SECRET_READ'
    WHEN regexp_matches(x, '^(codedeploy:|codepipeline:|codebuild:|ecr:initiatelayerupload|ecs:updateservice|ecs:registercontainerinstance|eks:|lambda:updatefunctioncode|lambda:createfunction|lambda:publishversion|elasticbeanstalk:updateenvironment|cloudformation:create|cloudformation:update|cloudformation:execute)') THEN 'DEPLOY_TO'
    ELSE 'AUTHENTICATE_AS' END AS edge_type FROM l""")
def action_edge_type(spark, d):
    return _actions(spark, d).select("action", iam.action_edge_type(F.col("action")).alias("edge_type"))


@query(f"""WITH {_ACTIONS_SQL}, l AS (SELECT action, lower(action) AS x FROM a) SELECT action, CASE WHEN x = '*' THEN 1.0 WHEN starts_with(x, 'iam:') THEN 0.9 WHEN starts_with(x, 'sts:') THEN 0.85
    WHEN regexp_matches(x, '^(organizations:|kms:create|kms:delete|kms:schedule|ec2:[*]|eks:|ecs:register|lambda:create|lambda:delete|lambda:update|cloudformation:)') THEN 0.75 WHEN regexp_matches(x, '^(secretsmanager:|ssm:getparam|kms:decrypt)') THEN 0.7
    WHEN x LIKE '%:*' THEN 0.65 WHEN regexp_matches(x, '(create|delete|update|put|write|invoke|attach|detach|modify|start|stop|reboot)') THEN 0.5 ELSE 0.25 END::DOUBLE AS privilege FROM l""")
def privilege_ladder(spark, d):
    return _actions(spark, d).select("action", iam.action_privilege(F.array("action")).alias("privilege"))


ARN_SQL = r"""p AS (SELECT policy_arn AS arn FROM policy_catalog UNION ALL SELECT 'arn:aws:iam::1:root' UNION ALL SELECT 'lambda.amazonaws.com' UNION ALL SELECT 'arn:aws:s3:::bucket' UNION ALL SELECT 'arn:aws:lambda:eu:1:function:f' UNION ALL SELECT 'arn:aws:iam::1:role/a/b'),
    q AS (SELECT arn, regexp_matches(arn, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)') AS ok, regexp_extract(arn, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 2) AS svc, regexp_extract(arn, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 4) AS acc, regexp_extract(arn, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 5) AS res FROM p)"""


@query(f"WITH {ARN_SQL} SELECT arn, CASE WHEN NOT ok THEN arn WHEN split_part(res, '/', 1) = 'root' THEN 'iam:root:' || acc ELSE svc || ':' || split_part(res, '/', 1) || ':' || CASE WHEN contains(res, '/') THEN regexp_replace(res, '^[^/]*/', '') ELSE res END END AS node_id FROM q")
def arn_parse(spark, d):
    extra = ["arn:aws:iam::1:root", "lambda.amazonaws.com", "arn:aws:s3:::bucket", "arn:aws:lambda:eu:1:function:f", "arn:aws:iam::1:role/a/b"]
    a = table(spark, d, "policy_catalog").select(F.col("policy_arn").alias("arn")).unionByName(spark.createDataFrame([(x,) for x in extra], "arn string"))
    return a.select("arn", iam.arn_node_id(F.col("arn")).alias("node_id"))


_LIST_OF = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN NULL WHEN json_type({0}) = 'ARRAY' THEN list_transform({0}::JSON[], lambda x: json_extract_string(x, '$')) WHEN json_extract_string({0}, '$') = '' THEN NULL ELSE [json_extract_string({0}, '$')] END"
_ARN_ID = r"""CASE WHEN NOT regexp_matches({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)') THEN {0} WHEN split_part(regexp_extract({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 5), '/', 1) = 'root' THEN 'iam:root:' || regexp_extract({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 4)
    ELSE regexp_extract({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 2) || ':' || split_part(regexp_extract({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 5), '/', 1) || ':' || regexp_replace(regexp_extract({0}, '^arn:([^:]+):([^:]*):([^:]*):([^:]*):(.+)', 5), '^[^/]*/', '') END"""
# What the statements of ``stated`` (graph_id, subject, o, a) give. Prefixes are stated here again.
STATEMENT_SQL = rf"""
    st AS (SELECT graph_id, subject, o * 1048576 + unnest(range(0, len(a))) AS o, unnest(a) AS s FROM stated),
    said AS (
        SELECT graph_id, subject, o, coalesce(json_type(json_extract(s, '$.Principal')), 'NULL') <> 'NULL' AS trust, json_extract(s, '$.Principal') AS p, coalesce({_LIST_OF.format("json_extract(s, '$.Action')")}, CASE WHEN coalesce(json_type(json_extract(s, '$.Principal')), 'NULL') <> 'NULL' THEN ['sts:AssumeRole'] ELSE ['*'] END) AS acts,
            coalesce({_LIST_OF.format("json_extract(s, '$.Resource')")}, ['*']) AS res, CASE WHEN json_type(json_extract(s, '$.Condition')) = 'OBJECT' THEN json_keys(json_extract(s, '$.Condition')) ELSE [] END AS conds FROM st WHERE coalesce(json_extract_string(s, '$.Effect'), 'Allow') = 'Allow'
    ),
    who AS (SELECT *, CASE WHEN json_type(p) = 'OBJECT' THEN list_concat(list_concat(coalesce({_LIST_OF.format("json_extract(p, '$.AWS')")}, []), coalesce({_LIST_OF.format("json_extract(p, '$.Service')")}, [])), coalesce({_LIST_OF.format("json_extract(p, '$.Federated')")}, [])) ELSE {_LIST_OF.format('p')} END AS ps FROM said),
    meant AS (SELECT *, list_max(list_transform(acts, lambda x: CASE WHEN trim(x) = '*' OR starts_with(lower(trim(x)), 'sts:assumerole') THEN 5 WHEN regexp_matches(lower(trim(x)), '^(secretsmanager:getsecretvalue|secretsmanager:getrandompassword|ssm:getparameter|ssm:getsecretvalue|kms:decrypt|kms:generatedata)') THEN 4
            WHEN regexp_matches(lower(trim(x)), '^(codedeploy:|codepipeline:|codebuild:|ecr:initiatelayerupload|ecs:updateservice|ecs:registercontainerinstance|eks:|lambda:updatefunctioncode|lambda:createfunction|lambda:publishversion|elasticbeanstalk:updateenvironment|cloudformation:create|cloudformation:update|cloudformation:execute)') THEN 3
            WHEN regexp_matches(lower(trim(x)), '^(lambda:invoke|apigateway:invoke|states:startexecution|states:startsynccexecution|events:put|sqs:sendmessage|sns:publish)') THEN 2 ELSE 1 END)) AS rank,
        list_min(list_transform(acts, lambda x: CASE WHEN x = '*' THEN 1 WHEN starts_with(lower(x), 'iam:') THEN 2 WHEN starts_with(lower(x), 'sts:') THEN 3 WHEN regexp_matches(lower(x), '^(organizations:|kms:create|kms:delete|kms:schedule|ec2:[*]|eks:|ecs:register|lambda:create|lambda:delete|lambda:update|cloudformation:)') THEN 4
            WHEN regexp_matches(lower(x), '^(secretsmanager:|ssm:getparam|kms:decrypt)') THEN 5 WHEN lower(x) LIKE '%:*' THEN 6 WHEN regexp_matches(lower(x), '(create|delete|update|put|write|invoke|attach|detach|modify|start|stop|reboot)') THEN 7 ELSE 8 END)) AS step FROM who),
    ends AS (SELECT graph_id, subject, o, trust, unnest(CASE WHEN trust THEN (CASE WHEN len(ps) = 0 THEN ['*'] ELSE ps END) ELSE res END) AS other, (['AUTHENTICATE_AS', 'TOKEN_MINT', 'DEPLOY_TO', 'SECRET_READ', 'ASSUME_ROLE'])[coalesce(rank, 1)] AS edge_type, ([2, 3, 2, 1, 6])[coalesce(rank, 1)] AS delegation_depth_limit,
        round(greatest(0.05, least(1.0, ([1.0, 0.9, 0.85, 0.75, 0.7, 0.65, 0.5, 0.25])[coalesce(step, 8)]::DOUBLE * CASE WHEN len(conds) > 0 THEN 0.8::DOUBLE ELSE 1.0 END * CASE WHEN len(list_filter(conds, lambda k: contains(lower(k), 'mfa') OR contains(lower(k), 'multifactorauthpresent'))) > 0 THEN 0.7::DOUBLE ELSE 1.0 END)), 4) AS weight, len(conds) > 0 AS is_conditional FROM meant),
    named AS (SELECT *, CASE WHEN NOT trust AND other = '*' THEN 'aws:resource:wildcard' ELSE {_ARN_ID.format('other')} END AS other_id FROM ends),
    raw_pe AS (SELECT graph_id, o, CASE WHEN trust THEN other_id ELSE subject END AS src, CASE WHEN trust THEN subject ELSE other_id END AS dst, edge_type, weight::DOUBLE AS weight, delegation_depth_limit, is_conditional FROM named),
    pe AS (SELECT * FROM raw_pe WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY weight DESC, o, edge_type DESC) = 1)"""
# How the documents of policies and role bundles nest.
POLICY_SQL = rf"""
    f AS (SELECT DISTINCT file_id::VARCHAR AS graph_id, content::JSON AS j FROM policy_files),
    b AS (SELECT *, json_exists(j, '$.RoleName') OR json_exists(j, '$.TrustPolicy') AS bundle, coalesce(json_extract_string(j, '$.RoleArn'), '') AS arn FROM f),
    subjects AS (SELECT graph_id, j, bundle, CASE WHEN NOT bundle THEN 'iam:policy:policy-subject' WHEN arn <> '' THEN {_ARN_ID.format('arn')} ELSE 'iam:role:' || coalesce(json_extract_string(j, '$.RoleName'), 'unknown-role') END AS subject FROM b),
    wraps AS (
        SELECT graph_id, subject, 1 AS o, j AS w FROM subjects WHERE NOT bundle UNION ALL SELECT graph_id, subject, unnest(range(2, len(a) + 2)), json_extract(unnest(a), '$.Document')
        FROM (SELECT graph_id, subject, CASE json_type(json_extract(j, '$.PermissionPolicies')) WHEN 'ARRAY' THEN json_extract(j, '$.PermissionPolicies')::JSON[] WHEN 'OBJECT' THEN [json_extract(j, '$.PermissionPolicies')] ELSE [] END AS a FROM subjects WHERE bundle)
    ),
    pdocs AS (
        SELECT graph_id, subject, o, CASE WHEN json_exists(w, '$.Statement') THEN w ELSE coalesce(json_extract(w, '$.PolicyVersion.Document'), json_extract(w, '$.Document')) END AS doc FROM wraps
        UNION ALL SELECT graph_id, subject, 1, json_extract(j, '$.TrustPolicy') FROM subjects WHERE bundle
    ),
    stated AS (SELECT graph_id, subject, o, CASE WHEN doc IS NULL OR json_extract(doc, '$.Statement') IS NULL THEN [] WHEN json_type(json_extract(doc, '$.Statement')) = 'ARRAY' THEN json_extract(doc, '$.Statement')::JSON[] ELSE [json_extract(doc, '$.Statement')] END AS a FROM pdocs),
{STATEMENT_SQL}"""


_ARN_TYPE = """CASE WHEN contains(lower({0}), ':role/') OR ends_with(lower({0}), ':role') THEN 'ROLE' WHEN contains(lower({0}), ':user/') THEN 'USER' WHEN regexp_matches(lower({0}), '(lambda|apigateway|states)') THEN 'SERVICE' WHEN regexp_matches(lower({0}), '(secretsmanager|/secret:|ssm|kms)') THEN 'SECRET'
    WHEN regexp_matches(lower({0}), '(ec2|ecs|eks|pod)') THEN 'WORKLOAD' WHEN regexp_matches(lower({0}), '(codepipeline|codebuild|codedeploy)') THEN 'DEPLOYMENT' WHEN contains(lower({0}), 's3') THEN 'SECRET' WHEN contains(lower({0}), '.amazonaws.com') THEN 'SERVICE' ELSE 'USER' END"""
_ARN_SENSITIVITY = """CASE WHEN regexp_matches(lower({0}), '(secretsmanager|ssm|kms)') THEN 0.9 WHEN regexp_matches(lower({0}), '(:role/|iam:)') THEN 0.8 WHEN regexp_matches(lower({0}), '(lambda|ec2|eks|ecs)') THEN 0.6 WHEN contains(lower({0}), 's3') THEN 0.5 WHEN regexp_matches(lower({0}), '(logs|cloudwatch|cloudtrail)') THEN 0.3 ELSE 0.4 END::DOUBLE"""
POLICY_NODES_SQL = f"""{POLICY_SQL},
    all_n AS (
        SELECT graph_id, 0 AS o, subject AS node_id, CASE WHEN bundle THEN 'ROLE' ELSE 'USER' END AS node_type, CASE WHEN bundle THEN 0.5 ELSE 0.3 END::DOUBLE AS privilege_level, CASE WHEN bundle THEN 0.6 ELSE 0.4 END::DOUBLE AS sensitivity, bundle AS own
        FROM subjects z WHERE bundle OR EXISTS (SELECT 1 FROM pdocs d WHERE d.graph_id = z.graph_id AND d.doc IS NOT NULL)
        UNION ALL SELECT graph_id, o, other_id, {_ARN_TYPE.format('other')}, CASE WHEN {_ARN_TYPE.format('other')} = 'ROLE' THEN 0.5 ELSE 0.3 END, {_ARN_SENSITIVITY.format('other')}, false FROM named
    ),
    first_n AS (SELECT * FROM all_n QUALIFY row_number() OVER (PARTITION BY graph_id, node_id ORDER BY o) = 1),
    best AS (SELECT graph_id, src AS node_id, round(max(weight), 4) AS w FROM pe GROUP BY 1, 2),
    pn AS (SELECT n.graph_id, n.node_id, node_type, CASE WHEN own THEN coalesce(w, privilege_level) ELSE privilege_level END AS privilege_level, sensitivity FROM first_n n LEFT JOIN best USING (graph_id, node_id))"""


def _files(spark, d, family=None):
    f = table(spark, d, "policy_files")
    f = (f if family is None else f.where(F.col("family") == family)).dropDuplicates(["file_id"])
    return f.select(F.col("file_id").cast("string").alias("graph_id"), "content")


@query("""WITH d AS (SELECT DISTINCT file_id, content::JSON AS j FROM policy_files) SELECT file_id, CASE WHEN json_exists(j, '$.RoleName') OR json_exists(j, '$.TrustPolicy') THEN 'role_bundle' WHEN json_exists(j, '$.PolicyVersion.Document') THEN 'mamip_policy' WHEN json_exists(j, '$.Statement') THEN 'policy_doc' ELSE 'unknown' END AS format FROM d""")
def detect_formats(spark, d):
    f = table(spark, d, "policy_files").dropDuplicates(["file_id"])
    return f.select("file_id", iam_source.detect_format(F.col("content")).alias("format"))


@query(f"WITH {POLICY_SQL} SELECT graph_id, src, dst, edge_type, weight, delegation_depth_limit FROM pe WHERE graph_id IN (SELECT file_id::VARCHAR FROM policy_files WHERE family = 's3_read_only')")
def policy_edges(spark, d):
    return iam_source.load_policies(_files(spark, d, "s3_read_only"))[1].select("graph_id", "src", "dst", "edge_type", "weight", "delegation_depth_limit")


def _role_bundles(spark, d):
    """The graphs of all role bundles, whatever their family."""
    return iam_source.load_role_bundles(_files(spark, d).where(iam_source.detect_format(F.col("content")) == "role_bundle"))


@query(f"WITH {POLICY_NODES_SQL} SELECT * FROM pn WHERE graph_id IN (SELECT graph_id FROM subjects WHERE bundle)")
def role_bundle_nodes(spark, d):
    return _role_bundles(spark, d)[0].select("graph_id", "node_id", "node_type", "privilege_level", "sensitivity")


@query(f"WITH {POLICY_SQL} SELECT graph_id, src, dst, edge_type, weight, delegation_depth_limit FROM pe WHERE graph_id IN (SELECT graph_id FROM subjects WHERE bundle)")
def role_bundle_edges(spark, d):
    return _role_bundles(spark, d)[1].select("graph_id", "src", "dst", "edge_type", "weight", "delegation_depth_limit")


@query(f"WITH {POLICY_NODES_SQL} SELECT * FROM pn")
def policy_file_nodes(spark, d):
    """Every file by its detected format."""
    return iam_source.load_any(_files(spark, d))[0].select("graph_id", "node_id", "node_type", "privilege_level", "sensitivity")


@query(f"WITH {POLICY_SQL} SELECT graph_id, src, dst, edge_type, weight, delegation_depth_limit FROM pe")
def policy_file_edges(spark, d):
    return iam_source.load_any(_files(spark, d))[1].select("graph_id", "src", "dst", "edge_type", "weight", "delegation_depth_limit")


def _dumps(spark, d):
    a = table(spark, d, "account_dump").dropDuplicates(["dump_id"])
    return a.select(F.col("dump_id").cast("string").alias("graph_id"), F.col("dump").alias("content"))


ACCOUNT_SQL = rf"""{P3_DOCS},
    subj AS (SELECT dump_id, entity_list, entity_pos, e, coalesce(json_extract_string(e, '$.Arn'), '') AS arn FROM ents),
    ids AS (SELECT dump_id, entity_list, entity_pos, e, arn, ((CASE entity_list WHEN 'UserDetailList' THEN 0 WHEN 'GroupDetailList' THEN 1 ELSE 2 END)::BIGINT << 28) + entity_pos - 1 AS o,
        CASE WHEN entity_list = 'GroupDetailList' THEN 'iam:group:' || coalesce(json_extract_string(e, '$.GroupName'), 'unknown-group') WHEN arn <> '' THEN {_ARN_ID.format('arn')} WHEN entity_list = 'UserDetailList' THEN 'iam:user:' || coalesce(json_extract_string(e, '$.UserName'), 'unknown-user') ELSE 'iam:role:' || coalesce(json_extract_string(e, '$.RoleName'), 'unknown-role') END AS subject FROM subj),
    managed AS (SELECT d.dump_id, json_extract_string(p.e, '$.Arn') AS arn, arg_min(d.doc, d.doc_pos) AS doc FROM docs_ d JOIN pols p ON p.dump_id = d.dump_id AND p.pos = d.parent_pos
        JOIN raws r ON r.dump_id = d.dump_id AND r.kind = 'version' AND r.parent_pos = d.parent_pos AND r.doc_pos = d.doc_pos WHERE d.kind = 'version' AND lower(json_extract_string(r.i, '$.IsDefaultVersion')) = 'true' AND d.doc IS NOT NULL GROUP BY 1, 2),
    adocs AS (
        SELECT i.dump_id, subject, o * 4096 + CASE WHEN kind = 'inline' THEN doc_pos - 1 ELSE 0 END AS o, doc, kind = 'trust' AS trusting FROM docs_ d JOIN ids i ON i.dump_id = d.dump_id AND i.entity_list = d.parent_list AND i.entity_pos = d.parent_pos WHERE kind IN ('inline', 'trust')
        UNION ALL SELECT i.dump_id, subject, o * 4096 + 2048 + item_pos - 1, m.doc, false FROM rows_ r JOIN ids i USING (dump_id, entity_list, entity_pos) JOIN managed m ON m.dump_id = r.dump_id AND m.arn = json_extract_string(r.i, '$.PolicyArn') WHERE field_name = 'AttachedManagedPolicies'
    ),
    split AS (SELECT dump_id, subject, o, trusting, CASE WHEN doc IS NULL OR json_extract(doc, '$.Statement') IS NULL THEN [] WHEN json_type(json_extract(doc, '$.Statement')) = 'ARRAY' THEN json_extract(doc, '$.Statement')::JSON[] ELSE [json_extract(doc, '$.Statement')] END AS a FROM adocs),
    stated AS (SELECT dump_id::VARCHAR AS graph_id, subject, o, list_filter(a, lambda x: (coalesce(json_type(json_extract(x, '$.Principal')), 'NULL') <> 'NULL') = trusting) AS a FROM split),
    {STATEMENT_SQL},
    member AS (SELECT dump_id::VARCHAR AS graph_id, o, subject AS src, 'iam:group:' || json_extract_string(r.i, '$') AS dst, 'AUTHENTICATE_AS' AS edge_type, 0.5::DOUBLE AS weight, 2 AS delegation_depth_limit, false AS is_conditional FROM rows_ r JOIN ids USING (dump_id, entity_list, entity_pos) WHERE field_name = 'GroupList' AND entity_list = 'UserDetailList'),
    ae AS (SELECT * FROM (SELECT * FROM raw_pe UNION ALL SELECT * FROM member) WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY weight DESC, o, edge_type DESC) = 1)"""


@query(rf"""WITH {ACCOUNT_SQL},
    texts AS (SELECT i.dump_id, i.entity_list, i.entity_pos, list(coalesce(json_extract_string(x.i, '$.PolicyName'), '')) AS names FROM ids i JOIN (SELECT dump_id, parent_list AS entity_list, parent_pos AS entity_pos, i FROM raws WHERE kind = 'inline' UNION ALL SELECT dump_id, entity_list, entity_pos, i FROM rows_ WHERE field_name = 'AttachedManagedPolicies') x USING (dump_id, entity_list, entity_pos) GROUP BY 1, 2, 3),
    own_n AS (SELECT i.dump_id::VARCHAR AS graph_id, o, subject AS node_id, CASE WHEN i.entity_list = 'UserDetailList' THEN 'USER' ELSE 'ROLE' END AS node_type, CASE WHEN len(list_filter(coalesce(names, []), lambda x: regexp_matches(lower(x), '(admin|poweruser|fullaccess|administrator|iam|root|sudo|owner)'))) > 0 THEN 0.9 WHEN len(coalesce(names, [])) > 0 THEN 0.5 ELSE 0.2 END::DOUBLE AS privilege_level, CASE WHEN arn = '' THEN {_ARN_SENSITIVITY.format('subject')} ELSE {_ARN_SENSITIVITY.format('arn')} END AS sensitivity FROM ids i LEFT JOIN texts USING (dump_id, entity_list, entity_pos)),
    group_n AS (SELECT graph_id, o + (1::BIGINT << 50), dst, 'ROLE', 0.4::DOUBLE, {_ARN_SENSITIVITY.format('dst')} FROM member WHERE dst IS NOT NULL),
    end_n AS (SELECT graph_id, 1::BIGINT << 60, other_id, CASE WHEN other_id = 'aws:resource:wildcard' THEN 'SECRET' ELSE {_ARN_TYPE.format('other')} END, CASE WHEN other_id = 'aws:resource:wildcard' THEN 1.0 WHEN {_ARN_TYPE.format('other')} = 'ROLE' THEN 0.5 ELSE 0.3 END::DOUBLE, CASE WHEN other_id = 'aws:resource:wildcard' THEN 1.0 ELSE {_ARN_SENSITIVITY.format('other')} END FROM named)
    SELECT graph_id, node_id, node_type, privilege_level, sensitivity FROM (SELECT * FROM own_n UNION ALL SELECT * FROM group_n UNION ALL SELECT * FROM end_n) QUALIFY row_number() OVER (PARTITION BY graph_id, node_id ORDER BY o) = 1""")
def account_nodes(spark, d):
    return iam_source.load_account_dumps(_dumps(spark, d))[0].select("graph_id", "node_id", "node_type", "privilege_level", "sensitivity")


@query(f"WITH {ACCOUNT_SQL} SELECT graph_id, src, dst, edge_type, weight, delegation_depth_limit, is_conditional FROM ae")
def account_edges(spark, d):
    return iam_source.load_account_dumps(_dumps(spark, d))[1].select("graph_id", "src", "dst", "edge_type", "weight", "delegation_depth_limit", "is_conditional")


@query()
def synthetic_graphs(spark, d):
    parts = [simulate.generate(spark, k, 40, range(5)) for k in simulate.TOPOLOGIES]
    n = reduce(DataFrame.unionByName, [p[0] for p in parts]).groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.max("privilege_level").alias("max_privilege"))
    return n.join(reduce(DataFrame.unionByName, [p[1] for p in parts]).groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id").withColumn("max_privilege", F.round("max_privilege", 6))


@query()
def synthetic_sweep(spark, d):
    """Twenty graphs of each archetype in one pass: risk by three models against plain reachability, micro-averaged by topology."""
    from quellgraph.operators import propagation as pr

    parts = [simulate.generate(spark, k, 30, range(20)) for k in simulate.TOPOLOGIES]
    n, e = (cut(reduce(DataFrame.unionByName, [p[i] for p in parts])) for i in (0, 1))
    s = cut(ev.pick_seeds(n))
    truth = t.bfs(e, s).select("graph_id", "node_id", F.lit(True).alias("actual"))
    r = pr.graph_traversal(n, e, s).unionByName(pr.epidemic(n, e, s, direction="forward")).unionByName(pr.percolation(n, e, s, n_trials=5))
    j = r.join(truth, ["graph_id", "node_id"], "left").select("model", F.regexp_replace("graph_id", "-[0-9]+$", "").alias("topology"), F.col("compromised").alias("predicted"), F.coalesce("actual", F.lit(False)).alias("actual"))
    return _r6(ve.prf(j, ["model", "topology"], "calibration"), "precision", "recall", "f1")


_MANIFEST = """apiVersion: rbac.authorization.k8s.io/v1
kind: ClusterRole
metadata: {{name: nation-{0}}}
rules:
- resources: [secrets]
  verbs: [get]
---
kind: ServiceAccount
metadata: {{name: supplier-{1}, namespace: region-{2}}}
---
kind: RoleBinding
metadata: {{name: b, namespace: region-{2}}}
roleRef: {{kind: ClusterRole, name: nation-{0}}}
subjects:
- {{kind: ServiceAccount, name: supplier-{1}, namespace: region-{2}}}
- {{kind: User, name: nation-{0}-owner}}
- {{kind: Group, name: "system:masters"}}
"""


def _manifests(spark, d) -> DataFrame:
    """A cluster manifest per supplier: a role per nation, an account in its region, and who is bound to the role."""
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    parts = _MANIFEST.replace("{{", "{").replace("}}", "}")
    text = F.lit(parts)
    for i, c in enumerate(("n_nationkey", "s_suppkey", "n_regionkey")):
        text = F.replace(text, F.lit(f"{{{i}}}"), F.col(c).cast("string"))
    return j.select(F.concat(F.lit("cluster-"), F.col("s_suppkey").cast("string")).alias("graph_id"), text.alias("content"))


_CLUSTERS = "c AS (SELECT 'cluster-' || s_suppkey AS graph_id, s_suppkey AS s, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {_CLUSTERS} SELECT graph_id, 'clusterrole:nation-' || n AS node_id, 'ROLE' AS node_type FROM c UNION ALL SELECT graph_id, 'sa:region-' || r || ':supplier-' || s, 'USER' FROM c UNION ALL SELECT graph_id, 'k8s:user:nation-' || n || '-owner', 'USER' FROM c
    UNION ALL SELECT graph_id, 'k8s:group:system:masters', 'WORKLOAD' FROM c UNION ALL SELECT graph_id, 'k8s:secret:*', 'SECRET' FROM c""")
def cluster_nodes(spark, d):
    return k8s.load(_manifests(spark, d))[0].select("graph_id", "node_id", "node_type")


@query(f"""WITH {_CLUSTERS}, s AS (SELECT graph_id, n, unnest(['sa:region-' || r || ':supplier-' || s, 'k8s:user:nation-' || n || '-owner', 'k8s:group:system:masters']) AS src FROM c)
    SELECT graph_id, src, 'clusterrole:nation-' || n AS dst, 'ASSUME_ROLE' AS edge_type, 3 AS delegation_depth_limit FROM s UNION ALL SELECT graph_id, 'clusterrole:nation-' || n, 'k8s:secret:*', 'SECRET_READ', 2 FROM c""")
def cluster_edges(spark, d):
    return k8s.load(_manifests(spark, d))[1].select("graph_id", "src", "dst", "edge_type", "delegation_depth_limit")
