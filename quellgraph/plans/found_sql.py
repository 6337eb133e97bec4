"""SQL for the queries of :mod:`quellgraph.plans.found`, stated from the problems and not from the operators."""

from quellgraph.plans.views import sql_trim

LISTS = r"""
    raw AS (SELECT id, 'predicted_nodes' AS f, predicted_nodes AS r FROM model_history UNION ALL SELECT id, 'actual_nodes', actual_nodes FROM model_history),
    body AS (SELECT *, regexp_replace(regexp_replace(r, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[\[\(\{](.*)[\]\)\}]$', '\1', 's') AS b, regexp_matches(r, '^[\s\p{Z}]*[\[\(\{][\s\p{Z}]*''') AS single FROM raw WHERE r IS NOT NULL),
    toks AS (SELECT id, f, single, CASE WHEN single THEN regexp_extract_all(b, '''(?:[^''\\]|\\.|'''')*''|[^,;|；，、\s\p{Z}]+') ELSE regexp_extract_all(b, '"(?:[^"\\]|\\.|"")*"|[^,;|；，、\s\p{Z}]+') END AS a FROM body),
    items AS (SELECT id, f, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS t, single FROM toks),
    clean AS (SELECT id, f, pos, CASE WHEN length(t) > 1 AND t[1] = (CASE WHEN single THEN '''' ELSE '"' END) AND t[-1] = t[1] THEN replace(regexp_replace(t[2:-2], '\\(.)', '\1', 'g'), t[1] || t[1], t[1]) ELSE t END AS v FROM items)"""
P1 = f"WITH {LISTS} SELECT id, f AS field_name, (row_number() OVER (PARTITION BY id, f ORDER BY pos))::INT AS pos, {sql_trim('v')} AS node_id FROM clean WHERE {sql_trim('v')} <> ''"

DUMPS = f"""
    dumps AS (SELECT DISTINCT dump_id, account_id, captured_at, dump FROM account_dump),
    roots AS (SELECT dump_id, account_id, captured_at, coalesce(json_extract(dump, '$.AuthorizationDetails'), dump::JSON) AS j FROM dumps),
    lists AS (SELECT dump_id, account_id, captured_at, l AS entity_list, json_extract(j, '$.' || l) AS x FROM roots CROSS JOIN (VALUES ('UserDetailList'), ('GroupDetailList'), ('RoleDetailList')) t(l)),
    ents AS (SELECT dump_id, account_id, captured_at, entity_list, unnest(range(1, len(a) + 1)) AS entity_pos, unnest(a) AS e FROM (SELECT *, CASE json_type(x) WHEN 'ARRAY' THEN x::JSON[] WHEN 'OBJECT' THEN [x] ELSE [] END AS a FROM lists)),
    fields AS (SELECT dump_id, account_id, captured_at, entity_list, entity_pos, f AS field_name, json_extract(e, '$.' || f) AS x FROM ents CROSS JOIN (VALUES ('GroupList'), ('AttachedManagedPolicies'), ('UserPolicyList')) t(f) WHERE entity_list = 'UserDetailList' OR f = 'AttachedManagedPolicies'),
    rows_ AS (SELECT dump_id, account_id, captured_at, entity_list, entity_pos, field_name, unnest(range(1, len(a) + 1)) AS item_pos, unnest(a) AS i FROM (SELECT *, CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN [] WHEN json_type(x) = 'ARRAY' THEN x::JSON[] ELSE [x] END AS a FROM fields)),
    docs AS (SELECT *, CASE WHEN json_type(json_extract(i, '$.PolicyDocument')) = 'VARCHAR' THEN (CASE WHEN starts_with(json_extract_string(i, '$.PolicyDocument'), '%') THEN url_decode(json_extract_string(i, '$.PolicyDocument')) ELSE json_extract_string(i, '$.PolicyDocument') END)::JSON ELSE json_extract(i, '$.PolicyDocument') END AS doc FROM rows_),
    flat AS (SELECT dump_id, account_id, captured_at, entity_list, entity_pos, field_name, item_pos, CASE field_name WHEN 'GroupList' THEN coalesce(json_extract_string(i, '$'), '') WHEN 'AttachedManagedPolicies' THEN coalesce({sql_trim("json_extract_string(i, '$.PolicyArn')")}, '') ELSE coalesce(json_extract_string(doc, '$.Version'), '') END AS item FROM docs)"""
P3 = f"WITH {DUMPS} SELECT DISTINCT dump_id, entity_list, entity_pos::INT AS entity_pos, field_name, item_pos::INT AS item_pos, item FROM flat"
P3_ENTITIES = f"WITH {DUMPS} SELECT dump_id, account_id, captured_at, entity_list, entity_pos::INT AS entity_pos, coalesce(json_extract_string(e, '$.UserName'), json_extract_string(e, '$.GroupName'), json_extract_string(e, '$.RoleName')) AS name, json_extract_string(e, '$.Arn') AS arn FROM ents"

P2 = f"""WITH {DUMPS},
    spans AS (SELECT DISTINCT {sql_trim('org_id')} AS org, {sql_trim('node_id')} AS k, added_at AS a, coalesce(removed_at, TIMESTAMP '9999-01-01') AS b FROM org_graph WHERE added_at IS NOT NULL),
    erefs AS (SELECT DISTINCT edge_id, {sql_trim('org_id')} AS org, seen_at, 'source' AS f, {sql_trim('source')} AS k FROM org_edges WHERE source IS NOT NULL UNION SELECT DISTINCT edge_id, {sql_trim('org_id')}, seen_at, 'target', {sql_trim('target')} FROM org_edges WHERE target IS NOT NULL),
    ejoin AS (SELECT r.edge_id, r.f, r.k, r.seen_at, coalesce(bool_or(a <= seen_at AND seen_at < b), false) AS sound, coalesce(bool_or(a <= seen_at), false) AS before, count(a) > 0 AS known FROM erefs r LEFT JOIN spans s ON s.org = r.org AND s.k = r.k GROUP BY r.edge_id, r.org, r.f, r.k, r.seen_at),
    own AS (SELECT dump_id, account_id, captured_at, {sql_trim("json_extract_string(unnest(CASE WHEN json_type(json_extract(j, '$.Policies')) = 'ARRAY' THEN json_extract(j, '$.Policies')::JSON[] ELSE [] END), '$.Arn')")} AS k FROM roots),
    prefs AS (SELECT DISTINCT dump_id, account_id, captured_at, item AS k FROM flat WHERE field_name = 'AttachedManagedPolicies' AND item <> ''),
    pjoin AS (SELECT p.dump_id, p.k, p.captured_at, coalesce(bool_or(o.dump_id = p.dump_id), false) AS same, coalesce(bool_or(o.captured_at < p.captured_at), false) AS before, count(o.k) > 0 AS known FROM prefs p LEFT JOIN own o ON o.account_id = p.account_id AND o.k = p.k GROUP BY p.dump_id, p.k, p.captured_at),
    pcat AS (SELECT p.*, coalesce(bool_or(c.created_at <= captured_at AND (c.retired_at IS NULL OR c.retired_at > captured_at)), false) AS live, coalesce(bool_or(c.created_at <= captured_at), false) AS made, count(c.policy_arn) > 0 AS listed FROM pjoin p LEFT JOIN policy_catalog c ON {sql_trim('c.policy_arn')} = p.k GROUP BY ALL),
    orphans AS (
        SELECT 'org_edges' AS ref_table, edge_id AS ref_id, f AS ref_field, k AS ref_key, CASE WHEN before THEN 'deleted' WHEN known THEN 'late' ELSE 'missing' END AS reason, strftime(seen_at, '%Y-%m') AS ref_month FROM ejoin WHERE NOT sound
        UNION SELECT 'account_dump', dump_id, 'PolicyArn', k, CASE WHEN before OR made THEN 'deleted' WHEN known OR listed THEN 'late' ELSE 'missing' END, strftime(captured_at, '%Y-%m') FROM pcat WHERE NOT same AND NOT live
    )"""
P2_FOUND = f"{P2} SELECT * FROM orphans"
P2_REPORT = f"{P2} SELECT ref_table, ref_month, ref_field, reason, count(*) AS orphans, count(DISTINCT ref_key) AS keys FROM orphans GROUP BY 1, 2, 3, 4"

RESOURCES = r"""
    lam AS (SELECT DISTINCT file_id, content::JSON AS j FROM policy_files WHERE family = 'lambda_execution_role'),
    walk AS (SELECT file_id, '' AS path, j FROM lam UNION ALL
        (SELECT file_id, path || CASE WHEN k.key IS NULL THEN '' ELSE '.' || k.key END, k.value FROM walk, LATERAL (
            SELECT unnest(json_keys(j)) AS key, unnest(list_transform(json_keys(j), lambda x: json_extract(j, '$."' || x || '"'))) AS value WHERE json_type(j) = 'OBJECT' UNION ALL SELECT NULL, unnest(j::JSON[]) WHERE json_type(j) = 'ARRAY') k)),
    res AS (SELECT json_extract_string(j, '$') AS v FROM walk WHERE json_type(j) = 'VARCHAR' AND regexp_matches(lower(path), 'statement\.resource[^.]*$') AND NOT starts_with(lower(path), '.trust'))"""
P4 = f"""WITH RECURSIVE {RESOURCES}, t AS (SELECT topology_type AS v FROM model_history WHERE topology_type IS NOT NULL)
    SELECT 'topology_type' AS field_name, v AS key_value FROM t GROUP BY v HAVING count(*) >= 0.05 * (SELECT count(*) FROM t) UNION ALL SELECT 'Resource', v FROM res GROUP BY v HAVING count(*) >= 0.05 * (SELECT count(*) FROM res)"""
P4_STATES = f"""WITH RECURSIVE {RESOURCES}, t AS (SELECT * FROM model_history WHERE topology_type IS NOT NULL)
    SELECT 'topology_type' AS field_name, topology_type AS key_value, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 9) AS share, round(avg(precision_score), 6) AS avg_precision_score, round(avg(recall_score), 6) AS avg_recall_score, round(avg(f1_score), 6) AS avg_f1_score FROM t GROUP BY topology_type
    UNION ALL SELECT 'Resource', v, count(*), round(count(*) / (SELECT count(*) FROM res)::DOUBLE, 9), NULL, NULL, NULL FROM res GROUP BY v"""

# Statements in their four notations, as sorted lists of name and values reduced to letters and digits.
P6_TEXTS = rf"""
    texts AS (SELECT record_id, family, {sql_trim('raw_text')} AS t FROM role_statements WHERE raw_text IS NOT NULL),
    kinds AS (SELECT *, CASE WHEN starts_with(t, '{{') THEN 'json' WHEN regexp_matches(t, '^[^\n=\[]+=\[') THEN 'bar' WHEN regexp_matches(t, '^[^\n:=]+ =') THEN 'line' ELSE 'tree' END AS kind FROM texts),
    js AS (SELECT record_id, family, (CASE WHEN json_valid(o) THEN o ELSE replace(o, '''', '"') END)::JSON AS j FROM (SELECT record_id, family, regexp_extract(t, '(?s)^\{{.*\}}') AS o FROM kinds WHERE kind = 'json')),
    js_fields AS (SELECT record_id, family, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT record_id, family, j, unnest(json_keys(j)) AS k FROM js)),
    fields AS (
        SELECT record_id, family, k AS name, CASE json_type(v) WHEN 'ARRAY' THEN list_transform(v::JSON[], lambda x: json_extract_string(x, '$')) ELSE [json_extract_string(v, '$')] END AS vals FROM js_fields
        UNION ALL SELECT record_id, family, split_part(s, '=[', 1), list_filter(string_split(regexp_extract(s, '(?s)=\[(.*)\]\s*$', 1), ','), lambda x: trim(x) <> '') FROM (SELECT record_id, family, unnest(regexp_split_to_array(t, '\s\|\s')) AS s FROM kinds WHERE kind = 'bar')
        UNION ALL SELECT record_id, family, split_part(s, '=', 1), string_split(substr(s, strpos(s, '=') + 1), ',') FROM (SELECT record_id, family, unnest(regexp_split_to_array(t, '\r?\n')) AS s FROM kinds WHERE kind = 'line') WHERE contains(s, '=')
        UNION ALL SELECT record_id, family, split_part(s, ':', 1), CASE WHEN regexp_matches(s, '\n[ \t]*-') THEN regexp_split_to_array(s, '\n[ \t]*-')[2:] ELSE [substr(s, strpos(s, ':') + 1)] END
            FROM (SELECT record_id, family, unnest(regexp_extract_all(t, '(?m)^[^\s:\-][^:\n]*:[ \t]*[^\n]*(?:\n[ \t]*-[^\n]*)*')) AS s FROM kinds WHERE kind = 'tree')
    ),
    plain AS (SELECT record_id, family, array_to_string(list_transform(list_prepend(name, vals), lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g'))), chr(31)) AS pair FROM fields),
    whole AS (SELECT record_id, family, list_sort(list(pair)) AS content FROM plain GROUP BY 1, 2),
    firsts AS (SELECT record_id, family, min(record_id) OVER (PARTITION BY family, content) AS first_id FROM whole)"""
P6 = f"WITH {P6_TEXTS} SELECT first_id, record_id AS copy_id FROM firsts WHERE record_id <> first_id"
P6_DISTINCT = f"WITH {P6_TEXTS} SELECT family, first_id, count(*) AS copies FROM firsts GROUP BY 1, 2"

# Paths of every file by a recursive walk; then the definition of a change, step by step.
P5 = """WITH RECURSIVE
    files AS (SELECT file_id, feed_id, content::JSON AS j, row_number() OVER (PARTITION BY feed_id ORDER BY exported_at, file_id) AS i, count(*) OVER (PARTITION BY feed_id) AS n FROM (SELECT DISTINCT file_id, feed_id, exported_at, content FROM policy_files)),
    walk AS (SELECT file_id, '' AS path, j, false AS named FROM files UNION ALL
        (SELECT file_id, CASE WHEN k.key IS NULL THEN path WHEN path = '' THEN k.key ELSE path || '.' || k.key END, k.value, k.key IS NOT NULL FROM walk, LATERAL (
            SELECT unnest(json_keys(j)) AS key, unnest(list_transform(json_keys(j), lambda x: json_extract(j, '$."' || x || '"'))) AS value WHERE json_type(j) = 'OBJECT' UNION ALL SELECT NULL, unnest(j::JSON[]) WHERE json_type(j) = 'ARRAY') k)),
    places AS (SELECT file_id, path, CASE WHEN json_type(j) = 'VARCHAR' THEN 'string' WHEN json_type(j) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(j) = 'NULL' THEN NULL ELSE lower(json_type(j)) END AS t FROM walk WHERE named),
    seen AS (SELECT f.feed_id, f.i, f.n, p.path, count(DISTINCT t) AS kinds, min(t) AS t FROM places p JOIN files f USING (file_id) GROUP BY ALL),
    runs AS (SELECT feed_id, n, path, min(i) AS a, max(i) AS b FROM seen GROUP BY ALL HAVING count(*) >= 2 AND max(i) - min(i) + 1 = count(*)),
    moves AS (
        SELECT feed_id, path, 'added' AS kind, a AS i, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent FROM runs WHERE a >= 3
        UNION ALL SELECT feed_id, path, 'removed', b + 1, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END FROM runs WHERE n - b >= 2
    ),
    own AS (SELECT * FROM moves m WHERE NOT EXISTS (SELECT 1 FROM moves p WHERE p.feed_id = m.feed_id AND p.kind = m.kind AND p.i = m.i AND p.path = m.parent)),
    swaps AS (SELECT feed_id, i, parent, max(path) FILTER (kind = 'removed') AS old, max(path) FILTER (kind = 'added') AS new FROM own GROUP BY ALL HAVING count(*) FILTER (kind = 'removed') = 1 AND count(*) FILTER (kind = 'added') = 1),
    typed AS (SELECT *, t <> lag(t) OVER (PARTITION BY feed_id, path ORDER BY i) AS turn, row_number() OVER (PARTITION BY feed_id, path ORDER BY i) AS k, count(*) OVER (PARTITION BY feed_id, path) AS m, max(kinds) OVER (PARTITION BY feed_id, path) AS most FROM seen WHERE kinds > 0),
    turns AS (SELECT feed_id, path, min(i) FILTER (turn) AS i, min(k) FILTER (turn) AS k, any_value(m) AS m FROM typed WHERE most = 1 GROUP BY 1, 2 HAVING count(*) FILTER (turn) = 1),
    steps AS (
        SELECT feed_id, i, kind AS change_kind, path AS field_path, '' AS new_path FROM own o WHERE NOT EXISTS (SELECT 1 FROM swaps s WHERE s.feed_id = o.feed_id AND s.i = o.i AND s.parent = o.parent)
        UNION ALL SELECT feed_id, i, 'renamed', old, new FROM swaps UNION ALL SELECT feed_id, i, 'type', path, '' FROM turns WHERE k - 1 >= 2 AND m - k + 1 >= 2
    )
    SELECT DISTINCT file_id, change_kind, field_path, new_path FROM steps JOIN files USING (feed_id, i)"""

_JSON_DOC = """CASE WHEN json_type({0}) = 'VARCHAR' THEN (CASE WHEN starts_with(json_extract_string({0}, '$'), '%') THEN url_decode(json_extract_string({0}, '$')) ELSE json_extract_string({0}, '$') END)::JSON WHEN json_type({0}) = 'NULL' THEN NULL ELSE {0} END"""
_JSON_LIST = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN [] WHEN json_type({0}) = 'ARRAY' THEN {0}::JSON[] ELSE [{0}] END"
P3_DOCS = f"""{DUMPS},
    pols AS (SELECT dump_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS e FROM (SELECT dump_id, {_JSON_LIST.format("json_extract(j, '$.Policies')")} AS a FROM roots)),
    raws AS (
        SELECT dump_id, entity_list AS parent_list, entity_pos AS parent_pos, 'inline' AS kind, unnest(range(1, len(a) + 1)) AS doc_pos, unnest(a) AS i, 'PolicyName' AS nm, 'PolicyDocument' AS dc FROM (SELECT dump_id, entity_list, entity_pos, {_JSON_LIST.format("json_extract(e, CASE entity_list WHEN 'UserDetailList' THEN '$.UserPolicyList' WHEN 'GroupDetailList' THEN '$.GroupPolicyList' ELSE '$.RolePolicyList' END)")} AS a FROM ents)
        UNION ALL SELECT dump_id, 'Policies', pos, 'version', unnest(range(1, len(a) + 1)), unnest(a), 'VersionId', 'Document' FROM (SELECT dump_id, pos, {_JSON_LIST.format("json_extract(e, '$.PolicyVersionList')")} AS a FROM pols)
        UNION ALL SELECT dump_id, entity_list, entity_pos, 'trust', 1, e, 'RoleName', 'AssumeRolePolicyDocument' FROM ents WHERE entity_list = 'RoleDetailList' AND json_extract(e, '$.AssumeRolePolicyDocument') IS NOT NULL AND json_type(json_extract(e, '$.AssumeRolePolicyDocument')) <> 'NULL'
    ),
    docs_ AS (SELECT dump_id, parent_list, parent_pos, kind, doc_pos, json_extract_string(i, '$.' || nm) AS doc_name, {_JSON_DOC.format("json_extract(i, '$.' || dc)")} AS doc FROM raws)"""
P3_DOCUMENTS = f"WITH {P3_DOCS} SELECT DISTINCT dump_id, parent_list, parent_pos::INT AS parent_pos, kind, doc_pos::INT AS doc_pos, doc_name, json_extract_string(doc, '$.Version') AS version FROM docs_"
P3_STATEMENTS = f"""WITH {P3_DOCS}, st AS (SELECT dump_id, parent_list, parent_pos, kind, doc_pos, unnest(range(1, len(a) + 1)) AS statement_pos, unnest(a) AS s FROM (SELECT *, {_JSON_LIST.format("json_extract(doc, '$.Statement')")} AS a FROM docs_))
    SELECT dump_id, parent_list, parent_pos::INT AS parent_pos, kind, doc_pos::INT AS doc_pos, statement_pos::INT AS statement_pos, json_extract_string(s, '$.Sid') AS sid, json_extract_string(s, '$.Effect') AS effect,
        CASE WHEN json_extract(s, '$.Action') IS NOT NULL AND json_type(json_extract(s, '$.Action')) <> 'NULL' THEN array_to_string(list_transform({_JSON_LIST.format("json_extract(s, '$.Action')")}, lambda x: json_extract_string(x, '$')), chr(10)) END AS actions,
        CASE WHEN json_extract(s, '$.Resource') IS NOT NULL AND json_type(json_extract(s, '$.Resource')) <> 'NULL' THEN array_to_string(list_transform({_JSON_LIST.format("json_extract(s, '$.Resource')")}, lambda x: json_extract_string(x, '$')), chr(10)) END AS resources FROM st"""
