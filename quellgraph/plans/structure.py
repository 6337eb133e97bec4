"""Queries on the structure of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellgraph.operators import graph as g
from quellgraph.operators import traversal as t
from quellgraph.operators.dense import layout, spectral_gap
from quellgraph.operators.fingerprint import fingerprint
from quellgraph.plans.registry import query
from quellgraph.plans.views import ORG_SQL, STAR_SQL, org_edges, org_nodes, org_seeds, star_edges, star_nodes

BOTH_SQL = f"{ORG_SQL}, {STAR_SQL}, an AS (SELECT graph_id, node_id, node_type, privilege_level FROM nodes UNION ALL SELECT * FROM snodes), ae AS (SELECT graph_id, src, dst, edge_type, weight, lim FROM edges UNION ALL SELECT * FROM sedges)"


def all_nodes(spark, d):
    return org_nodes(spark, d).unionByName(star_nodes(spark, d))


def all_edges(spark, d):
    return org_edges(spark, d).unionByName(star_edges(spark, d))


@query(f"WITH {BOTH_SQL} SELECT graph_id, node_type, count(*) AS n FROM an GROUP BY 1, 2")
def node_type_summary(spark, d):
    return g.type_counts(all_nodes(spark, d), "node_type")


@query(f"WITH {BOTH_SQL} SELECT graph_id, edge_type, count(*) AS n FROM ae GROUP BY 1, 2")
def edge_type_summary(spark, d):
    return g.type_counts(all_edges(spark, d), "edge_type")


@query(f"""WITH {BOTH_SQL}, m AS (SELECT graph_id, count(*) AS n_edges FROM ae GROUP BY 1)
    SELECT n.graph_id, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, round(avg(privilege_level), 6) AS avg_privilege, max(privilege_level) AS max_privilege, sum((privilege_level >= 0.7)::INT)::BIGINT AS n_high
    FROM an n LEFT JOIN m USING (graph_id) GROUP BY 1""")
def graph_summary(spark, d):
    return g.summary(all_nodes(spark, d), all_edges(spark, d)).withColumn("avg_privilege", F.round("avg_privilege", 6))


@query(f"WITH {BOTH_SQL} SELECT graph_id, node_id, privilege_level FROM an WHERE privilege_level >= 0.9")
def high_privilege(spark, d):
    return g.high_privilege(all_nodes(spark, d), 0.9).select("graph_id", "node_id", "privilege_level")


@query(f"WITH {BOTH_SQL} SELECT graph_id, node_id, privilege_level FROM an WHERE node_type = 'ROLE'")
def nodes_by_type(spark, d):
    return g.nodes_of_type(all_nodes(spark, d), "ROLE").select("graph_id", "node_id", "privilege_level")


@query(f"""WITH {BOTH_SQL}, o AS (SELECT graph_id, src AS node_id, count(*) AS o FROM ae GROUP BY 1, 2), i AS (SELECT graph_id, dst AS node_id, count(*) AS i FROM ae GROUP BY 1, 2)
    SELECT graph_id, node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM an LEFT JOIN o USING (graph_id, node_id) LEFT JOIN i USING (graph_id, node_id)""")
def degree(spark, d):
    return g.degrees(all_nodes(spark, d), all_edges(spark, d))


@query(f"""WITH {BOTH_SQL}, e AS (SELECT graph_id, src AS v FROM ae UNION ALL SELECT graph_id, dst FROM ae), k AS (SELECT graph_id, v, count(*) AS deg FROM e GROUP BY 1, 2), p AS (SELECT graph_id, deg / sum(deg) OVER (PARTITION BY graph_id) AS p FROM k),
    h AS (SELECT graph_id, -sum(p * log2(p)) AS h FROM p GROUP BY 1) SELECT g.graph_id, round(coalesce(h, 0.0), 6) AS degree_entropy FROM (SELECT DISTINCT graph_id FROM an) g LEFT JOIN h USING (graph_id)""")
def degree_entropy(spark, d):
    return g.degree_entropy(all_nodes(spark, d), all_edges(spark, d)).withColumn("degree_entropy", F.round("degree_entropy", 6))


@query(f"""WITH {BOTH_SQL}, n AS (SELECT graph_id, count(*) AS n FROM an GROUP BY 1), m AS (SELECT graph_id, count(*) AS m FROM ae GROUP BY 1)
    SELECT graph_id, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1))::DOUBLE ELSE 0 END, 9) AS density FROM n LEFT JOIN m USING (graph_id)""")
def density(spark, d):
    return g.density(all_nodes(spark, d), all_edges(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {BOTH_SQL} SELECT graph_id, src AS node_id, dst AS neighbor FROM ae UNION SELECT graph_id, dst, src FROM ae")
def neighbors_both(spark, d):
    return g.neighbors(all_edges(spark, d), "both")


@query(f"""WITH {ORG_SQL}, pos AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS k FROM nodes)
    SELECT e.graph_id, a.k AS i, b.k AS j, weight FROM edges e JOIN pos a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN pos b ON b.graph_id = e.graph_id AND b.node_id = e.dst""")
def adjacency(spark, d):
    return g.adjacency(org_nodes(spark, d), org_edges(spark, d))


@query(f"""WITH {BOTH_SQL}, u AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM ae WHERE src <> dst), both_ AS (SELECT graph_id, a AS v, b AS w FROM u UNION ALL SELECT graph_id, b, a FROM u),
    deg AS (SELECT graph_id, v, count(*) AS k FROM both_ GROUP BY 1, 2), tri AS (SELECT x.graph_id, x.a, x.b, y.b AS c FROM u x JOIN u y ON x.graph_id = y.graph_id AND x.b = y.a JOIN u z ON z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b),
    t AS (SELECT graph_id, v, count(*) AS t FROM (SELECT graph_id, a AS v FROM tri UNION ALL SELECT graph_id, b FROM tri UNION ALL SELECT graph_id, c FROM tri) GROUP BY 1, 2)
    SELECT n.graph_id, n.node_id, round(CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM an n LEFT JOIN deg ON deg.graph_id = n.graph_id AND deg.v = n.node_id LEFT JOIN t ON t.graph_id = n.graph_id AND t.v = n.node_id""")
def clustering(spark, d):
    return g.clustering(all_nodes(spark, d), all_edges(spark, d)).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH RECURSIVE {ORG_SQL}, both_ AS (SELECT graph_id, src AS a, dst AS b FROM edges UNION SELECT graph_id, dst, src FROM edges),
    reach AS (SELECT graph_id, node_id AS s, node_id AS v FROM nodes UNION SELECT r.graph_id, r.s, b.b FROM reach r JOIN both_ b ON b.graph_id = r.graph_id AND b.a = r.v)
    SELECT graph_id, s AS node_id, min(v) AS component FROM reach GROUP BY 1, 2""")
def components(spark, d):
    return g.components(org_nodes(spark, d), org_edges(spark, d))


BFS_SQL = """reach AS (SELECT graph_id, node_id, 0 AS dist FROM {seeds} UNION SELECT r.graph_id, e.dst, r.dist + 1 FROM reach r JOIN {edges} e ON e.graph_id = r.graph_id AND e.src = r.node_id WHERE r.dist < {most} {more}), hit AS (SELECT graph_id, node_id, min(dist) AS dist FROM reach GROUP BY 1, 2)"""
RISK_SQL = "SELECT n.graph_id, n.node_id, dist, round(coalesce(1.0 / (dist + 1), 0.0)::DOUBLE, 6) AS risk, dist IS NOT NULL AS compromised FROM {nodes} n LEFT JOIN hit USING (graph_id, node_id)"


def _risk(r):
    return r.withColumn("risk", F.round("risk", 6))


@query(f"WITH RECURSIVE {ORG_SQL}, {BFS_SQL.format(seeds='seeds', edges='edges', most=60, more='')} {RISK_SQL.format(nodes='nodes')}")
def bfs_risk(spark, d):
    return _risk(t.reachability(org_nodes(spark, d), org_edges(spark, d), org_seeds(spark, d)))


def star_seed(spark):
    return spark.createDataFrame([("star", "user:1")], "graph_id string, node_id string")


@query(f"WITH RECURSIVE {STAR_SQL}, s AS (SELECT 'star' AS graph_id, 'user:1' AS node_id), {BFS_SQL.format(seeds='s', edges='sedges', most=3, more='')} {RISK_SQL.format(nodes='snodes')}")
def bfs_depth_limited(spark, d):
    return _risk(t.reachability(star_nodes(spark, d), star_edges(spark, d), star_seed(spark), max_depth=3))


@query(f"""WITH RECURSIVE {ORG_SQL}, {BFS_SQL.format(seeds='seeds', edges='edges', most=60, more="AND e.edge_type IN ('ASSUME_ROLE', 'TOKEN_MINT')")} {RISK_SQL.format(nodes='nodes')}""")
def bfs_edge_type(spark, d):
    return _risk(t.reachability(org_nodes(spark, d), org_edges(spark, d), org_seeds(spark, d), edge_types=["ASSUME_ROLE", "TOKEN_MINT"]))


@query(f"WITH RECURSIVE {ORG_SQL}, s AS (SELECT graph_id, node_id FROM nodes WHERE node_type = 'USER' AND privilege_level <= 0.2), {BFS_SQL.format(seeds='s', edges='edges', most=60, more='')} SELECT graph_id, node_id, dist FROM hit")
def multi_seed_distance(spark, d):
    seeds = org_nodes(spark, d).where("node_type = 'USER' and privilege_level <= 0.2")
    return t.bfs(org_edges(spark, d), seeds)


@query(f"""WITH RECURSIVE {ORG_SQL}, both_ AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges),
    cr AS (SELECT graph_id, node_id AS s, node_id AS v FROM nodes UNION SELECT r.graph_id, r.s, b.dst FROM cr r JOIN both_ b ON b.graph_id = r.graph_id AND b.src = r.v), comp AS (SELECT graph_id, s AS node_id, min(v) AS c FROM cr GROUP BY 1, 2),
    big AS (SELECT graph_id, arg_max(c, (k, c)) AS c, max(k) AS k FROM (SELECT graph_id, c, count(*) AS k FROM comp GROUP BY 1, 2) GROUP BY 1), ins AS (SELECT comp.graph_id, node_id, k FROM comp JOIN big USING (graph_id, c)),
    dr AS (SELECT graph_id, node_id AS s, node_id AS v, 0 AS dist FROM ins UNION SELECT r.graph_id, r.s, e.dst, dist + 1 FROM dr r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.v WHERE dist < 40),
    ur AS (SELECT graph_id, node_id AS s, node_id AS v, 0 AS dist FROM ins UNION SELECT r.graph_id, r.s, e.dst, dist + 1 FROM ur r JOIN both_ e ON e.graph_id = r.graph_id AND e.src = r.v WHERE dist < 40),
    d1 AS (SELECT graph_id, count(*) AS p, sum(x) AS x FROM (SELECT graph_id, s, v, min(dist) AS x FROM dr WHERE s <> v GROUP BY 1, 2, 3) GROUP BY 1), d2 AS (SELECT graph_id, sum(x) AS x FROM (SELECT graph_id, s, v, min(dist) AS x FROM ur WHERE s <> v GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT b.graph_id, round(CASE WHEN k < 2 THEN 0.0 WHEN d1.p = k * (k - 1) THEN d1.x / (k * (k - 1))::DOUBLE ELSE d2.x / (k * (k - 1))::DOUBLE END, 6) AS avg_path_length FROM big b LEFT JOIN d1 USING (graph_id) LEFT JOIN d2 USING (graph_id)""")
def avg_path_length(spark, d):
    n, e = org_nodes(spark, d), org_edges(spark, d)
    return t.average_path(n, e).withColumn("avg_path_length", F.round("avg_path_length", 6))


@query()
def betweenness(spark, d):
    return t.betweenness(org_nodes(spark, d), org_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query(f"""WITH RECURSIVE {ORG_SQL}, walk AS (SELECT graph_id, [node_id] AS path FROM seeds UNION ALL SELECT w.graph_id, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.path[len(w.path)] WHERE len(w.path) <= 4 AND NOT list_contains(w.path, e.dst))
    SELECT w.graph_id, array_to_string(path, ' > ') AS path FROM walk w JOIN nodes n ON n.graph_id = w.graph_id AND n.node_id = path[len(path)] WHERE len(path) > 1 AND privilege_level >= 0.8""")
def simple_paths(spark, d):
    p = t.simple_paths(org_nodes(spark, d), org_edges(spark, d), org_seeds(spark, d), 0.8, 4)
    return p.select("graph_id", F.concat_ws(" > ", "path").alias("path"))


@query()
def simple_paths_full(spark, d):
    """:func:`simple_paths` up to the operator's 10 hops; its SQL follows 4."""
    p = t.simple_paths(org_nodes(spark, d), org_edges(spark, d), org_seeds(spark, d))
    return p.select("graph_id", F.concat_ws(" > ", "path").alias("path"))


@query()
def spectral_gaps(spark, d):
    return spectral_gap(org_nodes(spark, d), org_edges(spark, d)).withColumn("spectral_gap", F.round("spectral_gap", 6))


@query()
def fingerprints(spark, d):
    f = fingerprint(org_nodes(spark, d), org_edges(spark, d))
    return f.select("graph_id", "n_nodes", *[F.round(c, 6).alias(c) for c in ("degree_entropy", "density", "clustering", "centrality_variance", "avg_path_length", "spectral_gap")], "topology_type")


@query()
def layout_positions(spark, d):
    return layout(org_nodes(spark, d), org_edges(spark, d))


@query(f"""WITH {STAR_SQL} SELECT l_suppkey, l_partkey, arg_max(l_orderkey, (l_quantity, -l_orderkey, -l_linenumber)) AS l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2""")
def upsert_keep_max(spark, d):
    from quellgraph.runtime import table

    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("l_orderkey"), F.max("l_quantity").alias("l_quantity"))
    return rows


@query("""SELECT graph_id, node_id, name FROM (SELECT org_id AS graph_id, regexp_replace(node_id, '^[\\s\\p{Z}\\x1c-\\x1f]+|[\\s\\p{Z}\\x1c-\\x1f]+$', '', 'g') AS node_id, name, row_number() OVER (PARTITION BY org_id, regexp_replace(node_id, '^[\\s\\p{Z}\\x1c-\\x1f]+|[\\s\\p{Z}\\x1c-\\x1f]+$', '', 'g') ORDER BY added_at, name NULLS FIRST) AS r FROM org_graph WHERE node_id IS NOT NULL) WHERE r = 1""")
def first_wins(spark, d):
    from quellgraph.runtime import table, trimmed

    n = table(spark, d, "org_graph").where("node_id is not null").select(F.col("org_id").alias("graph_id"), trimmed(F.col("node_id")).alias("node_id"), "name", F.struct("added_at", "name").alias("ord"))
    return g.keep_first(n, ["graph_id", "node_id"]).select("graph_id", "node_id", "name")


@query(f"""WITH {ORG_SQL} SELECT graph_id, node_id, node_type FROM nodes WHERE node_type <> 'USER' UNION ALL SELECT org_id, node_id, 'NEW' FROM (SELECT DISTINCT org_id, regexp_replace(node_id, '^[\\s\\p{{Z}}\\x1c-\\x1f]+|[\\s\\p{{Z}}\\x1c-\\x1f]+$', '', 'g') AS node_id FROM org_graph WHERE node_id IS NOT NULL AND org_id IS NOT NULL) x WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = x.org_id AND n.node_id = x.node_id AND n.node_type <> 'USER')""")
def merge_if_absent(spark, d):
    n = org_nodes(spark, d)
    have, new = n.where("node_type != 'USER'").select("graph_id", "node_id", "node_type", "ord"), n.select("graph_id", "node_id", F.lit("NEW").alias("node_type"), "ord")
    return g.merge_absent(have, new, ["graph_id", "node_id"]).select("graph_id", "node_id", "node_type")
