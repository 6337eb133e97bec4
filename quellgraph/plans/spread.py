"""Queries on propagation, ensembles and verification, over the graphs of all organisations at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellgraph.operators import ensemble as en
from quellgraph.operators import pipeline
from quellgraph.operators import propagation as pr
from quellgraph.operators import traversal as t
from quellgraph.operators import verification as ve
from quellgraph.operators.analysis import analyse
from quellgraph.plans.registry import query
from quellgraph.plans.structure import BFS_SQL, RISK_SQL
from quellgraph.plans.views import ORG_SQL, org_edges, org_nodes, org_seeds
from quellgraph.runtime import cut, free, scratch, settled, table, written

STEPS, TRIALS = 6, 5


def _org(spark, d):
    """The graphs of the organisations."""
    return org_nodes(spark, d), org_edges(spark, d), org_seeds(spark, d)


def _rounded(r, *cols, places=6):
    return r.withColumns({c: F.round(c, places) for c in cols})


def epi_sql(steps: int, beta: float = 0.3) -> str:
    """The epidemic's fixed number of steps, unrolled."""
    out = ["x0 AS (SELECT n.graph_id, n.node_id, (s.node_id IS NOT NULL)::DOUBLE AS x, s.node_id IS NOT NULL AS seed FROM nodes n LEFT JOIN seeds s ON s.graph_id = n.graph_id AND s.node_id = n.node_id)"]
    for k in range(1, steps + 1):
        out.append(f"y{k} AS (SELECT e.graph_id, e.src AS node_id, sum({beta} * e.weight * x.x) AS y FROM edges e JOIN x{k - 1} x ON x.graph_id = e.graph_id AND x.node_id = e.dst GROUP BY 1, 2)")
        out.append(f"x{k} AS (SELECT x.graph_id, x.node_id, CASE WHEN x.seed THEN 1.0 ELSE least(1.0, coalesce(y, 0.0)) END AS x, x.seed FROM x{k - 1} x LEFT JOIN y{k} USING (graph_id, node_id))")
    return ", ".join(out)


@query(f"WITH {ORG_SQL}, {epi_sql(STEPS)} SELECT graph_id, 'epidemic' AS model, node_id, round(x, 6) AS risk, x >= 0.5 OR seed AS compromised FROM x{STEPS}")
def epidemic_steps(spark, d):
    return _rounded(pr.epidemic(*_org(spark, d), max_steps=STEPS, tolerance=0), "risk")


@query()
def epidemic_converged(spark, d):
    return _rounded(pr.epidemic(*_org(spark, d)), "risk")


@query()
def control_system(spark, d):
    return _rounded(pr.control_system(*_org(spark, d)), "risk")


@query()
def control_stability(spark, d):
    n, e, _ = _org(spark, d)
    return _rounded(pr.stability(n, e), "radius", "margin", "probability")


@query()
def spectral_cascade(spark, d):
    return _rounded(pr.spectral_cascade(*_org(spark, d)), "risk")


def power_sql(rounds: int) -> str:
    """Rounds of (A + I) x over its largest entry, unrolled; edges without weight don't count."""
    out = ["z0 AS (SELECT graph_id, node_id, 1.0::DOUBLE AS x, 0.0::DOUBLE AS radius FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(f"u{k} AS (SELECT z.graph_id, z.node_id, z.x + coalesce(y.y, 0.0) AS x FROM z{k - 1} z LEFT JOIN (SELECT e.graph_id, e.src AS node_id, sum(e.weight * z.x) AS y FROM edges e JOIN z{k - 1} z ON z.graph_id = e.graph_id AND z.node_id = e.dst WHERE e.weight > 0 GROUP BY 1, 2) y USING (graph_id, node_id))")
        out.append(f"z{k} AS (SELECT graph_id, node_id, x / max(x) OVER (PARTITION BY graph_id) AS x, max(x) OVER (PARTITION BY graph_id) - 1 AS radius FROM u{k})")
    return ", ".join(out)


def control_sql(steps: int, scale: float) -> str:
    """Steps of x <- clip(scale A x) from the seeds, which aren't held, unrolled."""
    out = ["c0 AS (SELECT n.graph_id, n.node_id, (s.node_id IS NOT NULL)::DOUBLE AS x, s.node_id IS NOT NULL AS seed FROM nodes n LEFT JOIN seeds s ON s.graph_id = n.graph_id AND s.node_id = n.node_id)"]
    for k in range(1, steps + 1):
        out.append(f"c{k} AS (SELECT c.graph_id, c.node_id, least(1.0, greatest(0.0, coalesce(y.y, 0.0))) AS x, c.seed FROM c{k - 1} c LEFT JOIN (SELECT e.graph_id, e.src AS node_id, sum({scale} * e.weight * c.x) AS y FROM edges e JOIN c{k - 1} c ON c.graph_id = e.graph_id AND c.node_id = e.dst GROUP BY 1, 2) y USING (graph_id, node_id))")
    return ", ".join(out)


@query(f"WITH {ORG_SQL}, {control_sql(5, 0.7)} SELECT graph_id, node_id, round(x, 6) AS risk FROM c5")
def control_steps(spark, d):
    """Five steps of the control system at a given scale, where the control system itself takes the radius."""
    return _rounded(pr._mat_vec(*_org(spark, d), 0.7, 5, 0, False, "reverse"), "risk")


@query(f"WITH {ORG_SQL}, {power_sql(12)} SELECT graph_id, node_id, round(radius, 5) AS radius, round(x, 5) AS vector FROM z12")
def power_iteration(spark, d):
    n, e, _ = _org(spark, d)
    return _rounded(pr.spectral_radius(n, e, 12), "radius", "vector", places=5)


_UNIT = "(('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_KEPT = f"trials AS (SELECT unnest(range(0, {TRIALS})) AS trial), kept AS (SELECT graph_id, trial, src, dst FROM edges CROSS JOIN trials WHERE {_UNIT.format(chr(39) + '42' + chr(39) + ', ' + chr(39) + 'r' + chr(39) + ', graph_id, trial, src, dst')} < least(1.0, weight * 0.6))"


@query(f"""WITH RECURSIVE {ORG_SQL}, {_KEPT}, hit AS (SELECT graph_id, trial, node_id FROM seeds CROSS JOIN trials UNION SELECT h.graph_id, h.trial, k.dst FROM hit h JOIN kept k ON k.graph_id = h.graph_id AND k.trial = h.trial AND k.src = h.node_id)
    SELECT graph_id, node_id, count(*) AS times_reached FROM hit GROUP BY 1, 2""")
def percolation_reach(spark, d):
    trials = pr.percolation_trials(*_org(spark, d), n_trials=TRIALS)
    return trials.where("reached").groupBy("graph_id", "node_id").agg(F.count("*").alias("times_reached"))


def _perco(trials: int) -> str:
    """Both samples of every trial: components of the undirected graph, and what the seeds reach."""
    draw = lambda what: _UNIT.format(f"'42', '{what}', graph_id, trial, src, dst")
    return f"""{ORG_SQL}, trials AS (SELECT unnest(range(0, {trials})) AS trial), drawn AS (SELECT graph_id, trial, src, dst, {draw('c')} < least(1.0, weight * 0.6) AS c, {draw('r')} < least(1.0, weight * 0.6) AS r FROM edges CROSS JOIN trials),
    hit AS (SELECT graph_id, trial, node_id FROM seeds CROSS JOIN trials UNION SELECT h.graph_id, h.trial, k.dst FROM hit h JOIN drawn k ON k.r AND k.graph_id = h.graph_id AND k.trial = h.trial AND k.src = h.node_id),
    un AS (SELECT graph_id, trial, src AS a, dst AS b FROM drawn WHERE c UNION SELECT graph_id, trial, dst, src FROM drawn WHERE c),
    comp AS (SELECT n.graph_id, t.trial, n.node_id AS s, n.node_id AS v FROM nodes n CROSS JOIN trials t UNION SELECT c.graph_id, c.trial, c.s, u.b FROM comp c JOIN un u ON u.graph_id = c.graph_id AND u.trial = c.trial AND u.a = c.v),
    sized AS (SELECT graph_id, trial, s AS node_id, min(v) AS component, count(*) AS size FROM comp GROUP BY 1, 2, 3), ns AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1),
    t AS (SELECT z.*, z.size > 0.3 * ns.n AS giant, h.node_id IS NOT NULL AS reached FROM sized z JOIN ns USING (graph_id) LEFT JOIN hit h USING (graph_id, trial, node_id))"""


@query(f"WITH RECURSIVE {_perco(100)} SELECT graph_id, node_id, count(*) AS times_reached FROM hit GROUP BY 1, 2")
def percolation_reach_full(spark, d):
    """:func:`percolation_reach` over all trials of the operator."""
    trials = pr.percolation_trials(*_org(spark, d))
    return trials.where("reached").groupBy("graph_id", "node_id").agg(F.count("*").alias("times_reached"))


@query(f"""WITH RECURSIVE {_perco(100)}, own AS (SELECT t.graph_id, trial, max(size) AS k FROM t JOIN seeds USING (graph_id, node_id) GROUP BY 1, 2), best AS (SELECT graph_id, arg_max(trial, (k, -trial)) AS trial FROM own GROUP BY 1),
    won AS (SELECT DISTINCT t.graph_id, t.node_id FROM t JOIN best USING (graph_id, trial) WHERE (t.graph_id, t.component) IN (SELECT (x.graph_id, x.component) FROM t x JOIN best b ON b.graph_id = x.graph_id AND b.trial = x.trial JOIN seeds s ON s.graph_id = x.graph_id AND s.node_id = x.node_id)),
    share AS (SELECT graph_id, node_id, avg(giant::INT) AS g, avg(reached::INT) AS r FROM t GROUP BY 1, 2),
    risk AS (SELECT x.graph_id, x.node_id, CASE WHEN s.node_id IS NOT NULL THEN 1.0 ELSE least(1.0, 0.4 * g + 0.6 * r) END AS risk, w.node_id IS NOT NULL OR s.node_id IS NOT NULL AS sure FROM share x LEFT JOIN seeds s USING (graph_id, node_id) LEFT JOIN won w USING (graph_id, node_id))
    SELECT graph_id, 'percolation' AS model, node_id, round(risk, 6) AS risk, round(risk, 9) >= 0.5 OR sure AS compromised FROM risk""")
def percolation_risk(spark, d):
    return _rounded(pr.percolation(*_org(spark, d)), "risk")


@query(f"""WITH RECURSIVE {_perco(100)}, per AS (SELECT graph_id, trial, max(giant::INT) AS giant, max(CASE WHEN giant THEN size ELSE 0 END) AS size FROM t GROUP BY 1, 2)
    SELECT graph_id, round(avg(giant), 6) AS giant_probability, round(avg(size), 6) AS mean_giant_size FROM per GROUP BY 1""")
def percolation_giants(spark, d):
    return _rounded(pr.percolation_header(written(pr.percolation_trials(*_org(spark, d)))), "giant_probability", "mean_giant_size")


@query(f"""WITH RECURSIVE {_perco(100)}, c AS (SELECT graph_id, size, count(*) AS n FROM (SELECT DISTINCT graph_id, trial, component, size FROM t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, size) AS k FROM c) SELECT graph_id, size, n FROM r WHERE k <= 20""")
def percolation_sizes(spark, d):
    return pr.component_sizes(pr.percolation_trials(*_org(spark, d)))


def _three(spark, d):
    """Results of the models that SQL can follow: reachability, its stand-in for the network, and the epidemic's fixed steps."""
    n, e, s = _org(spark, d)
    bfs = cut(pr.graph_traversal(n, e, s))
    return n, e, s, cut(bfs.unionByName(bfs.withColumn("model", F.lit("gnn"))).unionByName(pr.epidemic(n, e, s, max_steps=STEPS, tolerance=0)))


THREE = f"""{ORG_SQL}, {BFS_SQL.format(seeds='seeds', edges='edges', most=60, more='')}, {epi_sql(STEPS)},
    bfs AS (SELECT n.graph_id, n.node_id, coalesce(1.0 / (dist + 1), 0.0)::DOUBLE AS risk, dist IS NOT NULL AS compromised FROM nodes n LEFT JOIN hit USING (graph_id, node_id)),
    results AS (SELECT graph_id, 'graph_traversal' AS model, node_id, risk, compromised FROM bfs UNION ALL SELECT graph_id, 'gnn', node_id, risk, compromised FROM bfs UNION ALL SELECT graph_id, 'epidemic', node_id, x, x >= 0.5 OR seed FROM x{STEPS})"""
WEIGHTS = "w AS (SELECT * FROM (VALUES ('graph_traversal', 0.5), ('epidemic', 0.1), ('gnn', 0.2)) t(model, weight)), "
FUSED = f"{THREE}, {WEIGHTS} fused AS (SELECT graph_id, node_id, least(1.0, sum(risk * weight)) AS risk FROM results JOIN w USING (model) GROUP BY 1, 2), pred AS (SELECT *, round(risk, 9) >= 0.35 AS compromised FROM fused)"


def _mixed(spark):
    return en.priors(spark).where("topology_type = 'MIXED'")


@query(f"WITH RECURSIVE {FUSED} SELECT graph_id, node_id, round(risk, 6) AS risk, compromised FROM pred")
def ensemble_weighted(spark, d):
    return _rounded(en.weighted(_three(spark, d)[3], _mixed(spark)), "risk")


@query(f"WITH RECURSIVE {THREE} SELECT graph_id, node_id, round(sum(compromised::INT) / 6.0::DOUBLE, 6) AS risk, sum(compromised::INT) >= 0.6 * 6 AS compromised FROM results GROUP BY 1, 2")
def ensemble_voting(spark, d):
    return _rounded(en.voting(_three(spark, d)[3]), "risk")


@query(f"""WITH RECURSIVE {THREE}, m AS (SELECT graph_id, node_id, sum(risk) / 6 AS mean, sqrt(greatest(0.0, sum(risk * risk) / 6 - (sum(risk) / 6) * (sum(risk) / 6))) AS std FROM results GROUP BY 1, 2)
    SELECT graph_id, node_id, round(mean, 6) AS mean, round(std, 6) AS std, round(least(1.0, greatest(0.0, mean - 1.96 * std)), 4) AS lo, round(least(1.0, greatest(0.0, mean + 1.96 * std)), 4) AS hi, round(std, 9) > 0.25 AS uncertain FROM m""")
def ensemble_confidence(spark, d):
    return _rounded(en.confidence(_three(spark, d)[3]), "mean", "std")


@query(f"WITH RECURSIVE {THREE}, {WEIGHTS} z AS (SELECT 1) SELECT graph_id, model, node_id, round(risk, 6) AS risk, weight, round(risk * weight, 6) AS weighted FROM results JOIN w USING (model)")
def model_contributions(spark, d):
    return _rounded(en.contributions(_three(spark, d)[3], _mixed(spark)), "risk", "weighted")


@query(f"WITH RECURSIVE {THREE} SELECT graph_id, node_id, sum(compromised::INT)::BIGINT AS consensus, round(avg(risk), 6) AS avg_risk FROM results GROUP BY 1, 2")
def model_consensus(spark, d):
    return _rounded(en.consensus_counts(_three(spark, d)[3]), "avg_risk")


@query(f"""WITH RECURSIVE {THREE}, c AS (SELECT graph_id, node_id, sum(compromised::INT) AS c FROM results GROUP BY 1, 2)
    SELECT graph_id, sum((c > 0)::INT)::BIGINT AS n_union, sum((c = 3)::INT)::BIGINT AS n_intersection, round(CASE WHEN sum((c > 0)::INT) = 0 THEN 1.0 ELSE sum((c = 3)::INT) / sum((c > 0)::INT)::DOUBLE END, 6) AS jaccard FROM c GROUP BY 1""")
def jaccard_agreement(spark, d):
    return _rounded(en.agreement(_three(spark, d)[3]), "jaccard")


@query(f"""WITH RECURSIVE {THREE}, c AS (SELECT graph_id, node_id, sum(compromised::INT)::BIGINT AS consensus, avg(risk) AS avg_risk FROM results GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY consensus DESC, round(avg_risk, 9) DESC, node_id) AS rank FROM c)
    SELECT graph_id, node_id, consensus, round(avg_risk, 6) AS avg_risk, rank FROM r WHERE rank <= 5""")
def top_dangerous(spark, d):
    return _rounded(en.most_dangerous(_three(spark, d)[3]), "avg_risk")


def _six(spark, d):
    """Results of all six models with their defaults."""
    return pr.run_all(*_org(spark, d))


def _analysed(spark, d):
    """Graphs, results of all six models with their defaults, weights by topology and the fused prediction."""
    n, e, s = _org(spark, d)
    return n, e, s, *analyse(n, e, s, table(spark, d, "model_history"))


@query()
def ensemble_all_models(spark, d):
    return _rounded(_analysed(spark, d)[5], "risk")


@query()
def ensemble_analysis(spark, d):
    *_, w, p = _analysed(spark, d)
    of = w.select("graph_id", "topology_type", F.col("source").alias("weight_source")).distinct()
    return _rounded(p.join(of, "graph_id"), "risk").select("graph_id", "topology_type", "weight_source", "node_id", "risk", "compromised")


@query()
def ensemble_voting_full(spark, d):
    return _rounded(en.voting(_six(spark, d)), "risk")


@query()
def ensemble_confidence_full(spark, d):
    return _rounded(en.confidence(_six(spark, d)), "mean", "std")


@query()
def model_contributions_full(spark, d):
    *_, r, w, _ = _analysed(spark, d)
    return _rounded(en.contributions(r, w), "risk", "weighted")


@query()
def model_consensus_full(spark, d):
    return _rounded(en.consensus_counts(_six(spark, d)), "avg_risk")


@query()
def jaccard_agreement_full(spark, d):
    return _rounded(en.agreement(_six(spark, d)), "jaccard")


@query()
def top_dangerous_full(spark, d):
    return _rounded(en.most_dangerous(_six(spark, d)), "avg_risk")


@query(f"WITH RECURSIVE {THREE} SELECT graph_id, sum(compromised::INT)::BIGINT AS n_compromised, max(dist) AS depth FROM (SELECT b.*, h.dist FROM bfs b LEFT JOIN hit h USING (graph_id, node_id)) GROUP BY 1")
def traversal_header(spark, d):
    n, e, s = _org(spark, d)
    return t.reachability_header(n, t.reachability(n, e, s)).select("graph_id", "n_compromised", "depth")


GATED_SQL = "walk AS (SELECT graph_id, node_id, 0 AS level FROM seeds UNION SELECT w.graph_id, e.dst, level + 1 FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.node_id WHERE level < 6 AND level <= e.lim), seen AS (SELECT graph_id, node_id, min(level) AS level FROM walk GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {ORG_SQL}, {GATED_SQL} SELECT graph_id, node_id, level FROM seen")
def token_traversal(spark, d):
    return t.gated(*_org(spark, d))[0]


@query(f"""WITH RECURSIVE {ORG_SQL}, lev AS (SELECT 0 AS level, graph_id, node_id FROM seeds UNION SELECT l.level + 1, e.graph_id, e.dst FROM lev l JOIN edges e ON e.graph_id = l.graph_id AND e.src = l.node_id WHERE l.level < 6 AND l.level <= e.lim AND {_UNIT.format("'42', l.level, e.graph_id, e.src, e.dst")} < e.weight)
    SELECT graph_id, count(DISTINCT node_id) > 0 AS any_reached FROM lev GROUP BY 1""")
def token_traversal_random(spark, d):
    v, _ = t.gated(*_org(spark, d), conditions=True)
    return v.groupBy("graph_id").agg((F.countDistinct("node_id") > 0).alias("any_reached"))


def steps_sql(depth: int = 6) -> str:
    """Levels of a token traversal with conditions, unrolled."""
    out = ["f0 AS (SELECT graph_id, node_id FROM seeds), s0 AS (SELECT * FROM f0)"]
    for k in range(depth):
        lucky = _UNIT.format(f"'42', {k}, e.graph_id, e.src, e.dst")
        out.append(f"t{k} AS (SELECT e.graph_id, e.src, e.dst, {k} AS level, CASE WHEN e.lim < {k} THEN 'depth_exceeded' WHEN {lucky} < e.weight THEN 'succeeded' ELSE 'condition_failed' END AS outcome FROM edges e JOIN f{k} f ON f.graph_id = e.graph_id AND f.node_id = e.src WHERE NOT EXISTS (SELECT 1 FROM s{k} s WHERE s.graph_id = e.graph_id AND s.node_id = e.dst))")
        out.append(f"f{k + 1} AS (SELECT DISTINCT graph_id, dst AS node_id FROM t{k} WHERE outcome = 'succeeded'), s{k + 1} AS (SELECT * FROM s{k} UNION ALL SELECT * FROM f{k + 1})")
    return ", ".join(out) + ", all_steps AS (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(depth)) + ")"


@query(f"WITH {ORG_SQL}, {steps_sql()} SELECT graph_id, level, outcome, count(*) AS n FROM all_steps GROUP BY 1, 2, 3")
def token_steps(spark, d):
    return t.gated(*_org(spark, d), conditions=True)[1].groupBy("graph_id", "level", "outcome").agg(F.count("*").alias("n"))


FLAGS = f"""{FUSED}, {GATED_SQL}, f AS (SELECT n.graph_id, n.node_id, n.node_type, n.privilege_level, p.compromised AS in_pbr, s.node_id IS NOT NULL AS in_vbr, CASE WHEN s.node_id IS NOT NULL THEN 1.0 WHEN p.compromised THEN 0.3 * p.risk ELSE 0.0 END AS x
    FROM nodes n LEFT JOIN pred p USING (graph_id, node_id) LEFT JOIN seen s ON s.graph_id = n.graph_id AND s.node_id = n.node_id)"""
BLAST = f"""{FLAGS}, sizes AS (SELECT graph_id, sum(in_pbr::INT)::BIGINT AS pbr_size, sum(in_vbr::INT)::BIGINT AS vbr_size, sum((in_pbr AND NOT in_vbr)::INT)::BIGINT AS gap_size, sum((in_vbr AND NOT in_pbr)::INT)::BIGINT AS missed, sum((in_pbr AND in_vbr)::INT) AS b, sum((in_pbr OR in_vbr)::INT) AS u FROM f GROUP BY 1),
    blast AS (SELECT graph_id, pbr_size, vbr_size, gap_size, missed, round(CASE WHEN pbr_size > 0 THEN gap_size / pbr_size::DOUBLE ELSE 0 END, 6) AS gap_fraction, round(CASE WHEN u > 0 THEN 1 - b / u::DOUBLE ELSE 0 END, 6) AS exploitability_gap,
        CASE WHEN missed > 0 THEN 'CRITICAL_MISS' WHEN pbr_size = 0 OR gap_size / pbr_size::DOUBLE < 0.1 THEN 'CALIBRATED' WHEN gap_size / pbr_size::DOUBLE < 0.4 THEN 'OVER_PREDICTED' ELSE 'UNDER_PREDICTED' END AS classification FROM sizes)"""


def flags(spark, d):
    n, e, s, r = _three(spark, d)
    seen, steps = t.gated(n, e, s)
    return n, e, s, cut(ve.flags(n, en.weighted(r, _mixed(spark)), seen)), seen, steps


def flags_full(spark, d):
    """:func:`flags` from the analysis by all six models."""
    with scratch(spark) as keep:  # the results aren't needed beyond the prediction
        n, e, s, *_, p = _analysed(spark, d)
        p = keep(written(p))
    seen, steps = t.gated(n, e, s)
    free(spark)
    return n, e, s, settled(ve.flags(n, p, seen)), seen, steps


@query()
def blast_radius_full(spark, d):
    return ve.blast_radius(flags_full(spark, d)[3])


@query()
def node_gap_class_full(spark, d):
    return ve.node_class(flags_full(spark, d)[3])


@query(f"WITH RECURSIVE {BLAST} SELECT * FROM blast")
def blast_radius(spark, d):
    return ve.blast_radius(flags(spark, d)[3])


@query(f"""WITH RECURSIVE {FLAGS} SELECT graph_id, node_id, node_type AS type, round(privilege_level, 3) AS privilege, in_pbr, in_vbr, round(x, 4) AS exploitability_score, CASE WHEN in_vbr AND NOT in_pbr THEN 'CRITICAL_MISS' WHEN in_pbr AND in_vbr THEN 'VERIFIED' WHEN in_pbr THEN 'GAP' ELSE 'SAFE' END AS gap_classification FROM f""")
def node_gap_class(spark, d):
    return ve.node_class(flags(spark, d)[3])


@query(f"""WITH RECURSIVE {FLAGS}, s AS (SELECT graph_id, CASE WHEN in_vbr AND in_pbr THEN 'compromised' WHEN in_vbr THEN 'critical_miss' WHEN in_pbr THEN 'predicted_only' WHEN x > 0 THEN 'contained' ELSE 'safe' END AS state FROM f) SELECT graph_id, state, count(*) AS n FROM s GROUP BY 1, 2""")
def state_counts(spark, d):
    return ve.visual_state(flags(spark, d)[3]).groupBy("graph_id", "state").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {BLAST} SELECT round(avg(gap_fraction), 4) AS mean_gap, arg_min(graph_id, (gap_fraction, graph_id)) AS best_topology, max(gap_fraction) AS worst_gap, sum((classification = 'CRITICAL_MISS')::INT)::BIGINT AS critical_misses FROM blast""")
def gap_across_graphs(spark, d):
    b = ve.blast_radius(flags(spark, d)[3]).withColumnRenamed("graph_id", "topology")
    return ve.across_topologies(b).select("mean_gap", "best_topology", b.agg(F.max("gap_fraction")).scalar().alias("worst_gap"), "critical_misses")


@query(f"""WITH RECURSIVE {FLAGS}, targets AS (SELECT graph_id, node_id FROM f WHERE in_vbr AND privilege_level >= 0.8) SELECT t.graph_id, t.node_id, level + 1 AS path_length FROM targets t JOIN seen USING (graph_id, node_id)""")
def critical_paths(spark, d):
    *_, f, _, steps = flags(spark, d)
    return ve.critical_paths(f, steps).select("graph_id", "node_id", F.size("path").alias("path_length"))


@query()
def executive_summaries(spark, d):
    n, _, _, f, *_ = flags_full(spark, d)
    return ve.summary_text(ve.blast_radius(f), n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")))


@query()
def ensemble_metrics(spark, d):
    with scratch(spark):
        *_, r, _, p = _analysed(spark, d)
        p, conf = settled(p), settled(en.confidence(r))
        return cut(en.metrics(p, conf, settled(en.agreement(r))))  # a row per graph


@query("SELECT topology_type, model, weight FROM (VALUES " + ", ".join(f"('{k}', '{m}', {w}::DOUBLE)" for k, ws in en.PRIORS.items() for m, w in zip(en.MODELS, ws, strict=True)) + ") t(topology_type, model, weight)")
def topology_priors(spark, d):
    return en.priors(spark)


@query("""SELECT topology_type, model, w::DOUBLE AS weight FROM (VALUES ('HUB', 'graph_traversal', 0.1), ('HUB', 'epidemic', 0.1), ('HUB', 'spectral', 0.5), ('HUB', 'percolation', 0.2), ('HUB', 'control_system', 0.1),
    ('CHAIN', 'graph_traversal', 0.15), ('CHAIN', 'epidemic', 0.45), ('CHAIN', 'spectral', 0.1), ('CHAIN', 'percolation', 0.1), ('CHAIN', 'control_system', 0.2), ('DENSE_CLUSTER', 'graph_traversal', 0.1), ('DENSE_CLUSTER', 'epidemic', 0.15),
    ('DENSE_CLUSTER', 'spectral', 0.15), ('DENSE_CLUSTER', 'percolation', 0.5), ('DENSE_CLUSTER', 'control_system', 0.1), ('MIXED', 'graph_traversal', 0.2), ('MIXED', 'epidemic', 0.2), ('MIXED', 'spectral', 0.2), ('MIXED', 'percolation', 0.2),
    ('MIXED', 'control_system', 0.2)) t(topology_type, model, w)""")
def weight_hints(spark, d):
    return en.hints(spark)


@query(f"WITH RECURSIVE {THREE}, r AS (SELECT e.graph_id, e.src, e.dst, row_number() OVER (PARTITION BY e.graph_id ORDER BY ord, e.src, e.dst) AS rank FROM edges e JOIN bfs a ON a.graph_id = e.graph_id AND a.node_id = e.src AND a.risk >= 0.4 JOIN bfs b ON b.graph_id = e.graph_id AND b.node_id = e.dst AND b.risk >= 0.4) SELECT graph_id, src, dst, rank FROM r WHERE rank <= 10")
def critical_edges(spark, d):
    n, e, s = _org(spark, d)
    return pr.critical_edges(e, pr.graph_traversal(n, e, s))


@query("SELECT graph_id, round(avg(precision_score), 6) AS mean_cascade, round(stddev_pop(precision_score), 6) AS std_cascade FROM model_history WHERE precision_score IS NOT NULL GROUP BY 1")
def cascade_spread(spark, d):
    """Mean and deviation per graph, over the scores of its history in place of the models' headers."""
    h = table(spark, d, "model_history").where("precision_score is not null").select("graph_id", F.col("precision_score").alias("cascade_probability"))
    return _rounded(en.cascade_spread(h), "mean_cascade", "std_cascade")


@query("SELECT topology_type, model_name AS model, round(weight / sum(weight) OVER (PARTITION BY topology_type), 6) AS weight FROM current_weights")
def weight_normalise(spark, d):
    return _rounded(en.normalised(table(spark, d, "current_weights").select("topology_type", F.col("model_name").alias("model"), "weight")), "weight")


_LAST = "last AS (SELECT *, row_number() OVER (PARTITION BY topology_type, model_name ORDER BY id DESC) AS recency FROM model_history WHERE f1_score IS NOT NULL AND topology_type IS NOT NULL)"


@query(f"""WITH {_LAST}, m AS (SELECT topology_type, model_name AS model, avg(f1_score) AS w, count(*) AS n FROM last WHERE recency <= 20 AND model_name IN ('graph_traversal', 'epidemic', 'spectral_cascade', 'percolation', 'control_system', 'gnn') GROUP BY 1, 2),
    ok AS (SELECT topology_type FROM m GROUP BY 1 HAVING count(*) = 6 AND min(n) >= 5) SELECT topology_type, model, round(w / sum(w) OVER (PARTITION BY topology_type), 6) AS weight FROM m JOIN ok USING (topology_type)""")
def adaptive_weights(spark, d):
    return _rounded(en.adaptive(table(spark, d, "model_history")), "weight")


@query(f"WITH {_LAST} SELECT topology_type, model_name, recency, id, f1_score FROM last WHERE recency <= 50")
def weight_history(spark, d):
    return en.recent(table(spark, d, "model_history").where("topology_type is not null"), 50).select("topology_type", "model_name", "recency", "id", "f1_score")


@query(f"WITH RECURSIVE {ORG_SQL}, {BFS_SQL.format(seeds='seeds', edges='edges', most=60, more='')} {RISK_SQL.format(nodes='nodes')}")
def gnn_fallback(spark, d):
    n, e, s = _org(spark, d)
    r = pr.gnn(n, e, s).select("graph_id", "node_id", "risk", "compromised").join(t.bfs(e, s), ["graph_id", "node_id"], "left")
    return _rounded(r, "risk").select("graph_id", "node_id", "dist", "risk", "compromised")


@query()
def gcn_features(spark, d):
    from quellgraph.operators.gcn import features

    return features(*_org(spark, d)).select("graph_id", "node_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query()
def gcn_forward(spark, d):
    import numpy as np

    from quellgraph.operators.gcn import N_FEATURES, _layers, features, forward

    n, e, s = _org(spark, d)
    weights = {k: v.tolist() for k, v in _layers(np.random.default_rng(1), (N_FEATURES, 8, 4, 1)).items()}
    return _rounded(forward(features(n, e, s), e, weights), "risk")


@query()
def temporal_outcomes(spark, d):
    from quellgraph.operators.temporal import outcomes, simulate

    n, e, s = _org(spark, d)
    return outcomes(simulate(n, e, s, [("greedy", 1), ("stealthy", 1), ("random", 1)]))


@query()
def pipeline_report(spark, d):
    """The whole pipeline over every organisation: analysis by six models, verification, five cycles of containment."""
    return pipeline.run(*_org(spark, d), table(spark, d, "model_history")).report()


@query()
def pipeline_topologies(spark, d):
    """The same over synthetic graphs of all archetypes."""
    return pipeline.all_topologies(spark).report()


@query()
def analysis_rows(spark, d):
    """The analysis file: 11 columns per node, with a place in space."""
    r = pipeline.run(*_org(spark, d), table(spark, d, "model_history"), cycles=0)
    return r.node_rows()
