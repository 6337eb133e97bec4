"""Queries on guards, tokens, containment, mutation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellgraph.functions import tokens as tk
from quellgraph.operators import evaluation as ev
from quellgraph.operators import guards as gu
from quellgraph.operators import mutation as mu
from quellgraph.operators import propagation as pr
from quellgraph.operators import traversal as t
from quellgraph.operators import verification as ve
from quellgraph.operators.analysis import analyse
from quellgraph.plans.registry import query
from quellgraph.plans.spread import FLAGS, GATED_SQL, _org, flags, flags_full
from quellgraph.plans.views import GUARD_SQL, ORG_SQL, guard_events
from quellgraph.runtime import cut, table, top_within
from quellgraph.streaming import monitor

KEY = bytes(range(32))
_INNER, _OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
SCORED = "scored AS (SELECT e.*, (coalesce(a.x, 0.0) + coalesce(b.x, 0.0)) / 2 AS score FROM edges e LEFT JOIN f a ON a.graph_id = e.graph_id AND a.node_id = e.src LEFT JOIN f b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"
TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(score, 9) DESC, ord, src, dst) AS rank FROM scored)"
WALKED = "walked AS (SELECT DISTINCT e.graph_id, e.src, e.dst FROM edges e JOIN seen s ON s.graph_id = e.graph_id AND s.node_id = e.src LEFT JOIN seen x ON x.graph_id = e.graph_id AND x.node_id = e.dst WHERE s.level < 6 AND s.level <= e.lim AND (x.level IS NULL OR x.level > s.level))"
GUARDS = f"{WALKED}, out_edges AS (SELECT e.graph_id, e.src, e.dst FROM edges e JOIN seen s ON s.graph_id = e.graph_id AND s.node_id = e.src), chosen AS (SELECT graph_id, src, dst FROM ranked WHERE rank <= 20 UNION SELECT * FROM walked UNION SELECT * FROM out_edges), guards AS (SELECT * FROM chosen UNION SELECT e.graph_id, e.src, e.dst FROM edges e JOIN seeds s ON s.graph_id = e.graph_id AND s.node_id = e.dst WHERE e.graph_id NOT IN (SELECT graph_id FROM chosen))"


@query(f"WITH RECURSIVE {FLAGS}, {SCORED}, {TOP} SELECT graph_id, src, dst, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def high_risk_edges(spark, d):
    _, e, _, f, *_ = flags(spark, d)
    return gu.top_edges(gu.scored_edges(e, f), "score", 10).select("graph_id", "src", "dst", F.round("score", 6).alias("score"), "rank")


@query()
def high_risk_edges_full(spark, d):
    """:func:`high_risk_edges` from the analysis by all six models."""
    _, e, _, f, *_ = flags_full(spark, d)
    return gu.top_scored(e, f, 10).select("graph_id", "src", "dst", F.round("score", 6).alias("score"), "rank")


@query()
def guard_edges_full(spark, d):
    _, e, s, f, seen, steps = flags_full(spark, d)
    return gu.guard_set(e, f, steps, seen, s)


@query(f"WITH RECURSIVE {FLAGS}, {SCORED}, {TOP}, {GUARDS} SELECT * FROM guards")
def guard_edges_union(spark, d):
    _, e, s, f, seen, steps = flags(spark, d)
    return gu.guard_set(e, f, steps, seen, s)


@query(f"WITH {ORG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, ord, src, dst) AS rank FROM edges) SELECT graph_id, src, dst, weight, rank FROM r WHERE rank <= 10")
def baseline_topk(spark, d):
    return gu.top_edges(_org(spark, d)[1], "weight", 10).select("graph_id", "src", "dst", "weight", "rank")


@query(f"WITH {ORG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5(concat_ws('|', 42, graph_id, src, dst))) AS rank FROM edges) SELECT graph_id, src, dst, rank FROM r WHERE rank <= 10")
def baseline_random(spark, d):
    return gu.random_edges(_org(spark, d)[1], 10).select("graph_id", "src", "dst", "rank")


@query(f"""WITH RECURSIVE {ORG_SQL}, {GATED_SQL}, {WALKED}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, ord, src, dst) AS rank FROM edges)
    SELECT r.graph_id, round(sum((w.src IS NULL)::INT) / count(*)::DOUBLE, 6) AS fp_rate FROM r LEFT JOIN walked w USING (graph_id, src, dst) WHERE rank <= 10 GROUP BY 1""")
def false_guard_rate(spark, d):
    n, e, s = _org(spark, d)
    _, steps = t.gated(n, e, s)
    return ev.false_guards(gu.top_edges(e, "weight", 10), steps.where("outcome = 'succeeded'")).withColumn("fp_rate", F.round("fp_rate", 6))


@query(f"WITH RECURSIVE {ORG_SQL}, hop AS (SELECT graph_id, node_id FROM seeds UNION SELECT e.graph_id, e.dst FROM edges e JOIN seeds s ON s.graph_id = e.graph_id AND s.node_id = e.src) SELECT * FROM hop")
def baseline_neighbors(spark, d):
    return ev.naive(*_org(spark, d), "neighbors")


@query(f"WITH {GUARD_SQL} SELECT event_id, guard, decision, reason FROM decided CROSS JOIN (SELECT unnest(range(0, 3)) AS guard)")
def guard_decisions(spark, d):
    e = guard_events(spark, d).drop("decision", "reason")
    return gu.decisions(e).select("event_id", "guard", "decision", "reason")


@query(f"WITH {GUARD_SQL} SELECT event_id, 3::BIGINT AS n_guards, (3 * (decision = 'ALLOWED')::INT)::BIGINT AS n_allowed, CASE WHEN decision = 'ALLOWED' THEN 'ALLOWED' ELSE 'BLOCKED' END AS consensus FROM decided")
def guard_consensus(spark, d):
    return gu.agree(gu.decisions(guard_events(spark, d).drop("decision", "reason")), ["event_id"])


@query(f"""WITH {GUARD_SQL} SELECT graph_id, edge_type, count(*) AS n_events, sum((decision = 'ALLOWED')::INT)::BIGINT AS n_allowed, sum((decision = 'BLOCKED')::INT)::BIGINT AS n_blocked, sum((decision = 'FLAGGED')::INT)::BIGINT AS n_flagged, round(sum((decision <> 'ALLOWED')::INT) / count(*)::DOUBLE, 6) AS block_rate FROM decided GROUP BY 1, 2""")
def guard_statistics(spark, d):
    return gu.statistics(guard_events(spark, d), ["graph_id", "edge_type"]).withColumn("block_rate", F.round("block_rate", 6))


def _sensor_sql(start: str, seconds: float, source: str = "decided") -> str:
    return f"""WITH {GUARD_SQL}, g AS (SELECT {start} AS window_start, count(*) AS n_events, sum((decision = 'ALLOWED')::INT)::BIGINT AS n_allowed, sum((decision = 'BLOCKED' AND contains(lower(reason), 'depth'))::INT)::BIGINT AS escalations, sum((decision = 'ALLOWED' AND edge_type IN ('ASSUME_ROLE', 'AUTHENTICATE_AS'))::INT)::BIGINT AS jumps FROM {source} GROUP BY 1),
    s AS (SELECT *, 0.3 * least(1.0, n_events / {seconds}::DOUBLE / 5) + 0.2 * greatest(0.0, (0.8 - n_allowed / n_events::DOUBLE) / 0.8) + 0.3 * least(1.0, escalations / 5.0::DOUBLE) + 0.2 * least(1.0, jumps / 3.0::DOUBLE) AS score FROM g)
    SELECT epoch_us(window_start) // 1000000 AS window_start, n_events, n_allowed, escalations, jumps, round(score, 8) AS score, score > 0.6 AS anomaly FROM s"""


def _windows(df):
    return df.select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "n_events", "n_allowed", "escalations", "jumps", F.round("score", 8).alias("score"), "anomaly")


@query(_sensor_sql("time_bucket(INTERVAL '1 hour', ts)", 3600.0))
def sensor_tumbling(spark, d):
    return _windows(monitor.sensor_windows(guard_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), width="1 hour"))


@query(_sensor_sql("b", 3600.0, "(SELECT d.*, time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS b FROM decided d CROSS JOIN (SELECT unnest(range(0, 2)) AS k))"))
def sensor_sliding(spark, d):
    return _windows(monitor.sensor_windows(guard_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), width="1 hour", slide="30 minutes"))


@query("""WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS fresh FROM events), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, epoch_us(min(ts)) // 1000000 AS session_start, count(*) AS n_events FROM g GROUP BY user_id, k""")
def session_activity(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.sessions(e, "user_id").select("user_id", F.unix_seconds("session_start").alias("session_start"), "n_events")


@query(f"WITH {GUARD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, nonce ORDER BY ts, event_id) AS k FROM attempts) SELECT graph_id, nonce, event_id FROM r WHERE k = 1")
def nonce_dedupe(spark, d):
    return monitor.first_uses(guard_events(spark, d).select("graph_id", "nonce", "ts", "event_id"), ["graph_id", "nonce"]).select("graph_id", "nonce", "event_id")


@query(f"""WITH {GUARD_SQL}, b AS (SELECT graph_id, time_bucket(INTERVAL '1 day', ts) AS day, avg((decision <> 'ALLOWED')::INT) AS risk FROM decided GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY day) - 1 AS cycle, CASE WHEN risk >= 0.75 THEN 'LOCKDOWN' WHEN risk >= 0.4 THEN 'ELEVATED' ELSE 'NOMINAL' END AS after FROM b),
    p AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY graph_id ORDER BY cycle), 'NOMINAL') AS before FROM l) SELECT graph_id, cycle, before, after, round(risk, 6) AS risk FROM p WHERE before <> after""")
def strictness_transitions(spark, d):
    from pyspark.sql import Window

    b = guard_events(spark, d).groupBy("graph_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.avg((F.col("decision") != "ALLOWED").cast("int")).alias("risk"))
    log = b.withColumn("cycle", F.row_number().over(Window.partitionBy("graph_id").orderBy("w.start")) - 1).withColumn("strictness", tk.strictness_of(F.col("risk")))
    return gu.transitions(log).withColumn("risk", F.round("risk", 6))


@query("""WITH x AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision, event_id % 3 = 0 AS deep, event_id % 2 = 0 AS jump FROM events),
    g AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n_events, sum((decision = 'ALLOWED')::INT)::BIGINT AS n_allowed, sum((decision = 'BLOCKED' AND deep)::INT)::BIGINT AS escalations, sum((decision = 'ALLOWED' AND jump)::INT)::BIGINT AS jumps FROM x GROUP BY 1),
    s AS (SELECT *, 0.3 * least(1.0, n_events / 3600.0::DOUBLE / 5) + 0.2 * greatest(0.0, (0.8 - n_allowed / n_events::DOUBLE) / 0.8) + 0.3 * least(1.0, escalations / 5.0::DOUBLE) + 0.2 * least(1.0, jumps / 3.0::DOUBLE) AS score FROM g)
    SELECT epoch_us(window_start) // 1000000 AS window_start, n_events, n_allowed, escalations, jumps, round(score, 8) AS score, score > 0.6 AS anomaly FROM s""")
def sensor_stream(spark, d):
    """The tumbling windows again, as a stream over the files that are there."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ids = F.col("event_id")
    e = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "BLOCKED").otherwise("ALLOWED").alias("decision"), F.when(ids % 3 == 0, "depth_exceeded").otherwise("ok").alias("reason"), F.when(ids % 2 == 0, "ASSUME_ROLE").otherwise("SECRET_READ").alias("edge_type"))
    import uuid

    return _windows(monitor.run_available(monitor.sensor_windows(e, width="1 hour"), f"sensor_{uuid.uuid4().hex}", "complete"))


BLOCKED = f"{FLAGS}, {SCORED}, {TOP}, blocked AS (SELECT graph_id, src, dst FROM ranked WHERE rank <= 20), left_edges AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.graph_id = e.graph_id AND b.src = e.src AND b.dst = e.dst)), walk2 AS (SELECT graph_id, node_id, 0 AS level FROM seeds UNION SELECT w.graph_id, e.dst, level + 1 FROM walk2 w JOIN left_edges e ON e.graph_id = w.graph_id AND e.src = w.node_id WHERE level < 6 AND level <= e.lim), seen2 AS (SELECT DISTINCT graph_id, node_id FROM walk2)"


def _blocked(spark, d):
    n, e, s, f, seen, steps = flags(spark, d)
    b = cut(gu.top_edges(gu.scored_edges(e, f), "score", 20).select("graph_id", "src", "dst"))
    return n, e, s, f, seen, b


@query(f"""WITH RECURSIVE {BLOCKED}, j AS (SELECT graph_id, node_id, max(b) AS b, max(a) AS a, max(u) AS u FROM (SELECT graph_id, node_id, 1 AS b, 0 AS a, 0 AS u FROM seen UNION ALL SELECT graph_id, node_id, 0, 1, 0 FROM seen2 UNION ALL SELECT graph_id, node_id, 0, 0, 1 FROM hit) GROUP BY 1, 2),
    k AS (SELECT graph_id, sum(b) AS vbr, sum(a)::BIGINT AS missed, sum(b * (1 - a))::BIGINT AS gb, sum(u * (1 - b))::BIGINT AS nb, sum(u) AS reach FROM j GROUP BY 1)
    SELECT graph_id, round(gb / vbr::DOUBLE, 4) AS success_rate, missed, round(greatest(0, (vbr - missed) / vbr::DOUBLE), 4) AS reduction, nb AS natural_blocks, gb AS guard_blocks, round(least(1.0, (nb + gb) / reach::DOUBLE), 4) AS combined FROM k""")
def containment_metrics(spark, d):
    n, e, s, _, seen, b = _blocked(spark, d)
    after, _ = t.gated(n, e.join(b, ["graph_id", "src", "dst"], "left_anti").select(*e.columns), s)
    return gu.containment(seen, after, t.bfs(e, s))


@query(f"""WITH RECURSIVE {BLOCKED}, a AS (SELECT e.graph_id, e.src, bool_and(b.src IS NOT NULL) AS closed FROM edges e LEFT JOIN blocked b USING (graph_id, src, dst) GROUP BY 1, 2) SELECT graph_id, src AS node_id FROM a WHERE closed AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.graph_id = a.graph_id AND s.node_id = a.src)""")
def fully_contained(spark, d):
    _, e, s, _, _, b = _blocked(spark, d)
    return gu.fully_contained(e, b, s)


@query(f"""WITH RECURSIVE {BLOCKED} SELECT graph_id, src, dst, 'Guard-' || replace(src, '/', '-') || '-to-' || replace(dst, '/', '-') AS policy_name, '{{"Version":"2012-10-17","Statement":[{{"Sid":"EdgeGuard","Effect":"Deny","Action":"sts:AssumeRole","Resource":' || to_json('arn:aws:iam::123456789012:role/' || dst) || '}}]}}' AS document FROM blocked""")
def deny_policies(spark, d):
    return gu.deny_policies(_blocked(spark, d)[5]).select("graph_id", "src", "dst", "policy_name", "document")


@query(f"""WITH RECURSIVE {BLOCKED}, pings AS (SELECT graph_id, src, dst FROM edges WHERE (('0x' || substr(md5(concat_ws('|', 42, graph_id, src, dst)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.45)
    SELECT p.graph_id, p.src, p.dst, CASE WHEN b.src IS NULL THEN 'allowed' ELSE 'blocked' END AS status FROM pings p LEFT JOIN blocked b USING (graph_id, src, dst)""")
def mock_guard_join(spark, d):
    from quellgraph.functions.rng import unit

    _, e, _, _, _, b = _blocked(spark, d)
    pings = e.where(unit(42, "graph_id", "src", "dst") < 0.45).select("graph_id", F.struct("graph_id", "src").alias("src"), F.struct("graph_id", "dst").alias("dst"))
    keyed = b.select(F.struct("graph_id", "src").alias("src"), F.struct("graph_id", "dst").alias("dst"))
    return monitor.checked(pings, keyed).select("graph_id", F.col("src.src").alias("src"), F.col("dst.dst").alias("dst"), "status")


@query(f"WITH RECURSIVE {ORG_SQL}, {GATED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY level, node_id) AS rank FROM seen) SELECT graph_id, node_id, level, rank FROM r WHERE rank <= 18")
def timeline_order(spark, d):
    seen, _ = t.gated(*_org(spark, d))
    return top_within(seen, ["graph_id"], ["level", "node_id"], 18)


@query(f"WITH RECURSIVE {ORG_SQL}, {GATED_SQL}, {WALKED} SELECT w.graph_id, s.level, count(*) AS n_steps, count(DISTINCT w.dst) AS n_nodes FROM walked w JOIN seen s ON s.graph_id = w.graph_id AND s.node_id = w.src GROUP BY 1, 2")
def depth_waves(spark, d):
    _, steps = t.gated(*_org(spark, d))
    return steps.where("outcome = 'succeeded'").groupBy("graph_id", "level").agg(F.count("*").alias("n_steps"), F.countDistinct("dst").alias("n_nodes"))


def _again(spark, d):
    """The analysis by six models, with weights by topology, as the feedback loop repeats it."""
    history = table(spark, d, "model_history")
    return lambda n, e, s: analyse(n, e, s, history)[2]


@query()
def feedback_log(spark, d):
    n, e, s, f, seen, steps = flags_full(spark, d)
    g = cut(gu.guard_set(e, f, steps, seen, s))
    return gu.feedback(n, e, s, g, _again(spark, d))[2].withColumn("risk", F.round("risk", 6))


@query()
def containment_run(spark, d):
    n, e, s, f, *_ = flags_full(spark, d)
    return gu.contain(n, e, s, f, _again(spark, d), t.bfs(e, s))["metrics"]


_SHARE = "picked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5(concat_ws('|', 42, graph_id, src, dst))) - 1 AS i, round(count(*) OVER (PARTITION BY graph_id) * 0.3) AS k FROM {0}), p AS (SELECT * FROM picked WHERE i < k)"
_REST = "SELECT graph_id, src, dst, edge_type, weight FROM edges e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.graph_id = e.graph_id AND p.src = e.src AND p.dst = e.dst)"
_CENTS = "round(weight * {0}, 4)"


@query(f"WITH {ORG_SQL}, risky AS (SELECT * FROM edges WHERE weight > 0.6), {_SHARE.format('risky')} {_REST} UNION ALL SELECT graph_id, src, concat_ws('_', 'wp', src, dst, i), 'AUTHENTICATE_AS', {_CENTS.format('0.6')} FROM p UNION ALL SELECT graph_id, concat_ws('_', 'wp', src, dst, i), dst, 'AUTHENTICATE_AS', {_CENTS.format('0.6')} FROM p")
def edge_split(spark, d):
    n, e, _ = _org(spark, d)
    return mu.split_edges(n, e)[1].select("graph_id", "src", "dst", "edge_type", "weight")


@query(f"""WITH {ORG_SQL}, svc AS (SELECT e.* FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst WHERE a.node_type = 'SERVICE' AND b.node_type = 'SERVICE'), {_SHARE.format('svc')}
    {_REST} UNION ALL SELECT graph_id, src, concat_ws('_', 'obf_role', i, src), 'ASSUME_ROLE', {_CENTS.format('0.9')} FROM p UNION ALL SELECT graph_id, concat_ws('_', 'obf_role', i, src), dst, 'TOKEN_MINT', {_CENTS.format('0.9')} FROM p""")
def chain_obfuscation(spark, d):
    n, e, _ = _org(spark, d)
    return mu.obfuscate_chains(n, e)[1].select("graph_id", "src", "dst", "edge_type", "weight")


@query(f"""WITH {ORG_SQL}, strong AS (SELECT graph_id, node_id FROM nodes WHERE privilege_level >= 0.5), pool AS (SELECT * FROM strong UNION ALL SELECT graph_id, node_id FROM nodes WHERE graph_id NOT IN (SELECT graph_id FROM strong)), k AS (SELECT unnest(range(0, 3)) AS k),
    pick AS (SELECT graph_id, k, arg_min(node_id, md5(concat_ws('|', 42, graph_id, k, node_id))) AS dst FROM pool CROSS JOIN k GROUP BY 1, 2)
    SELECT graph_id, concat_ws('_', 'decoy', k, floor((('0x' || substr(md5(concat_ws('|', 42, graph_id, k)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 10000)::BIGINT) AS src, dst, 0.15::DOUBLE AS weight FROM pick""")
def decoy_dilution(spark, d):
    n, e, _ = _org(spark, d)
    return mu.dilute(n, e)[1].where("src like 'decoy_%'").select("graph_id", "src", "dst", "weight")


@query()
def robustness(spark, d):
    """Every mutation at three intensities on every organisation at once: each variant is a graph of its own."""
    n, e, s = _org(spark, d)
    variants = [(m, i) for m in mu.STRATEGIES for i in (0.2, 0.4, 0.6)]
    nodes, edges, seeds = (ev.tag_graphs(x, "base") for x in (mu.conform(n, mu.NODES), mu.conform(e, mu.EDGES), s.select("graph_id", "node_id")))
    for m, i in variants:
        a, b = mu.mutate(n, e, m, i)
        nodes, edges, seeds = nodes.unionByName(ev.tag_graphs(a, f"{m}:{i}")), edges.unionByName(ev.tag_graphs(b, f"{m}:{i}")), seeds.unionByName(ev.tag_graphs(s.select("graph_id", "node_id"), f"{m}:{i}"))
    nodes, edges, seeds = cut(nodes), cut(edges), cut(seeds)
    pred = pr.epidemic(nodes, edges, seeds, max_steps=6, tolerance=0, infection_threshold=0.05, direction="forward")
    seen, _ = t.gated(nodes, edges, seeds, 8)
    blast = cut(ve.blast_radius(ve.flags(nodes, pred, seen)).withColumn("_t", F.split("graph_id", "@")))
    base = blast.where("_t[1] = 'base'").withColumn("graph_id", F.col("_t")[0])
    after = blast.where("_t[1] != 'base'").withColumn("graph_id", F.col("_t")[0]).withColumn("strategy", F.split(F.col("_t")[1], ":")[0]).withColumn("intensity", F.split(F.col("_t")[1], ":")[1].cast("double"))
    return ev.robustness(cut(ev.compare_mutation(base, after).withColumn("topology", F.col("graph_id"))))


@query(f"""WITH m AS (SELECT event_id, 't' || event_id || 'user-' || user_id || 'svc-' || (user_id % 11) || (event_id % 97) || (event_id % 400) AS msg FROM events)
    SELECT event_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(msg)))) AS signature FROM m""")
def hmac_sign(spark, d):
    e = table(spark, d, "events")
    msg = tk.token_message(F.concat(F.lit("t"), F.col("event_id").cast("string")), F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("svc-"), (F.col("user_id") % 11).cast("string")), (F.col("event_id") % 97).cast("string"), F.col("event_id") % 400)
    return e.select("event_id", tk.hmac_sha256(KEY, msg).alias("signature"))


@query(f"""WITH {GUARD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, nonce ORDER BY ts, event_id) > 1 AS used FROM attempts)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid_signature' WHEN age > 300 THEN 'token_expired' WHEN depth > max_depth THEN 'depth_exceeded' WHEN used THEN 'nonce_replayed' ELSE 'valid' END AS verdict FROM r""")
def token_validate(spark, d):
    e = guard_events(spark, d)
    first = monitor.first_uses(e.select("graph_id", "nonce", "ts", "event_id"), ["graph_id", "nonce"]).select("event_id", F.lit(False).alias("used"))
    j = e.join(first, "event_id", "left")
    return j.select("event_id", tk.token_verdict(F.col("event_type") != "error", F.col("age"), F.col("depth"), F.col("max_depth"), F.coalesce("used", F.lit(True))).alias("verdict"))


@query()
def device_frames(spark, d):
    e = guard_events(spark, d)
    token = F.struct(F.concat(F.lit("t"), F.col("event_id")).alias("token_id"), F.concat(F.lit("user-"), "user_id").alias("origin_node"), F.col("graph_id").alias("target_node"), F.col("depth").alias("delegation_depth"), "max_depth", F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit(300.0).alias("ttl_seconds"), F.lpad(F.hex("event_id"), 32, "0").alias("nonce"), "edge_type")
    return e.select("event_id", F.hex(tk.device_frame(token, F.col("strictness"), KEY)).alias("frame"))


@query("SELECT answer, decision, reason FROM (VALUES ('FRAME OK\nHMAC FAIL diff=1', 'BLOCKED', 'hw:invalid_signature'), ('TTL over', 'BLOCKED', 'hw:token_expired'), ('depth violation', 'BLOCKED', 'hw:depth_exceeded'), ('NONCE dup', 'BLOCKED', 'hw:nonce_replayed'), ('ACCESS OK depth=2', 'ALLOWED', 'hw:all_checks_passed'), ('denied', 'BLOCKED', 'hw:rejected:denied'), ('??', 'BLOCKED', 'hw:unrecognized:??')) t(answer, decision, reason)")
def device_answers(spark, d):
    a = spark.createDataFrame([(x,) for x in ("FRAME OK\nHMAC FAIL diff=1", "TTL over", "depth violation", "NONCE dup", "ACCESS OK depth=2", "denied", "??")], "answer string")
    return a.withColumn("_d", tk.device_decision(F.col("answer"))).select("answer", "_d.decision", "_d.reason")

