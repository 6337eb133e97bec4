"""Monitoring as streams: windows of guard events, replayed nonces, strictness per principal, traffic against blocked edges.

Each function takes a streaming or a batch DataFrame of events; in a batch the watermark has no effect, which is how the
streams are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quellgraph.operators.guards import sensor
from quellgraph.runtime import cut, own_path


def sensor_windows(events: DataFrame, ts: str = "ts", width: str = "60 seconds", slide: str | None = None, lateness: str = "5 minutes", by: list[str] = (), threshold: float = 0.6) -> DataFrame:
    """The sensor's reading per event-time window, tumbling or sliding; events later than ``lateness`` are dropped by a stream."""
    seconds = float(pd.Timedelta(width).total_seconds())
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = sensor(events.withWatermark(ts, lateness), [w.alias("w"), *by], seconds, threshold)
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity of each principal without a pause of ``gap``."""
    g = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_uses(tokens: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """The first use of each nonce within its life; a stream forgets it afterwards."""
    if tokens.isStreaming:
        return tokens.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in tokens.columns if c not in keys]
    first = tokens.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r"))
    return first.select(*keys, *[F.col("r").getField(c).alias(c) for c in rest]).select(*tokens.columns)


def fresh(tokens: DataFrame, now: Column, ts: str = "ts", seconds: float = 300.0) -> DataFrame:
    return tokens.where(now.cast("double") - F.col(ts).cast("double") <= seconds)


def checked(traffic: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pings with their status: a stream-static join against the blocked edges."""
    b = blocked.select("src", "dst").distinct().withColumn("_b", F.lit(True))
    return traffic.join(b, ["src", "dst"], "left").withColumn("status", F.when(F.col("_b"), "blocked").otherwise("allowed")).drop("_b")


def traffic(spark: SparkSession, edges: DataFrame, ticks: DataFrame | None = None, rate: int = 100, p: float = 0.45, seed: int = 42) -> DataFrame:
    """Pings on edges (idx, src, dst), idx from 0: tick number v is edge v modulo their number in cycle v over their number, and fires
    with probability ``p``. Ticks come from a rate source, or from a batch (value, timestamp)."""
    from quellgraph.functions.rng import unit

    n = max(1, edges.count())
    t = ticks if ticks is not None else spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    t = t.select((F.col("value") % n).alias("idx"), F.floor(F.col("value") / n).alias("cycle"), F.col("timestamp").alias("ts"))
    return t.join(edges.select("idx", "src", "dst"), "idx").where(unit(seed, "cycle", F.col("src"), F.col("dst")) < p).select("cycle", "ts", "src", "dst")


def strictness_stream(events: DataFrame, key: str = "graph_id", ts: str = "ts") -> DataFrame:
    """``(key, ts, score, before, after)`` at every change of strictness: a state machine per key over running risk in event time.

    The state is a mean and a level, of constant size however many events a key has.
    """
    schema = f"{key} string, ts timestamp, score double, before string, after string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, level = state.get if state.exists else (0, 0.0, "NOMINAL")
        rows = []
        for batch in batches:
            for t, risk in batch.sort_values(ts)[[ts, "risk"]].itertuples(index=False):
                n, total = n + 1, total + float(risk)
                mean = total / n
                now = "LOCKDOWN" if mean >= 0.75 else "ELEVATED" if mean >= 0.4 else "NOMINAL"
                if now != level:
                    rows.append((k[0], t, round(mean, 6), level, now))
                    level = now
        state.update((n, total, level))
        yield pd.DataFrame(rows, columns=[key, "ts", "score", "before", "after"])

    return events.groupBy(key).applyInPandasWithState(step, schema, "n long, total double, level string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a new table in the shared folder, and gives the table. Its checkpoint lies within.

    In ``complete`` mode every batch writes its whole result to a folder of its own, and the last one is the table.
    """
    spark = stream.sparkSession
    base = own_path(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    last = {"path": f"{base}/out"}
    if mode == "complete":

        def keep(batch: DataFrame, number: int) -> None:
            last["path"] = f"{base}/out-{number}"
            batch.write.mode("overwrite").parquet(last["path"])

        writer = writer.foreachBatch(keep)
    else:
        writer = writer.format("parquet").option("path", last["path"])
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["path"])


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each batch, computed once, to every sink in turn."""

    def handle(batch: DataFrame, number: int) -> None:
        kept = cut(batch)
        for sink in sinks:
            sink(kept, number)

    return handle


def on_breach(launch: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that launches an analysis for the principals with a BREACH in the batch, given as a table of one column,
    however many there are; not called where there are none."""

    def handle(batch: DataFrame, _: int) -> None:
        hit = cut(batch.where("status = 'BREACH'").select("principal").distinct())
        if hit.take(1):
            launch(hit)

    return handle


def replay(events: DataFrame, breaches: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded events (principal, action, ts) with their status: BREACH where ``breaches`` names their keys, else OK. A stream or a batch."""
    b = breaches.select(*keys).distinct().withColumn("_b", F.lit(True))
    return events.join(b, keys, "left").withColumn("status", F.when(F.col("_b"), "BREACH").otherwise("OK")).drop("_b")


def learn(history_path: str, weights_path: str, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends scored predictions to the history and replaces the weights of the topologies in the batch
    by their adaptive ones."""
    from quellgraph.operators.ensemble import adaptive
    from quellgraph.sources.state import append_history, upsert_weights

    def handle(batch: DataFrame, _: int) -> None:
        kept = cut(batch)
        append_history(kept, history_path)
        spark = batch.sparkSession
        seen = spark.read.parquet(history_path).join(kept.select("topology_type").distinct(), "topology_type", "left_semi")
        upsert_weights(spark, cut(adaptive(seen, **options)), weights_path)

    return handle


def progress(query: StreamingQuery) -> DataFrame:
    """What a running query has said of its last batches: (batch, started, input_rows, rows_per_second, duration_ms)."""
    rows = [(int(p["batchId"]), str(p["timestamp"]), int(p["numInputRows"]), float(p["processedRowsPerSecond"] or 0.0), int(p["batchDuration"])) for p in query.recentProgress]
    return SparkSession.getActiveSession().createDataFrame(rows, "batch bigint, started string, input_rows bigint, rows_per_second double, duration_ms bigint")
