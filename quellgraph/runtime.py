"""Session settings, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a session of this engine needs; a cluster sets its own partition counts and sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "quellgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master.

    On a cluster without that setting there is no folder that is safe to use, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quellgraph-"))
    return os.path.dirname(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: columnar, for wide or large results used several times."""
    path = own_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """:func:`written`, and what that shuffled is freed before anything else runs."""
    out = written(df)
    del df
    free(out.sparkSession)
    return out


_OWN: list[tuple[SparkSession, str]] = []


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_tidy)
    _OWN.append((spark, path))
    return path


def _tidy() -> None:
    for spark, path in _OWN:
        try:
            p, fs = _path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session is gone already, and its files are the folder owner's
            return


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that nothing refers to anymore; it waits for a collection of garbage otherwise."""
    gc.collect()
    waiting, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.time() + 1.5
    while waiting and time.time() < until:  # py4j lets go of what was collected here in a thread of its own, which looks once a second
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What :func:`written` writes inside is deleted at the end, and what is freed by then; only what was cut or collected inside may be used later,
    and what was written last whenever the function that this gives is called with it."""
    before, kept = len(_OWN), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_OWN[-1])
        return df

    try:
        yield keep
    finally:
        gone = [x for x in _OWN[before:] if os.path.basename(x[1]).startswith("written-") and x not in kept]
        _OWN[before:] = [x for x in _OWN[before:] if x not in gone]
        for _, path in gone:
            p, fs = _path(spark, path)
            fs.delete(p, True)
        free(spark)


#: Keys that hold at least 1 / HOT_SHARE of all rows are hot. There can't be more than so many of them, however large the data.
HOT_SHARE = 4096


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], load: str, spread: F.Column) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row per key and in ``load`` how much of ``left`` has that key.

    Hot keys, at most ``HOT_SHARE`` of them whatever the data, are broadcast; their rows of ``left`` are spread over all tasks by
    ``spread``, so that no task gets a key with a third of all rows. All other keys meet by shuffle. ``load`` isn't in the result.
    """
    values = [c for c in right.columns if c not in keys and c != load]
    total = right.agg(F.sum(load)).scalar()
    cold = F.col(load) * HOT_SHARE < total
    hot = right.where(~cold).select(*keys, F.struct(F.lit(True).alias("_on"), *values).alias("_hot"))
    out = left.withColumn("_by", spread).join(F.broadcast(hot), keys, "left")
    out = out.withColumn("_by", F.when(F.col("_hot").isNotNull(), F.pmod("_by", F.lit(1 << 20)) + 1).otherwise(0))
    rest = right.where(cold).select(*keys, F.lit(0).cast("bigint").alias("_by"), F.struct(F.lit(True).alias("_on"), *values).alias("_cold"))
    out = out.join(rest, [*keys, "_by"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*left.columns, *[F.col("_found").getField(v).alias(v) for v in values])


_KEPT: dict[tuple, tuple[str, T.StructType]] = {}


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written_once(spark: SparkSession, name: str, sources: list[str], make) -> DataFrame:
    """``make()`` written by :func:`written` once in a session, and read again as long as neither the files ``sources`` change nor the copy is gone."""
    stamps = []
    for source in sources:
        p, fs = _path(spark, source)
        stamps.append((source, fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()))
    key = (spark.sparkContext.applicationId, name, *stamps)
    if key in _KEPT:
        path, schema = _KEPT[key]
        p, fs = _path(spark, path)
        if fs.exists(p):
            return spark.read.schema(schema).parquet(path)
    path = own_path(spark, "once")
    df = make()
    df.write.parquet(path)
    _KEPT[key] = path, df.schema
    del df
    free(spark)  # what made it isn't needed anymore
    return spark.read.schema(_KEPT[key][1]).parquet(path)


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


def global_index(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """``df`` with a gapless 0-based index of its rows in the order of ``order``.

    The rows are range-partitioned, so that no group has to fit in one task, however large. What the driver
    sees is one count per partition. Rows that tie on ``order`` are numbered arbitrarily but only once: the
    sorted rows are kept before they are counted.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    if not offsets:
        return ordered.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    base = spark.createDataFrame(offsets, "_part bigint, _base bigint")
    return ordered.withColumn("_part", part).join(F.broadcast(base), "_part").select(*df.columns, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def place_within(df: DataFrame, key: str, order: list[str], name: str = "i") -> DataFrame:
    """``df`` with each row's 0-based place within its ``key`` in the order of ``order``; no key has to fit in one task."""
    index = global_index(df, [key, *order], "_idx")
    first = index.groupBy(key).agg(F.min("_idx").alias("_first"))
    return index.join(first, key).withColumn(name, F.col("_idx") - F.col("_first")).drop("_idx", "_first")


def top_within(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``. Cut to k in 64 salted parts first, so that a key with a third of all
    rows isn't sorted by one task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    part = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


#: Whitespace of any kind: what Unicode calls white space, and the ASCII separators.
SPACE = r"[\s\x1c-\x1f]"


def trimmed(c) -> F.Column:
    """``c`` without whitespace of any kind at both ends. Text that starts and ends with visible ASCII isn't searched."""
    visible = lambda x: (F.ascii(x) > 32) & (F.ascii(x) < 127)
    return F.when(visible(c) & visible(F.right(c, F.lit(1))), c).otherwise(F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", ""))
