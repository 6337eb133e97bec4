"""References to records that do not exist: as-of matching against contiguous runs of integer parent keys.

Keys are numbered first: the distinct keys of both sides, in sorted order, get gapless integers, and from there on only integers
travel. A parent side says at which integers of an axis each key exists: single integers (row numbers, versions) or half-open
spans of them (microseconds). Sorted, these compress into contiguous runs, overlapping and touching ones joined, so that of a
parent delivered a thousand times one run is left. A reference is an integer on the same axis. It belongs to the last run that
starts at or before it and is sound if it lies before that run's end; else it is an orphan, and whether some run starts before
it, after it only, or nowhere says why.

Runs and references meet as one stream of events, sorted by key and integer. Keys with more than ``hot_rows`` events are cut into
slices of the integer axis, and slices that hold too many references to one integer are dealt to several tasks, with a copy of
the slice's runs each; so no key, however large, is sorted by one task. Runs are cut at the slice borders, which leaves every
answer as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellgraph.runtime import global_index, spread_join

#: Events of one key that one task may sort, unless 1 / MOST_HOT of all events is more. At most MOST_HOT keys can be above it.
HOT_ROWS, MOST_HOT = 2_000_000, 4096
FOREVER = (1 << 63) - 1


def number_keys(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """``(*keys, key, load)``: the distinct keys of ``sides`` without nulls, numbered from 0 in sorted order, and how many rows have each."""
    rows = sides[0].select(*keys)
    for more in sides[1:]:
        rows = rows.unionByName(more.select(*keys))
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("load"))
    return global_index(counts, keys, "key")


def with_number(df: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the number ``key`` of its ``keys``; null where one of them is null."""
    return spread_join(df, numbers, keys, "load", F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]))


def compress_runs(spans: DataFrame, by: list[str]) -> DataFrame:
    """The contiguous runs ``(*by, a, b, first)`` of half-open integer spans ``(*by, a, b, first)``; ``first`` is the smallest of a run's spans."""
    w = Window.partitionBy(*by).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_new", F.when(before.isNull() | (before < F.col("a")), F.col("a")))
    run = begun.withColumn("_run", F.last("_new", ignorenulls=True).over(w))
    return run.groupBy(*by, F.col("_run").alias("a")).agg(F.max("b").alias("b"), F.min("first").alias("first")).select(*by, "a", "b", "first")


def _slices(events: DataFrame, numbers: DataFrame, hot_rows: int) -> DataFrame | None:
    """``(key, cuts)`` of the keys with too many events by their load; None if there are none."""
    limit = F.greatest(F.lit(hot_rows), numbers.agg(F.sum("load")).scalar() / MOST_HOT)
    heavy = [(r["key"], r["load"]) for r in numbers.where(F.col("load") > limit).select("key", "load").collect()]
    if not heavy:
        return None
    spark = events.sparkSession
    parts = max(2, -(-max(n for _, n in heavy) // hot_rows))
    at = ", ".join(str(i / parts) for i in range(1, parts))
    named = events.join(F.broadcast(spark.createDataFrame([(k,) for k, _ in heavy], "key bigint")), "key")
    cuts = named.groupBy("key").agg(F.sort_array(F.array_distinct(F.expr(f"percentile_approx(a, array({at}), 10000)"))).alias("cuts"))
    return spark.createDataFrame(cuts.collect(), "key bigint, cuts array<bigint>")  # as many rows as heavy keys


def match_runs(
    refs: DataFrame, ref_keys: list[str], at: str, parents: DataFrame, parent_keys: list[str], start: str, end: str | None, *, hot_rows: int = HOT_ROWS, prefix: str = ""
) -> DataFrame:
    """``refs`` with ``run_start``, ``run_end`` of the run that starts last at or before ``at``, and ``first_start`` of the key.

    Null where there is none. Parents exist from ``start`` up to but not including ``end``, for ever where it is null, or at
    ``start`` only if ``end`` is None. Spans with a null key or start, or that don't last, don't count. References with a null
    key or integer match nothing. Repeated references stay repeated; repeated spans change nothing. Columns of ``parents``
    other than those named don't matter, nor whether names clash. ``refs`` is read twice, and should be stored if it is costly.
    """
    rest = refs.columns
    ks = [f"_k{i}" for i in range(len(ref_keys))]
    a = F.col(start).cast("bigint")
    b = a + 1 if end is None else F.coalesce(F.col(end).cast("bigint"), F.lit(FOREVER))
    spans = parents.select(*[F.col(k).alias(n) for k, n in zip(parent_keys, ks, strict=True)], a.alias("a"), b.alias("b")).where("a is not null and b > a").dropna(subset=ks)
    rows = refs.select(*[F.col(k).alias(n) for k, n in zip(ref_keys, ks, strict=True)], F.col(at).cast("bigint").alias("a"), F.struct("*").alias("row"))
    numbers = number_keys([rows, spans], ks)
    # References without a key match nothing; each gets a number below 0, so that they don't meet in one task.
    lone = F.lit(False)
    for c in (*ks, "a"):
        lone |= F.col(c).isNull()
    number = F.lit(-1).cast("bigint") - F.pmod(F.xxhash64(*[F.col("row").getField(c) for c, t in refs.dtypes if "map<" not in t]), F.lit(1 << 40))
    rows = rows.withColumn("lone", F.when(lone, number))
    left = with_number(rows, numbers, ks).select(F.coalesce("lone", "key").alias("key"), "a", "row")
    spans = with_number(spans, numbers, ks).select("key", "a", "b", F.col("a").alias("first"))
    cuts = _slices(left.where("key >= 0").select("key", "a").unionByName(spans.select("key", "a")), numbers, hot_rows)
    if cuts is None:
        left, runs = left.withColumn("s", F.lit(0)).withColumn("p", F.lit(0)), compress_runs(spans.withColumn("s", F.lit(0)), ["key", "s"]).withColumn("p", F.lit(0))
    else:
        left, runs = _sliced(left, spans, F.broadcast(cuts), hot_rows)
    none = F.lit(None).cast(left.schema["row"].dataType)
    null = F.lit(None).cast("bigint")
    by = ["key", "s", "p"]
    events = runs.select(*by, "a", "b", "first", F.lit(0).alias("kind"), none.alias("row"))
    events = events.unionByName(left.select(*by, "a", null.alias("b"), null.alias("first"), F.lit(1).alias("kind"), "row"))
    w = Window.partitionBy(*by).orderBy("a", "kind")
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = events.select("row", "kind", last(F.when(F.col("kind") == 0, F.col("a"))).alias("rs"), last("b").alias("re"), F.min("first").over(Window.partitionBy(*by)).alias("fs")).where("kind = 1").drop("kind")
    return run.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("rs").alias(f"{prefix}run_start"), F.col("re").alias(f"{prefix}run_end"), F.col("fs").alias(f"{prefix}first_start"))


def _sliced(left: DataFrame, spans: DataFrame, cuts: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """References and runs with their slice ``s`` and part ``p``. Every slice of a cut key also learns the key's first start, and the
    last run that ended before the slice."""
    slice_of = lambda c: F.coalesce(F.size(F.filter("cuts", lambda x: x <= c)), F.lit(0))
    low = F.when(F.col("s") > 0, F.get("cuts", F.col("s") - 1))
    placed = left.join(cuts, "key", "left").withColumn("s", slice_of(F.col("a")))
    crowd = placed.where("cuts is not null").groupBy("key", "s").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("parts")).where("parts > 1")
    crowd = F.broadcast(left.sparkSession.createDataFrame(crowd.collect(), "key bigint, s int, parts int"))  # at most events / hot_rows rows
    deal = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.to_json("row")), F.col("parts"))).otherwise(0).cast("int")
    placed = placed.join(crowd, ["key", "s"], "left").select("key", "a", "row", "s", deal.alias("p"))
    wide = spans.join(cuts, "key", "left").withColumn("s", F.explode(F.sequence(slice_of(F.col("a")), slice_of(F.col("b") - 1))))
    high = F.coalesce(F.get("cuts", "s"), F.lit(FOREVER))
    runs = compress_runs(wide.select("key", "s", F.greatest("a", low).alias("a"), F.least("b", high).alias("b"), "first"), ["key", "s"])
    marks = spans.join(cuts, "key").withColumn("s", F.explode(F.sequence(F.lit(0), F.size("cuts")))).withColumn("low", low)
    marks = marks.groupBy("key", "s").agg(F.min("a").alias("first"), F.max(F.when(F.col("a") < F.col("low"), F.struct(F.least("b", "low").alias("b"), F.col("a").alias("a")))).alias("m"))
    runs = runs.unionByName(marks.select("key", "s", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "first"))
    dealt = runs.join(crowd, ["key", "s"], "left").withColumn("p", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return placed, dealt.select("key", "s", "p", "a", "b", "first")


def orphan_reason(at: str, prefix: str = "") -> F.Column:
    """``deleted``, ``late`` or ``missing`` for an orphan, null for a sound reference."""
    t = F.col(at).cast("bigint")
    first = F.col(f"{prefix}first_start")
    return F.when(t < F.col(f"{prefix}run_end"), None).when(first <= t, "deleted").when(first.isNotNull(), "late").otherwise("missing")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month, field and reason."""
    return orphans.groupBy("ref_table", "ref_month", "ref_field", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("keys"))
