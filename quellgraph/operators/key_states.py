"""Per-key results when a few keys hold most records.

Native algebraic aggregates: every partition combines its rows by key in a bounded hash table, which spills sorted runs when
it is full, and only these partial states are shuffled, so that a key with a third of all rows sends one row per partition.
Nothing here collects the rows of a key; exact distinct counts, medians and lists per key are left out on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, measures: list[str] = ()) -> DataFrame:
    """One row ``(key_value, n_rows, share, sum_/avg_/min_/max_ of each measure)`` per non-null key.

    ``share`` is of the rows with a non-null key. Null and NaN measures don't count; a measure without values is null.
    An empty table, or one of null keys only, gives no row. Repeated rows count each time.
    """
    cols = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key_value"), *[F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(f"_m{i}") for i, m in enumerate(measures)])
    aggs = [F.count("*").alias("n_rows")]
    for i, m in enumerate(measures):
        aggs += [F.sum(f"_m{i}").alias(f"sum_{m}"), F.avg(f"_m{i}").alias(f"avg_{m}"), F.min(f"_m{i}").alias(f"min_{m}"), F.max(f"_m{i}").alias(f"max_{m}")]
    states = cols.groupBy("key_value").agg(*aggs)
    total = states.agg(F.sum("n_rows")).scalar()  # from the same shuffle, which Spark reuses
    return states.select("key_value", "n_rows", (F.col("n_rows") / total).alias("share"), *[c for c in states.columns if c not in ("key_value", "n_rows")])


def dominating(states: DataFrame, share: float = 0.05) -> DataFrame:
    """The keys that hold at least ``share`` of the rows: at most 1 / share of them."""
    return states.where(F.col("share") >= share)
