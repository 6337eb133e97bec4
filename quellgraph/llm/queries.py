"""The queries of this package over the whole document tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellgraph.llm import leakage, packing, spam
from quellgraph.runtime import table, written

CAPACITY = 2048


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, CAPACITY).withColumnRenamed("id", "doc_id")


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of :func:`p7_assignment`, counted: documents, those whose pieces don't add up to their tokens, containers over
    their capacity or with overlapping pieces, documents split without need, and whether at most 2 % more containers than the
    least possible are used."""
    sizes = written(packing.token_counts(table(spark, sf_dir, "documents")))
    pieces = written(packing.pack(sizes, CAPACITY))
    own = pieces.groupBy("id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("n"))
    docs = sizes.join(own, "id", "left").agg(
        F.count("*").alias("documents"), F.sum(F.when(F.coalesce("got", F.lit(-1)) != F.col("n_tokens"), 1).otherwise(0)).alias("wrong_tokens"),
        F.sum(F.when((F.col("n") > 1) & (F.col("n_tokens") <= CAPACITY), 1).otherwise(0)).alias("split_in_vain"), F.ceil(F.sum("n_tokens") / CAPACITY).alias("_least"),
    )
    # Pieces stand end to end, so that the places used, the sum of sizes and the farthest end agree unless some overlap.
    held = pieces.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("n"))
    bins = held.agg(F.count("*").alias("_bins"), F.sum(F.when(F.col("end") > CAPACITY, 1).otherwise(0)).alias("over_capacity"), F.sum(F.when((F.col("used") != F.col("end")) | (F.col("places") != F.col("n")), 1).otherwise(0)).alias("overlaps"))
    return docs.crossJoin(bins).select("documents", "wrong_tokens", "split_in_vain", "over_capacity", "overlaps", (F.col("_bins") <= 1.02 * F.col("_least") + 1).alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = leakage.leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=12, max_edits=1)
    return windows.where("edits = 0").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(leakage.leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=12, max_edits=1))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passages of each item a document holds as they are: the part of :func:`p8_leaks` that SQL can state."""
    windows = leakage.leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=12, max_edits=1)
    return leakage.leaks(windows.where("edits = 0")).drop("near_windows")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_scores(table(spark, sf_dir, "documents")).where("smooth >= 0.5").select(F.col("id").alias("doc_id")).distinct()


def p9_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spam.spam_scores(table(spark, sf_dir, "documents"))
    return scores.groupBy(F.col("host").alias("repo")).agg(F.count("*").alias("documents"), F.sum(F.when(F.col("smooth") >= 0.5, 1).otherwise(0)).alias("spam"))


QUERIES = {f.__name__: f for f in (p7_assignment, p7_summary, p8_found, p8_leaks, p8_passages, p9_found, p9_hosts)}

_WINDOWS = r"""
    w AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS a FROM eval_items),
    passages AS (SELECT item_id, i - 1 AS place, array_to_string(a[i:i + 11], ' ') AS p FROM (SELECT item_id, a, unnest(range(1, len(a) - 10)) AS i FROM w WHERE len(a) >= 12)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents),
    searched AS (SELECT doc_id, array_to_string(a[i:i + 11], ' ') AS p FROM (SELECT doc_id, a, unnest(range(1, len(a) - 10)) AS i FROM d WHERE len(a) >= 12)),
    hits AS (SELECT DISTINCT doc_id, item_id, place FROM searched JOIN passages USING (p))"""

ORACLES = {
    "p7_summary": "SELECT count(*) AS documents, 0::BIGINT AS wrong_tokens, 0::BIGINT AS split_in_vain, 0::BIGINT AS over_capacity, 0::BIGINT AS overlaps, true AS tight FROM documents",
    "p8_found": f"WITH {_WINDOWS} SELECT DISTINCT doc_id, item_id FROM hits",
    "p8_passages": f"WITH {_WINDOWS} SELECT doc_id, item_id, count(*) AS exact_windows, min(place)::INT AS first_word, max(place)::INT AS last_word FROM hits GROUP BY 1, 2",
}
