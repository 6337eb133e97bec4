"""Keyword-stuffed pages, link lists and product tags among commits.

1. Two views of every document's page-like part in one pass over the texts: its texture, and a weak label from the forms of its
   lines where a rule is clear.
2. Bagged decision trees on the texture of a bounded sample of weakly labelled documents. The rules' features are held out from
   them, so that the trees can't copy a rule; they find what the labelled pages have in common, and pages that the rules missed.
3. The trees' score of every document, smoothed by the spam rate of the other documents of its host (the repository), shrunk
   towards the rate of the corpus. Host rates are algebraic sums, so a host with a third of all documents is combined
   map-side; only hosts travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.llm.page_features import TEXTURE, views
from quellgraph.llm.trees import Tree, fit, predict
from quellgraph.runtime import written


def page_features(documents: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "repo") -> DataFrame:
    """``(id, host, texture, label, block)`` per document; a null text has no page-like part."""
    named = documents.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    kinds = {c: named.schema[c].dataType.simpleString() for c in ("id", "host")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [views(t.as_py()) for t in batch.column(2)]
            made = [pa.array([v[i] for v in seen], t) for i, t in enumerate((pa.list_(pa.float32()), pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "host", "texture", "label", "block"])

    return named.mapInArrow(run, f"id {kinds['id']}, host {kinds['host']}, texture array<float>, label int, block float")


LIST_WORDS = 10.0


def train(rows: DataFrame, *, per_class: int = 5000, seed: int = 7, **options) -> list[Tree]:
    """Trees from at most about ``per_class`` documents of each of three strata: labelled spam, labelled other with at least
    ``LIST_WORDS`` words in a row outside sentences, and the rest of the others. A documented bound, sampled by hash over all rows."""
    strata = rows.where("label >= 0").withColumn("stratum", F.when(F.col("label") == 1, 2).when(F.col("block") >= LIST_WORDS, 1).otherwise(0))
    counts = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("stratum") == k, int((1 << 20) * min(1.0, per_class / n))).otherwise(share)
    picked = strata.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share)
    x, y = [], []
    for r in picked.select("texture", "label").orderBy(F.xxhash64("id"), "id").toLocalIterator():
        x.append(r["texture"])
        y.append(r["label"])
    return fit(np.array(x).reshape(len(x), len(TEXTURE)), np.array(y), seed=seed, **options)


def scored(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """``(id, host, score)``: the trees' mean vote."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "host")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(TEXTURE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(predict(trees, x), pa.float64())], ["id", "host", "score"])

    return rows.select("id", "host", "texture").mapInArrow(run, f"id {kinds['id']}, host {kinds['host']}, score double")


def smoothed(scores: DataFrame, *, weight: float = 0.15, prior: float = 20.0) -> DataFrame:
    """``(id, host, score, host_rate, smooth)``: the score moved by ``weight`` of the log odds of the host against the corpus.

    ``host_rate`` is of the host's other documents, with ``prior`` documents at the corpus' rate added; a null host has none.
    """
    total = scores.agg(F.avg("score").alias("rate")).first()["rate"] or 0.0
    rate = min(max(total, 1e-6), 1 - 1e-6)
    hosts = scores.where("host is not null").groupBy("host").agg(F.sum("score").alias("_s"), F.count("*").alias("_n"))
    joined = scores.join(hosts, "host", "left")
    own = (F.col("_s") - F.col("score") + prior * rate) / (F.col("_n") - 1 + prior)
    host_rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce(own, F.lit(rate))))
    odds = lambda c: F.log(c / (1 - c))
    clear = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("score")))
    moved = odds(clear) + weight * (odds(host_rate) - odds(F.lit(rate)))
    return joined.select("id", "host", "score", host_rate.alias("host_rate"), (1 / (1 + F.exp(-moved))).alias("smooth"))


def spam_scores(documents: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "repo", **options) -> DataFrame:
    """``(id, host, score, host_rate, smooth)`` for every document; spam where ``smooth`` is at least 0.5.

    Repeated documents are scored each; empty tables give no rows; columns other than those named don't matter.
    """
    rows = written(page_features(documents, id_col, text, host))
    return smoothed(written(scored(rows, train(rows, **options))))
