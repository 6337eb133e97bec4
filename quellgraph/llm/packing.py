"""Items into containers of fixed capacity: sum-of-squares online packing.

The state of a packer is its level array: for each fill level, how many partly filled containers stand at it. An item goes to
the level where, afterwards, the sum of the squared counts is smallest; a new container is level 0 and doesn't count. Items are
numbered in the order of their ids and dealt to shards by hash, and each shard is packed by one task. On sizes that don't add up
to the capacity the rule leaves many containers with room; so the items of containers less than nine tenths full are packed
once more, largest first into the fullest container that takes them, and the better packing of the two stays; then those of
containers below 96 and below 99 %. Containers of
different shards that are left at most half full are packed again as items, until one shard holds them. Only ids and sizes
take part, never texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import cut, global_index, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary above is used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text: str = "text", *, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(id, n_tokens)`` of whole texts; 0 for null and empty ones."""
    named = documents.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(1)], pa.int64())], ["id", "n_tokens"])

    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, n_tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container and the offset in it of each item, in order of arrival; sizes from 1 to ``capacity``."""
    twice = np.zeros(capacity + 1, np.int64)  # 2 x count by level; levels 0 and capacity stay 0
    taken = np.full(capacity + 1, -(1 << 40), np.int64)  # the same where a container stands, else out of reach
    taken[0] = 0
    cost = np.empty(capacity + 1, np.int64)
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]
    containers, offsets, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        last = capacity - s
        c = cost[: last + 1]
        np.subtract(twice[s:], taken[: last + 1], out=c)
        # Both counts change by one: +1 each, but for a new container there is no level left behind, for a full one none reached.
        c[0] -= 1
        c[last] -= 1
        level = last - int(c[::-1].argmin())  # the fullest of the best
        if level:
            k = standing[level].pop()
            twice[level] -= 2
            taken[level] = twice[level] or -(1 << 40)
        else:
            k, opened = opened, opened + 1
        containers[i], offsets[i] = k, level
        level += s
        if level < capacity:
            standing[level].append(k)
            twice[level] += 2
            taken[level] = twice[level]
    return containers, offsets


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each item: the largest first, each into the fullest container that takes it."""
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, bool)  # levels with a container
    containers, offsets, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = there[capacity - s :: -1]
        back = int(fits.argmax())
        level = capacity - s - back if fits[back] else 0
        if level:
            k = standing[level].pop()
            there[level] = bool(standing[level])
        else:
            k, opened = opened, opened + 1
        containers[i], offsets[i] = k, level
        level += s
        if level < capacity:
            standing[level].append(k)
            there[level] = True
    return containers, offsets


def pack_shard(sizes: np.ndarray, capacity: int, full: tuple[float, ...] = (0.9, 0.96, 0.99)) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sum_of_squares`, with the items of containers below each share ``full`` of the capacity packed once more if that takes fewer."""
    containers, offsets = sum_of_squares(sizes, capacity)
    for share in full:
        fill = np.bincount(containers, weights=sizes)
        poor = np.flatnonzero(fill[containers] < share * capacity)
        if not len(poor):
            continue
        k, at = best_fit_decreasing(sizes[poor], capacity)
        names = np.unique(containers[poor])
        if k.max() + 1 < len(names):
            containers[poor], offsets[poor] = names[k], at
    return containers, offsets


def _pack(items: DataFrame, capacity: int, shards: int, stage: int) -> DataFrame:
    """``items`` (key, size) with ``bin`` and ``offset``; bins are named by stage, shard and number."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        k, offset = pack_shard(part["size"].to_numpy(), capacity)
        shard = part["shard"].iloc[0]
        return pd.DataFrame({"key": part["key"], "size": part["size"], "bin": [f"{stage}-{shard}-{x}" for x in k], "offset": offset})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(stage)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, f"key {items.schema['key'].dataType.simpleString()}, size bigint, bin string, offset bigint")


def pack(sizes: DataFrame, capacity: int = 2048, *, shard_items: int = 100_000) -> DataFrame:
    """``(id, piece, n_tokens, container_id, offset)`` for every piece of every item of ``sizes`` (id, n_tokens).

    Items up to ``capacity`` are one piece, number 1, and are never split. Longer ones are cut into full containers and a rest,
    which is packed like any other item. Items of size 0 take no room: container and offset are null. An id that occurs twice
    is two items. The result follows from the ids and sizes alone, not from their layout in files.
    """
    sizes = global_index(written(sizes.select("id", "n_tokens")), ["id", "n_tokens"], "_u")  # sorting by ranges reads it twice
    full = sizes.where(F.col("n_tokens") >= capacity).select("id", "_u", F.posexplode(F.sequence(F.lit(1), F.floor(F.col("n_tokens") / capacity).cast("int"))).alias("_i", "piece"))
    full = full.select("id", "piece", F.lit(capacity).cast("bigint").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "_u", "piece").alias("container_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = F.col("n_tokens") % capacity
    items = sizes.select("id", "n_tokens", F.col("_u").alias("key"), rest.alias("size"), (F.floor(F.col("n_tokens") / capacity) + 1).cast("int").alias("piece"))
    n = items.where("size > 0").count()
    packed = cut(_pack(items.where("size > 0").select("key", "size"), capacity, max(1, -(-n // shard_items)), 0))
    stage, shards = 0, -(-n // shard_items)
    while shards > 1:
        stage += 1
        levels = packed.groupBy("bin").agg(F.sum("size").alias("size"))
        low = cut(levels.where(F.col("size") <= capacity // 2).select(F.col("bin").alias("key"), "size"))
        shards = -(-low.count() // shard_items)
        if not shards:
            break
        step = _pack(low, capacity, shards, stage).select(F.col("key").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        packed = cut(packed.join(step, "bin", "left").select("key", "size", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset")))
    placed = items.where("size > 0 or n_tokens = 0").join(packed.select("key", "bin", "offset"), "key", "left")
    return full.unionByName(placed.select("id", "piece", F.col("size").alias("n_tokens"), F.col("bin").alias("container_id"), "offset"))
