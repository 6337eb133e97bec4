"""Evaluation texts leaking into training text: edit-distance search of item passages in documents.

Every passage of ``window`` consecutive words of an item is a query. Of a document, every window of that size is searched, and
every one of up to ``max_edits`` words more or fewer, so that words put in and left out count like words replaced. Windows are
embedded by the CGK random walk: a pointer moves along the window and, at each of 3 x its size steps, copies the word under it
and stays or advances by a random bit of the step and the word. Two windows at a small edit distance walk together most of the
way, so that their embeddings differ in few places, and equal windows have equal embeddings. Each repetition has its own walk
and samples ``sample`` of the places; windows that agree there are candidates. Repetitions are added until an edit distance
of ``max_edits`` is found with probability ``recall``, measured on passages with words replaced, put in and left out, each kind
by itself; where ``most`` repetitions don't reach it, that is an error and not a lower recall. Equal windows are always found.
Every candidate is then verified by its exact edit distance.

A window within ``max_edits`` of a passage holds at most that many words that no item has. Windows with more are passed over
before the embedding; that loses nothing and leaves few windows of a corpus.

Items are the small side: their texts travel to the tasks in blocks of at most ``block_words`` words, and each task builds the
block's index once. One block is searched at a time and its hits are written down before the next, so that neither the driver nor
a task ever holds more than one, whatever the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import written

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case."""
    return WORD.findall(text.lower())


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integers."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def embed(windows: np.ndarray, seed: int) -> np.ndarray:
    """The CGK embedding of the rows of ``windows`` (word numbers): 3 x as many columns, 0 beyond the end."""
    m, n = windows.shape
    padded = np.zeros((m, n + 1), np.int64)
    padded[:, :n] = windows
    out, at, rows = np.empty((m, 3 * n), np.int64), np.zeros(m, np.int64), np.arange(m)
    for j in range(3 * n):
        x = out[:, j] = padded[rows, at]
        at = np.minimum(at + (_mix(x.astype(np.uint64), seed * 1000 + j) & np.uint64(1)).astype(np.int64), n)
    return out


def keys(windows: np.ndarray, seed: int, sample: int) -> np.ndarray:
    """One bit-sampling hash of each window: its embedding at ``sample`` random places."""
    # Walks end after twice the window's length on average; places beyond hold the same 0 for most windows.
    places = np.sort(np.random.default_rng(seed).choice(2 * windows.shape[1], sample, replace=False))
    out = np.full(len(windows), seed, np.uint64)
    for column in embed(windows, seed)[:, places].T:
        out = _mix(out ^ column.astype(np.uint64), seed)
    return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact edit distance of each row of ``a`` to the same row of ``b``; all rows of a side are of one length."""
    m, n = a.shape
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (m, b.shape[1] + 1)).astype(np.int16).copy()
    for i in range(1, n + 1):
        before = row
        row = np.empty_like(before)
        row[:, 0] = i
        for j in range(1, b.shape[1] + 1):
            row[:, j] = np.minimum(np.minimum(before[:, j], row[:, j - 1]) + 1, before[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
    return row[:, -1]


def padded(windows: np.ndarray, size: int) -> np.ndarray:
    """``windows`` filled up with 0 to ``size`` columns."""
    out = np.zeros((len(windows), size), np.int64)
    out[:, : windows.shape[1]] = windows
    return out


@dataclass
class Index:
    """The windows of a block of items: words by number, windows, where they come from, and per repetition the sorted keys."""

    vocabulary: dict[str, int]
    windows: np.ndarray
    owners: list[list[tuple[str, int]]]
    tables: list[tuple[np.ndarray, np.ndarray]]
    sample: int
    max_edits: int

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """Pairs (row of ``found``, window of the index) that share a key in some repetition."""
        pairs = []
        for seed, (sorted_keys, order) in enumerate(self.tables, 1):
            k = keys(found, seed, self.sample)
            low, high = np.searchsorted(sorted_keys, k, "left"), np.searchsorted(sorted_keys, k, "right")
            n = high - low
            hit = np.repeat(np.arange(len(k)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            pairs.append(hit * len(self.windows) + order[place])
        return np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


KINDS = ("replaced", "put in", "left out")


def edited(windows: np.ndarray, edits: int, words_known: int, rng: np.random.Generator, kind: str) -> np.ndarray:
    """Windows with ``edits`` words replaced, put in or left out at random places, filled up with 0 to ``edits`` columns more."""
    out = np.zeros((len(windows), windows.shape[1] + edits), np.int64)
    for i, row in enumerate(windows.tolist()):
        for _ in range(edits):
            new = int(rng.integers(1, words_known + 2))
            if kind == "put in":
                row.insert(int(rng.integers(len(row) + 1)), new)
            elif kind == "left out":
                row.pop(int(rng.integers(len(row))))
            else:
                row[int(rng.integers(len(row)))] = new
        out[i, : len(row)] = row
    return out


def build_index(items: tuple[tuple[str, str], ...], window: int, max_edits: int, recall: float, sample: int, most: int = 64) -> Index:
    """The index of (id, text) items; items shorter than ``window`` words have no passage."""
    vocabulary: dict[str, int] = {}
    owners: dict[tuple[int, ...], list[tuple[str, int]]] = {}
    for item, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for p in range(len(numbers) - window + 1):
            owners.setdefault(tuple(numbers[p : p + window]), []).append((item, p))
    windows = padded(np.array(list(owners), np.int64).reshape(len(owners), window), window + max_edits)
    rng = np.random.default_rng(11)
    probe = windows[rng.permutation(len(windows))[:2000]]
    near = [edited(probe[:, :window], max_edits, len(vocabulary), rng, kind) for kind in KINDS if max_edits]
    missed, tables = [np.ones(len(probe), bool) for _ in near], []
    while len(windows) and (not tables or any(m.mean() > 1 - recall for m in missed)):
        if len(tables) == most:
            raise ValueError(f"a recall of {recall} isn't reached by {most} repetitions, but {[round(1 - float(m.mean()), 3) for m in missed]} for words {', '.join(KINDS)}: sample fewer places")
        seed = len(tables) + 1
        k = keys(windows, seed, sample)
        order = np.argsort(k, kind="stable")
        tables.append((k[order], order))
        own = keys(probe, seed, sample)
        for m, other in zip(missed, near, strict=True):
            m &= own != keys(other, seed, sample)
    return Index(vocabulary, windows, list(owners.values()), tables, sample, max_edits)


@lru_cache(maxsize=1)
def _index_of(*how) -> Index:
    """:func:`build_index`, kept by each worker, one at a time."""
    return build_index(*how)


def _search(items: tuple[tuple[str, str], ...], window: int, max_edits: int, recall: float, sample: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(items, window, max_edits, recall, sample, most)
        number = index.vocabulary.get
        for batch in batches:
            lengths, flat = [], []
            for text in batch.column(1):
                found = words(text.as_py()) if text.is_valid else []
                lengths.append(len(found))
                flat += map(number, found, [0] * len(found))
            numbers, ends = np.array(flat, np.int64), np.cumsum(lengths)
            foreign = np.concatenate([[0], np.cumsum(numbers == 0)])
            hits: dict[tuple[int, str, int, int], int] = {}
            for size in range(window - max_edits, window + max_edits + 1):
                if len(numbers) < size or not len(index.windows):
                    continue
                # A window that is k words short has used up k edits.
                starts = np.flatnonzero(foreign[size:] - foreign[:-size] <= max_edits - max(0, window - size))
                doc = np.searchsorted(ends, starts, "right")
                inside = starts + size <= ends[doc]
                starts, doc = starts[inside], doc[inside]
                # In bounded steps, so that one batch of nothing but item words fits in memory.
                for low in range(0, len(starts), 50_000):
                    s, d = starts[low : low + 50_000], doc[low : low + 50_000]
                    own = np.lib.stride_tricks.sliding_window_view(numbers, size)[s]
                    pairs = index.candidates(padded(own, window + max_edits))
                    a, b = pairs // len(index.windows), pairs % len(index.windows)
                    for cut in range(0, len(pairs), 100_000):
                        x, y = a[cut : cut + 100_000], b[cut : cut + 100_000]
                        edits = edit_distance(own[x], index.windows[y, :window])
                        for i in np.flatnonzero(edits <= max_edits).tolist():
                            at = int(d[x[i]])
                            place = int(s[x[i]]) - int(ends[at] - lengths[at])
                            for item, p in index.owners[y[i]]:
                                hit = (at, item, place, p)
                                hits[hit] = min(int(edits[i]), hits.get(hit, max_edits))
            cols = list(zip(*[(*hit, n) for hit, n in hits.items()], strict=True)) if hits else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                ["doc_id", "item_id", "doc_word", "item_word", "edits"],
            )

    return run


def leaked_windows(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    window: int = 12,
    max_edits: int = 1,
    recall: float = 0.95,
    sample: int = 8,
    most: int = 64,
    block_words: int = 500_000,
) -> DataFrame:
    """``(doc_id, item_id, doc_word, item_word, edits)``: windows of documents within ``max_edits`` edits of a passage of an item.

    Places count words from 0. All windows with 0 edits are found, those with up to ``max_edits`` with probability ``recall``
    each. Null texts, items of fewer than ``window`` words and documents of fewer than ``window - max_edits`` give nothing. Repeated
    items and documents are each reported.
    """
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, doc_word int, item_word int, edits int"
    found: list[DataFrame] = []

    def search(block: list[tuple[str, str]]) -> DataFrame:
        return named.mapInArrow(_search(tuple(block), window, max_edits, recall, sample, most), schema)

    block, size = [], 0
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        n = len(words(r["t"]))
        if block and size + n > block_words:
            found.append(written(search(block)))
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    last = search(block)
    for part in found:
        last = last.unionByName(part)
    return last


def leaks(windows: DataFrame) -> DataFrame:
    """``(doc_id, item_id, exact_windows, near_windows, first_word, last_word)`` per document and item: how many of the item's passages it
    holds as they are, and how many only with edits."""
    best = windows.groupBy("doc_id", "item_id", "item_word").agg(F.min("edits").alias("edits"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return best.groupBy("doc_id", "item_id").agg(count(F.col("edits") == 0).alias("exact_windows"), count(F.col("edits") > 0).alias("near_windows"), F.min("item_word").alias("first_word"), F.max("item_word").alias("last_word"))
