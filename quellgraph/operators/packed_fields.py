"""Several values packed in one field: split by the dialect with the minimum description length.

A dialect is a delimiter (one character, any of them, or none) and a quote character. What a dialect makes of a field depends
only on the field's skeleton, in which every run of letters and digits is one ``w``; so each distinct skeleton is parsed once
with each dialect that its characters allow, and each parse is priced in bits. A value costs the code length of its shape, a
delimiter left inside an unquoted value is spelt out, and a dialect of several delimiters pays at every boundary for saying
which one. Code lengths come from counting shapes over all fields of the table, first over all candidate parses in equal
parts, then over the cheapest parse of each field. The code book is a table that is joined, whatever its size: no shape is left
out of it, and each pays for its own spelling. Every field is finally parsed with the cheapest dialect of its skeleton.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import spread_join, written

DELIMITERS = (",", ";", "|", "\t", "\n", " ", "；", "，", "、")
QUOTES = ('"', "'")
BRACKETS = {"[": "]", "{": "}", "(": ")"}
SPELL_BITS = 6.0

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(m: re.Match) -> str:
    x = m[1]
    return chr(int(x[1:], 16)) if len(x) > 1 else _CONTROL.get(x, x)


def _pattern(delims: str, quote: str) -> re.Pattern:
    if not delims:
        bare, end = r"[\s\S]+", r"\Z"
    else:
        inside = "".join(r"\s" if c == "\x00" else re.escape(c) for c in delims)
        bare, end = f"[^{inside}]+", rf"(?=[{inside}]|\Z)"
    if not quote:
        return re.compile(f"()({bare})")
    q = re.escape(quote)
    return re.compile(rf"\s*{q}((?:[^{q}\\]|\\[\s\S]|{q}{q})*){q}\s*{end}|({bare})")


class Splitter:
    """Parses fields, or their skeletons, under every dialect."""

    def __init__(self, delimiters: tuple[str, ...] = DELIMITERS, quotes: tuple[str, ...] = QUOTES):
        self.delimiters, self.quotes = delimiters, quotes
        self.any = "".join(c for c in delimiters if not c.isspace()) + ("\x00" if any(c.isspace() for c in delimiters) else "")
        self.any_bits = math.log2(max(2, len(delimiters)))
        self.dialects = [(d, q) for d in (*delimiters, self.any, "") for q in (*quotes, "")]
        self.number = {x: i for i, x in enumerate(self.dialects)}
        self.patterns = {x: _pattern(*x) for x in self.dialects}
        self.names = [json.dumps(["any" if d == self.any else d, q], ensure_ascii=False) for d, q in self.dialects]
        self.every = re.compile("[" + "".join(r"\s" if c == "\x00" else re.escape(c) for c in self.any) + "]")
        self.runs = re.compile(f"[{''.join(re.escape(c) for c in delimiters)}\\s]+")

    def body(self, raw: str) -> str:
        s = raw.strip()
        while len(s) > 1 and BRACKETS.get(s[0]) == s[-1]:
            s = s[1:-1].strip()
        return s

    def bare(self, body: str, delim: str) -> list[str]:
        """Unquoted values."""
        parts = [body] if not delim else self.every.split(body) if delim == self.any else body.split(delim)
        return [v for v in map(str.strip, parts) if v]

    def values(self, body: str, dialect: tuple[str, str]) -> list[str]:
        quote = dialect[1]
        if not quote:
            return self.bare(body, dialect[0])
        out = []
        for quoted, bare in self.patterns[dialect].findall(body):
            v = bare
            if quoted:
                v = _ESCAPE.sub(_unescape, quoted) if "\\" in quoted else quoted
                v = v.replace(quote + quote, quote)
            v = v.strip()
            if v:
                out.append(v)
        return out

    def priced(self, body: str, dialect: tuple[str, str], present: str) -> tuple[list[str], float]:
        """The values, and the bits of what isn't in their shapes: delimiters that stay inside unquoted values, and which delimiter stands at each boundary."""
        delim, quote = dialect
        out = self.values(body, dialect)
        if delim != self.any:
            inside = "\0".join([b for _, b in self.patterns[dialect].findall(body) if b] if quote else out)
            return out, SPELL_BITS * sum(inside.count(d) for d in present if d != delim)
        extra = 0.0
        if len(out) > 1:
            kinds = self.kinds(body)
            for v in out if quote else ():
                if any(d in v for d in present):
                    kinds.subtract(self.kinds(v))
            counts = [n for n in kinds.values() if n > 0]
            extra = self.any_bits * len(counts) + (math.lgamma(sum(counts) + 1) - sum(math.lgamma(n + 1) for n in counts)) / math.log(2)
        return out, extra

    def kinds(self, s: str) -> Counter[str]:
        return Counter(run.strip()[:1] or run[0] for run in self.runs.findall(s))

    def candidates(self, body: str) -> list[tuple[tuple[str, str], list[str], float]]:
        """All parses. At equal price the first is taken: any delimiter, one, none; quoted before not."""
        present = "".join(d for d in self.delimiters if d in body)
        delims = [*present, ""]
        if len(present) > 1 or present.isspace():
            delims.insert(0, self.any)
        quotes = [q for q in self.quotes if q in body]
        return [((d, q), *self.priced(body, (d, q), present)) for d in delims for q in (*quotes, "")]


#: Shapes up to which the code book is sent to the tasks, 16 bytes each. A larger one is joined, with the same result.
BOOK_ROWS = 500_000
_SHAPES = "array<struct<h:bigint,size:int,k:int>>"


def parses(skeletons: DataFrame, delimiters: tuple[str, ...] = DELIMITERS, quotes: tuple[str, ...] = QUOTES) -> DataFrame:
    """``(h1, h2, n, candidates)``: all candidate parses of each of ``skeletons`` (h1, h2, skeleton, n); no row for blank ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(delimiters, quotes)
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            take, dialects, extras, h, size, k = [], [], [], [], [], []
            parses_end, shapes_end = [0], [0]
            for i, raw in enumerate(batch.column(2).to_pylist()):
                body = splitter.body(raw)
                if not body:
                    continue
                take.append(i)
                for dialect, values, extra in splitter.candidates(body):
                    for v, times in Counter(values).items():
                        v = _WORD.sub("w", v) if "ww" in v else v
                        h.append(digest(v) - (1 << 63))
                        size.append(len(v))
                        k.append(times)
                    dialects.append(splitter.number[dialect])
                    extras.append(extra)
                    shapes_end.append(len(h))
                parses_end.append(len(dialects))
            shapes = pa.ListArray.from_arrays(pa.array(shapes_end, pa.int32()), pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(size, pa.int32()), pa.array(k, pa.int32())], ["h", "size", "k"]))
            found = pa.StructArray.from_arrays([pa.array(dialects, pa.int32()), pa.array(extras, pa.float64()), shapes], ["dialect", "extra", "shapes"])
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in (0, 1, 3)], pa.ListArray.from_arrays(pa.array(parses_end, pa.int32()), found)], ["h1", "h2", "n", "candidates"])

    return skeletons.mapInArrow(run, f"h1 bigint, h2 bigint, n bigint, candidates array<struct<dialect:int,extra:double,shapes:{_SHAPES}>>")


def code_book(uses: DataFrame) -> tuple[DataFrame, float, int]:
    """``(h, weight, bits)`` per shape of ``uses`` (h, size, weight), the bits of a shape that isn't there but for its spelling, and the number of shapes.

    An entry has to be spelt out once; its uses share that."""
    book = written(uses.groupBy("h").agg(F.sum("weight").alias("weight"), F.max("size").alias("size")))
    n, total = book.agg(F.count("*"), F.sum("weight")).first()
    total = (total or 0.0) + 0.5
    return book.select("h", "weight", (-F.log2(F.col("weight") / total) + SPELL_BITS * F.col("size") / F.col("weight")).alias("bits")), math.log2(total / 0.5), n


def _cost(c: float | np.ndarray) -> np.ndarray:
    """Prices to 1/1024 bit, so that the order of adding doesn't matter."""
    return np.floor(c * 1024 + 0.5).astype(np.int64)


def cheapest(found: DataFrame, book: tuple[DataFrame, float, int], book_rows: int = BOOK_ROWS) -> DataFrame:
    """``(h1, h2, n, dialect, shapes)``: the cheapest parse of each skeleton, the first among equals."""
    lengths, unseen, n_shapes = book
    schema = f"h1 bigint, h2 bigint, n bigint, dialect int, shapes {_SHAPES}"
    if n_shapes > book_rows:
        return _cheapest_joined(found, lengths, unseen)
    known = lengths.select("h", "bits").orderBy("h").toArrow()
    hashes, bits = known.column("h").to_numpy(), known.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cands = batch.column(3)
            flat = cands.flatten()
            shapes, extra = flat.field("shapes"), flat.field("extra").to_numpy()
            each = shapes.flatten()
            h, size, k = (each.field(c).to_numpy() for c in ("h", "size", "k"))
            price = unseen + SPELL_BITS * size
            if len(hashes) and len(h):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                price = np.where(hashes[at] == h, bits[at], price)
            sums = np.concatenate([[0.0], np.cumsum(k * price)]) if len(h) else np.zeros(1)
            ends = np.cumsum(shapes.value_lengths().to_numpy()) if len(flat) else np.zeros(0, np.int64)
            starts = ends - shapes.value_lengths().to_numpy() if len(flat) else ends
            rows = cands.value_lengths().to_numpy()
            first = np.cumsum(rows) - rows
            # Sums of few terms, taken apart from a running sum: rounded like the others to 1/1024 bit.
            cost = _cost(sums[ends] - sums[starts] + extra) if len(flat) else np.zeros(0, np.int64)
            rank = np.arange(len(cost)) - np.repeat(first, rows)
            key = cost * 64 + rank
            best = first + (np.minimum.reduceat(key, first) % 64 if len(key) else 0)
            picked = flat.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (0, 1, 2)], picked.field("dialect"), picked.field("shapes")], ["h1", "h2", "n", "dialect", "shapes"])

    return found.mapInArrow(run, schema)


def _cheapest_joined(found: DataFrame, lengths: DataFrame, unseen: float) -> DataFrame:
    """:func:`cheapest` for code books of any size."""
    each = found.select("h1", "h2", F.posexplode("candidates").alias("rank", "c")).select("h1", "h2", "rank", "c.extra", F.explode_outer("c.shapes").alias("s")).select("h1", "h2", "rank", "extra", "s.*")
    priced = spread_join(each, lengths, ["h"], "weight", F.xxhash64("h1", "rank"))
    bits = F.coalesce(F.col("k") * F.coalesce(F.col("bits"), unseen + SPELL_BITS * F.col("size")), F.lit(0.0))
    cost = priced.groupBy("h1", "h2", "rank").agg((F.sum(bits) + F.max("extra")).alias("cost"))
    best = cost.groupBy("h1", "h2").agg(F.min(F.floor(F.col("cost") * 1024 + 0.5) * 64 + F.col("rank")).alias("b"))
    picked = found.join(best, ["h1", "h2"]).withColumn("c", F.get("candidates", F.pmod("b", F.lit(64)).cast("int")))
    return picked.select("h1", "h2", "n", "c.dialect", "c.shapes")


def split_packed(df: DataFrame, id_col: str, fields: list[str], *, delimiters: tuple[str, ...] = DELIMITERS, quotes: tuple[str, ...] = QUOTES, rounds: int = 2, book_rows: int = BOOK_ROWS) -> DataFrame:
    """One row ``(id, field_name, pos, value, dialect)`` for each value packed in ``fields``.

    ``pos`` counts the values of a field from 1. Values are bare: unquoted, unescaped, trimmed. Null and blank fields and
    empty places give no row; repeated values and repeated rows stay. A null id stays null. Other columns of ``df``, whatever
    their names, aren't touched. Fields are parsed whole, of any length. An empty table gives no rows.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw")) for f in fields])
    packed = df.select(F.col(id_col).alias("id"), F.inline(each)).where("raw is not null")
    packed = packed.withColumn("skeleton", F.regexp_replace("raw", r"[\p{L}\p{N}]+", "w"))
    hashes = [F.xxhash64("skeleton").alias("h1"), F.xxhash64(F.lit(7), "skeleton").alias("h2")]
    skeletons = packed.groupBy("skeleton").agg(F.count("*").alias("n")).select(*hashes, "skeleton", "n")
    found = written(parses(skeletons, delimiters, quotes))
    share = F.col("n") / F.size("candidates")
    uses = found.select(F.inline(F.flatten(F.transform("candidates", lambda c: c["shapes"]))), share.alias("w"))
    chosen = found
    for _ in range(rounds):
        chosen = written(cheapest(found, code_book(uses.select("h", "size", (F.col("k") * F.col("w")).alias("weight"))), book_rows))
        uses = chosen.select(F.inline("shapes"), F.col("n").alias("w"))
    named = spread_join(packed.select("id", "field_name", "raw", *hashes), chosen.select("h1", "h2", "dialect", "n"), ["h1", "h2"], "n", F.xxhash64("id", "field_name")).select("id", "field_name", "raw", "dialect")
    id_type = packed.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(delimiters, quotes)
        for batch in batches:
            take, places, values, names = [], [], [], []
            for i, (raw, d) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                body = splitter.body(raw) if d is not None else ""
                if body:
                    some = splitter.values(body, splitter.dialects[d])
                    n = len(some)
                    take += [i] * n
                    places += range(1, n + 1)
                    values += some
                    names += [splitter.names[d]] * n
            at = pa.array(take, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(values, pa.string()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "field_name", "pos", "value", "dialect"])

    return named.mapInArrow(emit, f"id {id_type}, field_name string, pos int, value string, dialect string")
