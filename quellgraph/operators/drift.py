"""Schemas that drift between the files of a feed: fingerprints, migration steps and one consistent table.

Every file gets a fingerprint of its paths and types. Over the files of a feed in order, the first and last file of each path
and type are algebraic aggregates, so that a feed with a third of all files is combined map-side like any other, and every
change is read off them: paths added, removed and renamed, and types that changed for good. Each change is a step
``(feed, file, kind, path, new path)``.

One target schema holds for all feeds: every path that ever holds a scalar, by its oldest name in any feed, with the type
that most files have there. Each file is routed through the steps of its feed, the latest first: renames back, then defaults for
paths that it lacks, then casts to the target types; what was applied and what couldn't be cast is recorded with the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quellgraph.operators.json_walk import fields_of
from quellgraph.runtime import cut, global_index, spread_join, written


def _parent(c: str) -> F.Column:
    """The path of the object that holds ``c``; null at the root. Names are compared as they are, so a dot in a name counts as a level."""
    return F.when(F.col(c).contains("."), F.regexp_replace(c, r"\.[^.]*$", ""))


def read_files(df: DataFrame, *, feed: str = "feed_id", file_id: str = "file_id", order: str = "exported_at", content: str = "content", values: bool = False, keep: list[str] = ()) -> DataFrame:
    """Distinct files ``(feed, file_id, at, *keep, fields, fingerprint, idx)``; ``idx`` numbers all files by feed, ``at``, file_id.

    Files without feed or id are left out, those delivered twice count once (one id with two contents is two files), a null time
    comes first. Each file is walked once and kept in the shared folder, as several aggregates read it.
    """
    named = df.select(F.col(feed).alias("feed"), F.col(file_id).alias("file_id"), F.col(order).alias("at"), *keep, F.col(content).alias("content")).where("feed is not null and file_id is not null")
    named = named.withColumn("_h", F.xxhash64("content"))
    index = global_index(named.select("feed", "at", "file_id", "_h").distinct(), ["feed", "at", "file_id", "_h"]).select("file_id", "_h", "idx")
    walked = fields_of(named.distinct(), ["feed", "file_id", "at", *keep, "_h"], "content", values=values)
    prints = walked.withColumn("fingerprint", F.xxhash64(F.transform("fields", lambda f: F.struct(f["path"], f["types"]))))
    return written(prints.join(index, ["file_id", "_h"]).drop("_h"))


def changes(files: DataFrame) -> DataFrame:
    """The steps ``(feed, idx, file_id, change_kind, field_path, new_path)`` of :func:`read_files`' files.

    Of the paths present in two or more files, all of them consecutive: ``added`` at the first if two files of the feed precede
    it, ``removed`` at the file after the last if two follow the last; neither where the parent path has the same fate at the
    same file; one of each under one parent at one file is a ``renamed``. ``type``: of any path, over the files where it has a
    type, exactly one type each, changing once, with at least two files on both sides.
    """
    head = files.select("feed", "idx", "file_id")
    bounds = head.groupBy("feed").agg(F.min("idx").alias("feed_first"), F.max("idx").alias("feed_last"))
    seen = files.select("feed", "idx", F.inline("fields"))
    by_type = seen.groupBy("feed", "path", "types").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    # At most 32 sets of types per path: this list can't grow.
    paths = by_type.groupBy("feed", "path").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("types") > 0, F.struct("first", "last", "n", "types")))).alias("typed"),
    )
    paths = cut(paths.join(bounds, "feed"))
    a, b = F.get("typed", F.lit(0)), F.get("typed", F.lit(1))
    single = F.forall("typed", lambda t: F.bit_count(t["types"]) == 1)
    retyped = paths.where((F.size("typed") == 2) & single).where((a["last"] < b["first"]) & (a["n"] >= 2) & (b["n"] >= 2))
    retyped = retyped.select("feed", b["first"].alias("idx"), F.lit("type").alias("change_kind"), F.col("path").alias("field_path"), F.lit("").alias("new_path"))

    run = paths.where("n >= 2 and last - first + 1 = n").withColumn("parent", _parent("path"))
    moves = run.select(
        "feed", "path", "parent",
        F.explode(F.array_compact(F.array(
            F.when(F.col("first") - F.col("feed_first") >= 2, F.struct(F.lit("added").alias("kind"), F.col("first").alias("idx"))),
            F.when(F.col("feed_last") - F.col("last") >= 2, F.struct(F.lit("removed").alias("kind"), (F.col("last") + 1).alias("idx"))),
        ))).alias("m"),
    ).select("feed", "path", "parent", "m.kind", "m.idx")
    above = moves.select("feed", "kind", "idx", F.col("path").alias("parent"))
    moves = moves.withColumn("parent", F.coalesce("parent", F.lit(""))).join(above, ["feed", "kind", "idx", "parent"], "left_anti")
    per_place = moves.groupBy("feed", "idx", "parent").agg(
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("added", "removed")], *[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("added", "removed")]
    )
    swaps = per_place.where("n_added = 1 and n_removed = 1")
    renamed = swaps.select("feed", "idx", F.lit("renamed").alias("change_kind"), F.col("removed").alias("field_path"), F.col("added").alias("new_path"))
    plain = moves.join(swaps.select("feed", "idx", "parent"), ["feed", "idx", "parent"], "left_anti")
    plain = plain.select("feed", "idx", F.col("kind").alias("change_kind"), F.col("path").alias("field_path"), F.lit("").alias("new_path"))
    steps = plain.unionByName(renamed).unionByName(retyped)
    return steps.join(head.select("idx", "file_id"), "idx").select("feed", "idx", "file_id", "change_kind", "field_path", "new_path")


def _back(path: F.Column, step: F.Column) -> F.Column:
    """``path`` before a rename, whether the renamed field is the path's own or one above it."""
    old, new = step["field_path"], step["new_path"]
    return F.when(path == new, old).when(path.startswith(F.concat(new, F.lit("."))), F.concat(old, F.substring(path, F.length(new) + 1, F.length(path)))).otherwise(path)


#: The scalar types and their bits in :mod:`json_walk`.
SCALARS = {"string": 1, "number": 2, "boolean": 4}


def routed(files: DataFrame, steps: DataFrame) -> DataFrame:
    """``files`` with ``version``, the number of steps of the feed up to the file, and ``named``, the paths that hold scalars under their
    names at the start of the feed: (path, was, types, items). A feed's files are spread, however many there are."""
    renames = F.collect_list(F.when(F.col("change_kind") == "renamed", F.struct("idx", "field_path", "new_path")))
    per_feed = steps.groupBy("feed").agg(F.sort_array(renames, asc=False).alias("renames"), F.sort_array(F.collect_list("idx")).alias("at_steps"))  # a few steps per path that a feed ever had
    load = files.groupBy("feed").agg(F.count("*").alias("load"))
    out = spread_join(files, load.join(per_feed, "feed"), ["feed"], "load", F.xxhash64("file_id"))
    none = F.array().cast("array<struct<idx:bigint,field_path:string,new_path:string>>")
    out = out.withColumn("_own", F.filter(F.coalesce("renames", none), lambda s: s["idx"] <= F.col("idx")))
    held = F.filter("fields", lambda f: F.size(f["items"]) > 0)
    named = F.transform(held, lambda f: F.struct(F.aggregate(F.col("_own"), f["path"], lambda p, s: _back(p, s)).alias("path"), f["path"].alias("was"), f["types"].alias("types"), f["items"].alias("items")))
    version = F.coalesce(F.size(F.filter("at_steps", lambda i: i <= F.col("idx"))), F.lit(0))
    return out.withColumn("named", named).withColumn("version", version).drop("renames", "at_steps", "_own", "fields")


def path_uses(named: DataFrame) -> DataFrame:
    """``(path, n_files, string, number, boolean)``: how many files hold the path, and with which scalar types."""
    n = [F.sum(F.when(F.col("types").bitwiseAND(bit) > 0, 1).otherwise(0)).alias(t) for t, bit in SCALARS.items()]
    return named.select(F.inline("named")).groupBy("path").agg(F.count("*").alias("n_files"), *n)


def apart(files: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Those of ``pairs`` of paths that no file holds both of."""
    out = []
    for low in range(0, len(pairs), 200):
        some = pairs[low : low + 200]
        both = [F.max(F.arrays_overlap("p", F.array(F.lit(a))) & F.arrays_overlap("p", F.array(F.lit(b)))).alias(f"b{i}") for i, (a, b) in enumerate(some)]
        row = files.select(F.transform("fields", lambda f: f["path"]).alias("p")).agg(*both).first()
        out += [x for x, held in zip(some, row, strict=True) if not held]
    return out


def target_schema(uses: list[Row], renames: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """The target type by path, and the path by lower-cased name, for all feeds.

    ``renames`` (old, new) of one feed hold in all of them, and paths that differ in case only are one, in the spelling of most files. The type is the scalar type that most files have, the first of ``SCALARS`` among equals.
    """
    old = {new.lower(): was for was, new in sorted(renames, reverse=True)}

    def root(path: str) -> str:
        seen = {path.lower()}
        while True:
            parts = path.split(".")
            found = next((i for i in range(1, len(parts) + 1) if ".".join(parts[:i]).lower() in old), 0)
            if found:
                path = ".".join([old[".".join(parts[:found]).lower()], *parts[found:]])
            if not found or path.lower() in seen:  # renamed there and back: the smallest name of the circle
                return path if not found else min(seen)
            seen.add(path.lower())

    groups: dict[str, list[Row]] = {}
    for u in uses:
        groups.setdefault(root(u["path"]).lower(), []).append(u)
    types, names = {}, {}
    for low, members in sorted(groups.items()):
        like = [u for u in members if u["path"].lower() == low]
        name = max(like, key=lambda u: (u["n_files"], u["path"]))["path"] if like else root(members[0]["path"])
        types[name] = max(SCALARS, key=lambda t: (sum(u[t] for u in members), -SCALARS[t]))
        names |= {u["path"].lower(): name for u in members}
    return types, names


def _cast(text: str, kind: str) -> object:
    """``text`` in the type ``kind``; raises ValueError where it isn't one. Numbers from true and false are 1 and 0."""
    if kind == "string":
        return text
    if kind == "number":
        return float({"true": "1", "false": "0"}.get(text, text))
    low = text.strip().lower()
    if low in ("true", "1", "yes", "false", "0", "no"):
        return low in ("true", "1", "yes")
    raise ValueError(text)


def consistent(files: DataFrame, steps: DataFrame, *, keep: list[str] = (), defaults: dict[str, list[str]] | None = None, max_paths: int = 5_000) -> DataFrame:
    """One row ``(feed, file_id, *keep, version, fingerprint, data, applied, uncast)`` per file: one table for all feeds.

    ``data`` has a field for every path of :func:`target_schema`, a list of its type: absent paths have their default, else null; a
    lone value is a list of one; where two paths of a file end up under one name, their values are joined. ``applied`` lists the
    renames, casts and defaults of the file; ``uncast`` the (path, value) that couldn't be cast, which aren't in ``data``. Needs files
    read with ``values=True``. What one feed renamed is one path in all feeds, unless some file holds both: then the two only changed
    places there by chance. The schema is the only thing collected; more than ``max_paths`` paths are an error.
    """
    named = written(routed(files, steps).select("feed", "file_id", *keep, "version", "fingerprint", "named"))
    uses = path_uses(named).limit(max_paths + 1).collect()
    pairs = [tuple(r) for r in steps.where("change_kind = 'renamed'").select("field_path", "new_path").distinct().limit(max_paths + 1).collect()]
    if max(len(uses), len(pairs)) > max_paths:
        raise ValueError(f"more than {max_paths} paths; raise max_paths or split the feeds")
    target, names = target_schema(uses, apart(files, pairs))
    default = {p: [_cast(x, target[p]) for x in v] for p, v in (defaults or {}).items() if p in target}
    kinds = {"string": (pa.string(), "string"), "number": (pa.float64(), "double"), "boolean": (pa.bool_(), "boolean")}
    bits = {bit: t for t, bit in SCALARS.items()}
    heads = ["feed", "file_id", *keep, "version", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: dict[str, list] = {p: [] for p in target}
            applied, uncast = [], []
            for fields in batch.column(len(heads)).to_pylist():
                row, done, failed = {}, [], []
                for f in fields:
                    p = names[f["path"].lower()]
                    kind = target[p]
                    if p != f["was"]:
                        done.append(f"renamed {f['was']} to {p}")
                    own = f["types"] & 7
                    if own and own != SCALARS[kind]:
                        done.append(f"cast {p} from {bits.get(own, 'mixed')} to {kind}")
                    for x in f["items"]:
                        try:
                            value = _cast(x, kind)
                        except ValueError:
                            failed.append({"path": p, "value": x})
                        else:
                            row.setdefault(p, []).append(value)
                for p, column in data.items():
                    if p not in row and p in default:
                        done.append(f"default {p}")
                    column.append(row.get(p, default.get(p)))
                applied.append(done)
                uncast.append(failed)
            struct = pa.StructArray.from_arrays([pa.array(c, pa.list_(kinds[target[p]][0])) for p, c in data.items()], list(data)) if data else pa.nulls(len(applied), pa.string())
            made = [struct, pa.array(applied, pa.list_(pa.string())), pa.array(uncast, pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(heads))], *made], [*heads, "data", "applied", "uncast"])

    quote = lambda n: "`" + n.replace("`", "``") + "`"
    inner = "struct<" + ",".join(f"{quote(p)}:array<{kinds[t][1]}>" for p, t in target.items()) + ">" if target else "string"
    schema = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in named.select(*heads).schema)
    return named.mapInArrow(run, f"{schema}, data {inner}, applied array<string>, uncast array<struct<path:string,value:string>>")
