"""Every field of a JSON document, at whatever depth: its path, its types and its values.

A path is the names of the fields from the root, joined by dots; lists add nothing. Spark's JSON functions need the paths in
advance, so documents are walked in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("string", "number", "boolean", "array", "object")
_BIT = {str: 1, int: 2, float: 2, bool: 4, list: 8, dict: 16}


def _walk(node: object, found: dict[str, list], values: bool) -> None:
    stack = [("", node)]
    while stack:
        path, x = stack.pop()
        if type(x) is list:
            stack += [(path, y) for y in reversed(x) if type(y) in (dict, list)]
        elif type(x) is dict:
            for k, v in x.items():
                p = f"{path}.{k}" if path else k
                f = found.get(p)
                if f is None:
                    f = found[p] = [0, []]
                if v is None:
                    continue
                f[0] |= _BIT[type(v)]
                if values:
                    f[1] += [y if type(y) is str else json.dumps(y) for y in (v if type(v) is list else [v]) if y is not None and type(y) not in (dict, list)]
            stack += [(f"{path}.{k}" if path else k, v) for k, v in reversed(list(x.items())) if type(v) in (dict, list)]


def fields_of(df: DataFrame, keys: list[str], content: str, *, values: bool = False) -> DataFrame:
    """``(*keys, fields)`` with ``fields`` an array of ``(path, types[, items])`` in order of path, one row per row of ``df``.

    ``types`` is the sum of 1 string, 2 number, 4 boolean, 8 array, 16 object over all places of the path in the document; 0 if it
    is only ever null. ``items`` holds the scalars at the path in the order of the document, a lone value like a list of one.
    A document that is null, blank or not JSON has no fields. A name that occurs twice in an object counts by its last value.
    """
    inner = "path:string,types:int" + (",items:array<string>" if values else "")
    packed = df.select(*keys, F.col(content).cast("string").alias("_content"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema) + f", fields array<struct<{inner}>>"
    kind = pa.list_(pa.struct([("path", pa.string()), ("types", pa.int32()), *([("items", pa.list_(pa.string()))] if values else [])]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(len(keys)).to_pylist():
                found: dict[str, list] = {}
                try:
                    _walk(json.loads(text) if text else None, found, values)
                except (ValueError, RecursionError):
                    found = {}
                out.append([dict(zip(("path", "types", "items"), (p, t, i) if values else (p, t), strict=False)) for p, (t, i) in sorted(found.items())])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(out, kind)], [*keys, "fields"])

    return packed.mapInArrow(walk, schema)
