"""Random numbers without state: a hash of the seed and the things drawn for, so that any order and any engine gives the same draw."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    """A column, a column's name, or a whole number, as text."""
    return (part if isinstance(part, Column) else F.col(part) if isinstance(part, str) else F.lit(part)).cast("string")


def unit(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the text of ``parts`` joined by ``|``: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *map(_text, parts))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def unit_of(*parts: str | int) -> float:
    """:func:`unit` of plain values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def units_of(first: str, rest: list[bytes]) -> np.ndarray:
    """:func:`unit_of` of ``first``, the leading values joined by ``|``, with each of ``rest``, the text of the last ones."""
    head = f"{first}|".encode()
    return np.frombuffer(b"".join([hashlib.md5(head + x).digest() for x in rest]), ">u4")[::4] / (1 << 32)


def draw_order(*parts: Column | str | int) -> Column:
    """A key to sort by for a random order."""
    return F.md5(F.concat_ws("|", *map(_text, parts)))
