"""Duplicates hidden by formatting: records that are equal once names and values are reduced to letters and digits.

Every record, in whatever notation, becomes a set of (name, values) pairs. A pair is hashed with its values in order, and
the hashes of a record are combined by addition, so that the order of the fields doesn't matter and nothing is sorted. Two
independent 55-bit sums, the partition key among what is hashed, and the number of pairs are the fingerprint. Groups are hash
aggregates of the smallest id over fixed-width fingerprints. Only records of groups with two or more members travel with their
fields: to their group, and once more as its representative. Each is verified against it field by field, by hash lookups.
Groups of more than ``HOT_ROWS`` records are spread over several tasks, with a copy of the representative each. Records whose
fingerprint collides with an unequal one, if ever there are any, are grouped by their whole content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import trimmed, written

_LANE = (1 << 55) - 1


def _listed(c: Column) -> Column:
    """Text of a value as ``array<string>``: a JSON list as its items, anything else as the only item; null as none."""
    return F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.array(c))


def _split(c: Column) -> Column:
    return F.split(c, r",")


_TREE = r"(?m)^([^\s:\-][^:\n]*):[ \t]*([^\n]*)((?:\n[ \t]*-[^\n]*)*)"


def parse_pairs(text: Column) -> Column:
    """The ``(name, values)`` pairs of a record written as a JSON object or its single-quoted kin, as ``name = a, b`` lines, as
    ``name=[a, b] | name=[c]``, or as ``name: a`` lines with ``- a`` items below. Null for anything else. Blanks at the ends of
    the record, of names and of values may stay, as :func:`reduced` takes them off."""
    obj = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), _listed(e["value"]).alias("vals")))
    name = F.split(text, r"\s\|\s")
    bar = F.transform(name, lambda s: F.struct(F.substring_index(s, "=[", 1).alias("name"), F.filter(_split(F.regexp_extract(s, r"(?s)=\[(.*)\]\s*$", 1)), lambda v: F.trim(v) != "").alias("vals")))
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.contains("="))
    line = F.transform(lines, lambda s: F.struct(F.substring_index(s, "=", 1).alias("name"), _split(F.substr(s, F.instr(s, "=") + 1)).alias("vals")))
    parts = [F.regexp_extract_all(text, F.lit(_TREE), F.lit(i)) for i in (1, 2, 3)]
    below = lambda z: F.slice(F.split(z["below"], r"\n[ \t]*-"), 2, 1 << 30)
    tree = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("name", "lone", "below"), strict=True)]), lambda z: F.struct(z["name"].alias("name"), F.when(z["below"] != "", below(z)).otherwise(F.array(z["lone"])).alias("vals")))
    return F.when(text.startswith("{"), obj).when(text.rlike(r"^[^\n=\[]+=\["), bar).when(text.rlike(r"^[^\n:=]+ ="), line).when(text.rlike(_TREE), tree)


def reduced(c: Column) -> Column:
    """Letters and digits only, in one case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


_SEP = "\x1f"  # isn't a letter or digit, so that a pair's text can be read in one way only


def normal_pairs(pairs: Column) -> Column:
    """Each pair as one text: its reduced name and values in order."""
    return F.transform(pairs, lambda p: F.array_join(F.concat(F.array(reduced(p["name"])), F.transform(p["vals"], lambda v: reduced(F.coalesce(v, F.lit(""))))), _SEP))


def _lane(pairs: Column, seed: Column) -> Column:
    """A sum modulo 2**55 of the pairs' hashes: commutative, and never out of range."""
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, p: (a + F.xxhash64(seed, p).bitwiseAND(_LANE)).bitwiseAND(_LANE))


def fingerprints(df: DataFrame, id_col: str, part: str, text: str) -> DataFrame:
    """``(id, part, pairs, f1, f2, n)`` per record with an id and a text."""
    raw = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(part).alias("part"), trimmed(F.col(text)).alias("text"))
    pairs = raw.select("id", "part", F.coalesce(normal_pairs(parse_pairs(F.col("text"))), F.array(F.concat(F.lit(_SEP), reduced(F.col("text"))))).alias("pairs"))
    lanes = [_lane(F.col("pairs"), F.xxhash64(F.lit(k), "part")).alias(f"f{i}") for i, k in enumerate((17, 40503), 1)]
    return pairs.select("id", "part", "pairs", *lanes, F.size("pairs").alias("n"))


KEY = ["part", "f1", "f2", "n", "_s"]
#: Records of one group that one task verifies, unless 1 / HOT_SHARE of all records is more.
HOT_ROWS, HOT_SHARE = 100_000, 4096


def _same_key(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` joined with the fewer rows of ``b`` on the key, nulls of the part being equal; the columns of both, those of the key of ``a``."""
    on = F.expr(" and ".join(f"a.{k} {'<=>' if k == 'part' else '='} b.{k}" for k in KEY))
    return a.alias("a").join(b.hint("shuffle_hash").alias("b"), on, how).select("a.*", *[f"b.{c}" for c in b.columns if c not in KEY])


def same_records(df: DataFrame, id_col: str, part: str, text: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, first_id, part)`` for every record: ``first_id`` is the smallest id of the records equal to it, itself included.

    Records are compared within ``part`` (null is a part of its own). Text in no known notation is compared as one value. Null
    texts and null ids give no row; an id that occurs twice with equal texts gives one, with unequal ones one for each.
    """
    prints = written(fingerprints(df, id_col, part, text)).where("id is not null")
    key = [k for k in KEY if k != "_s"]
    groups = written(prints.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("copies")))
    alone = groups.where("copies = 1").select(F.col("first_id").alias("id"), "first_id", "part")
    limit = F.greatest(F.lit(hot_rows), groups.agg(F.sum("copies")).scalar() / HOT_SHARE)
    shares = F.when(F.col("copies") > limit, F.ceil(F.col("copies") / hot_rows)).otherwise(1).cast("int")
    groups = groups.where("copies > 1").withColumn("shares", shares)
    # At most HOT_SHARE groups are larger than 1 / HOT_SHARE of all records.
    hot = groups.where("shares > 1").select(*[F.col(k).alias(f"_{k}") for k in key], "shares")
    dealt = prints.join(F.broadcast(hot), F.expr(" and ".join(f"_{k} {'<=>' if k == 'part' else '='} {k}" for k in key)), "left")
    dealt = dealt.select("id", "pairs", *key, F.when(F.col("shares") > 1, F.pmod(F.xxhash64("id"), F.col("shares"))).otherwise(0).cast("int").alias("_s"))
    copied = lambda d: d.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    members = _same_key(dealt, copied(groups).select(*KEY, "first_id", "shares"))
    first = copied(members.where("id = first_id")).select(*KEY, F.col("pairs").alias("_pairs"))
    pairs, own = F.col("pairs"), F.col("_pairs")
    equal = (pairs == own) | ((F.size(F.array_except(pairs, own)) == 0) & (F.size(F.array_except(own, pairs)) == 0))
    both = _same_key(members, first).withColumn("equal", equal)
    checked = written(both.select("id", "first_id", "part", F.when(~F.col("equal"), F.to_json(F.array_sort("pairs"))).alias("whole")))
    sound = checked.where("whole is null").select("id", "first_id", "part").distinct()
    odd = checked.where("whole is not null").select("id", "part", "whole").distinct()
    own_first = odd.groupBy("part", "whole").agg(F.min("id").alias("first_id"))
    odd = odd.alias("o").join(own_first.alias("w"), F.expr("o.part <=> w.part and o.whole = w.whole")).select("o.id", "w.first_id", "o.part")
    return alone.unionByName(sound).unionByName(odd)


def distinct_records(df: DataFrame, id_col: str, part: str, text: str) -> DataFrame:
    """One row ``(part, first_id, copies)`` per distinct record; ``copies`` counts all its records."""
    return same_records(df, id_col, part, text).groupBy("part", "first_id").agg(F.count("*").alias("copies"))
