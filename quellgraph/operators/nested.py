"""Deeply nested records into related flat tables.

One projection: nested ``transform`` calls attach the keys and positions of the ancestors to every object, ``flatten`` joins
the arrays, and one ``inline`` per target table emits its rows. Fields of any shape are read as JSON text first, so that a
lone value, a null, a list and an encoded sub-document all arrive, and are then read by what they turn out to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellgraph.runtime import trimmed

#: The lists of an account dump, and the lists of its entities.
ENTITY_LISTS = ("UserDetailList", "GroupDetailList", "RoleDetailList")
ITEM_LISTS = ("GroupList", "AttachedManagedPolicies", "UserPolicyList")
ITEMS_OF = {"UserDetailList": ITEM_LISTS, "GroupDetailList": ("AttachedManagedPolicies",), "RoleDetailList": ("AttachedManagedPolicies",)}

_ENTITY = "struct<UserName:string,GroupName:string,RoleName:string,Arn:string," + ",".join(f"{x}:string" for x in ITEM_LISTS) + ">"
_BODY = "struct<" + ",".join(f"{x}:string" for x in (*ENTITY_LISTS, "Policies")) + ">"


def as_list(c: Column, kind: str) -> Column:
    """JSON text of a list or of a lone value as ``array<kind>``; null where absent, null or blank."""
    text = F.ltrim(c)
    listed = F.when(text.startswith("["), c)
    if kind == "string":
        return F.when(F.coalesce(text, F.lit("")) == "", None).when(text.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return F.from_json(F.coalesce(listed, F.concat(F.lit("["), F.when(text != "", c), F.lit("]"))), f"array<{kind}>")


def dump_body(dump: Column) -> Column:
    """The four lists of a dump as JSON text, from the root or from the object that wraps them."""
    root = F.from_json(dump, f"{_BODY[:-1]},AuthorizationDetails:{_BODY}>")
    return F.struct(*[F.coalesce(root[x], root["AuthorizationDetails"][x]).alias(x) for x in (*ENTITY_LISTS, "Policies")])


def decoded(c: Column) -> Column:
    """A sub-document as JSON text, whether it came as an object, as text or percent-encoded."""
    text = F.ltrim(c)
    return F.when(text.startswith("%"), F.try_url_decode(text)).when(text.startswith('"'), F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "struct<x:string>")["x"]).otherwise(c)


def _with_bodies(dumps: DataFrame, keys: list[str], dump: str) -> DataFrame:
    # The projection is split by a generator-free step that Spark doesn't collapse: the parsed lists are read once.
    body = dumps.select(*[F.col(k).alias(f"_{k}") for k in keys], dump_body(F.col(dump)).alias("_body"))
    lists = [as_list(F.col(f"_body.{x}"), _ENTITY).alias(x) for x in ENTITY_LISTS]
    return body.select(*[f"_{k}" for k in keys], *lists, F.col("_body.Policies").alias("_policies"))


def entities(dumps: DataFrame, keys: list[str], dump: str = "dump") -> DataFrame:
    """One row per user, group and role: ``(*keys, entity_list, entity_pos, name, arn)``."""
    lists = _with_bodies(dumps, keys, dump)

    def of_list(x: str) -> Column:
        return F.transform(x, lambda e, i: F.struct(F.lit(x).alias("entity_list"), (i + 1).alias("entity_pos"), F.coalesce(e["UserName"], e["GroupName"], e["RoleName"]).alias("name"), e["Arn"].alias("arn")))

    rows = F.flatten(F.array(*[F.coalesce(of_list(x), F.array()) for x in ENTITY_LISTS]))
    return lists.select(*[F.col(f"_{k}").alias(k) for k in keys], F.inline(rows))


def _items(entity: Column, field: str) -> Column:
    """The items of one list of an entity as ``array<string>``."""
    if field == "GroupList":
        return F.transform(as_list(entity[field], "string"), lambda g: F.coalesce(g, F.lit("")))
    if field == "AttachedManagedPolicies":
        return F.transform(as_list(entity[field], "struct<PolicyArn:string>"), lambda p: F.coalesce(trimmed(p["PolicyArn"]), F.lit("")))
    inline = as_list(entity[field], "struct<PolicyDocument:string>")
    return F.transform(inline, lambda p: F.coalesce(F.get_json_object(decoded(p["PolicyDocument"]), "$.Version"), F.lit("")))


def items(dumps: DataFrame, keys: list[str], dump: str = "dump", fields: tuple[str, ...] = ITEM_LISTS) -> DataFrame:
    """One row per item of the lists of users, groups and roles: ``(*keys, entity_list, entity_pos, field_name, item_pos, item)``.

    Positions count from 1. A lone value counts as a list of one; null and absent lists, and dumps that are null, blank or
    not JSON, give no row. An item is the group's name, the trimmed PolicyArn, or the Version of the inline policy's document;
    an empty string where that is absent or null. Dumps delivered twice give their rows twice.
    """
    lists = _with_bodies(dumps, keys, dump)

    def of_field(x: str, e: Column, i: Column, f: str) -> Column:
        row = lambda item, j: F.struct(F.lit(x).alias("entity_list"), (i + 1).alias("entity_pos"), F.lit(f).alias("field_name"), (j + 1).alias("item_pos"), item.alias("item"))
        return F.coalesce(F.transform(_items(e, f), row), F.array())

    def of_list(x: str) -> Column:
        return F.flatten(F.transform(x, lambda e, i: F.flatten(F.array(*[of_field(x, e, i, f) for f in ITEMS_OF[x] if f in fields]))))

    per_list = [F.coalesce(of_list(x), F.array()) for x in ENTITY_LISTS if set(ITEMS_OF[x]) & set(fields)]
    return lists.select(*[F.col(f"_{k}").alias(k) for k in keys], F.inline(F.flatten(F.array(*per_list))))


def policies(dumps: DataFrame, keys: list[str], dump: str = "dump") -> DataFrame:
    """One row per policy that a dump lists: ``(*keys, policy_pos, policy_arn)``."""
    lists = _with_bodies(dumps, keys, dump)
    rows = F.transform(as_list(F.col("_policies"), "struct<Arn:string>"), lambda p, i: F.struct((i + 1).alias("policy_pos"), trimmed(p["Arn"]).alias("policy_arn")))
    return lists.select(*[F.col(f"_{k}").alias(k) for k in keys], F.inline(rows))


def policy_arns(dumps: DataFrame, keys: list[str], dump: str = "dump") -> DataFrame:
    """``(*keys, listed, policy_arn)``: the policies that a dump attaches to its entities (not listed), and those that it lists itself, in one
    parse. Repeated ones stay repeated; absent and null Arns give an empty string or null."""
    lists = _with_bodies(dumps, keys, dump)
    attached = [F.coalesce(F.flatten(F.transform(x, lambda e: F.coalesce(_items(e, "AttachedManagedPolicies"), F.array()))), F.array()) for x in ENTITY_LISTS]
    own = F.coalesce(F.transform(as_list(F.col("_policies"), "struct<Arn:string>"), lambda p: trimmed(p["Arn"])), F.array())
    row = lambda listed: lambda a: F.struct(F.lit(listed).alias("listed"), a.alias("policy_arn"))
    rows = F.concat(F.transform(F.flatten(F.array(*attached)), row(False)), F.transform(own, row(True)))
    return lists.select(*[F.col(f"_{k}").alias(k) for k in keys], F.inline(rows))


#: The inline policies of each kind of entity.
INLINE = {"UserDetailList": "UserPolicyList", "GroupDetailList": "GroupPolicyList", "RoleDetailList": "RolePolicyList"}
_WHOLE = "struct<UserName:string,GroupName:string,RoleName:string,Arn:string,AssumeRolePolicyDocument:string," + ",".join(f"{x}:string" for x in INLINE.values()) + ">"
_POLICY = "struct<PolicyName:string,PolicyDocument:string>"
_VERSION = "struct<VersionId:string,IsDefaultVersion:string,Document:string>"


def documents(dumps: DataFrame, keys: list[str], dump: str = "dump") -> DataFrame:
    """One row per policy document of a dump, with the path to its parent: ``(*keys, parent_list, parent_pos, kind, doc_pos, doc_name, version, document)``.

    ``kind`` is ``inline`` (of users, groups and roles), ``trust`` (of roles) or ``version`` (of the policies that the dump lists);
    ``document`` is JSON text, whether it came as an object, as text or percent-encoded. Positions count from 1, a lone value counts as
    a list of one. Absent and null documents keep their row, without a version.
    """
    body = dumps.select(*[F.col(k).alias(f"_{k}") for k in keys], dump_body(F.col(dump)).alias("_body"))
    lists = body.select(*[f"_{k}" for k in keys], *[as_list(F.col(f"_body.{x}"), _WHOLE).alias(x) for x in ENTITY_LISTS], as_list(F.col("_body.Policies"), "struct<PolicyName:string,Arn:string,PolicyVersionList:string>").alias("Policies"))

    def row(parent: str, i: Column, kind: str, j: Column, name: Column, text: Column) -> Column:
        doc = decoded(text)
        return F.struct(
            F.lit(parent).alias("parent_list"), (i + 1).alias("parent_pos"), F.lit(kind).alias("kind"), j.alias("doc_pos"), name.alias("doc_name"), F.get_json_object(doc, "$.Version").alias("version"), doc.alias("document")
        )

    rows = []
    for x in ENTITY_LISTS:
        inline = F.flatten(F.transform(x, lambda e, i: F.coalesce(F.transform(as_list(e[INLINE[x]], _POLICY), lambda p, j: row(x, i, "inline", j + 1, p["PolicyName"], p["PolicyDocument"])), F.array())))  # noqa: B023
        rows.append(F.coalesce(inline, F.array()))
    trust = F.transform("RoleDetailList", lambda e, i: row("RoleDetailList", i, "trust", F.lit(1), e["RoleName"], e["AssumeRolePolicyDocument"]))
    versions = F.flatten(F.transform("Policies", lambda p, i: F.coalesce(F.transform(as_list(p["PolicyVersionList"], _VERSION), lambda v, j: row("Policies", i, "version", j + 1, v["VersionId"], v["Document"])), F.array())))
    rows += [F.coalesce(F.filter(trust, lambda r: r["document"].isNotNull()), F.array()), F.coalesce(versions, F.array())]
    return lists.select(*[F.col(f"_{k}").alias(k) for k in keys], F.inline(F.flatten(F.array(*rows))))


def statements(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per statement of :func:`documents`: ``(*keys, parent_list, parent_pos, kind, doc_pos, statement_pos, sid, effect, actions, resources)``;
    absent actions and resources are null, lone ones lists of one."""
    st = as_list(F.from_json("document", "struct<Statement:string>")["Statement"], "struct<Sid:string,Effect:string,Action:string,Resource:string>")
    s = docs.select(*keys, "parent_list", "parent_pos", "kind", "doc_pos", F.posexplode(st).alias("_i", "s"))
    return s.select(*keys, "parent_list", "parent_pos", "kind", "doc_pos", (F.col("_i") + 1).alias("statement_pos"), F.col("s.Sid").alias("sid"), F.col("s.Effect").alias("effect"), as_list(F.col("s.Action"), "string").alias("actions"), as_list(F.col("s.Resource"), "string").alias("resources"))
