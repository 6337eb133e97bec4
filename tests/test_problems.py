"""The operators for dirty feeds: against brute force on a whole small table, and their edge cases."""

import json
from datetime import datetime

import brute
import pytest
from conftest import rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from quellgraph.operators import drift, key_states, nested, orphans, packed_fields, same_records
from quellgraph.plans import found
from quellgraph.runtime import global_index, spread_join, table


def cols(spark, d, name, *c):
    return [tuple(r) for r in table(spark, d, name).select(*c).collect()]


def test_found_against_brute_force(spark, small):
    assert rows(found.p1_found(spark, small)) == brute.p1(cols(spark, small, "model_history", "id", "predicted_nodes", "actual_nodes"))
    edges = brute.p2_edges(cols(spark, small, "org_edges", "edge_id", "org_id", "source", "target", "seen_at"), cols(spark, small, "org_graph", "org_id", "node_id", "added_at", "removed_at"))
    dumps = cols(spark, small, "account_dump", "dump_id", "account_id", "captured_at", "dump")
    assert rows(found.p2_found(spark, small)) == edges | brute.p2_dumps(dumps, cols(spark, small, "policy_catalog", "policy_arn", "created_at", "retired_at"))
    assert rows(found.p3_found(spark, small)) == brute.p3([(d[0], d[3]) for d in dumps])
    files = cols(spark, small, "policy_files", "file_id", "family", "content")
    assert rows(found.p4_found(spark, small)) == brute.p4([r[0] for r in cols(spark, small, "model_history", "topology_type")], files)
    assert rows(found.p5_found(spark, small)) == brute.p5(cols(spark, small, "policy_files", "file_id", "feed_id", "exported_at", "content"))
    assert rows(found.p6_found(spark, small)) == brute.p6(cols(spark, small, "role_statements", "record_id", "family", "raw_text"))


# packed fields


PACKED = [
        ("a:b:c,d:e:f", ["a:b:c", "d:e:f"]), ("a:b:c; d:e:f ;", ["a:b:c", "d:e:f"]), ('["a:b:c", "d, e"]', ["a:b:c", "d, e"]), ("('a:b:c', 'd:e:f')", ["a:b:c", "d:e:f"]), ("{}", []), (" ", []), ("", []), (None, []),
        ('"x ""y"" z","a:b:c"', ['x "y" z', "a:b:c"]), ("a:b:c|d:e:f,g:h:i", ["a:b:c", "d:e:f", "g:h:i"]), ("a:b:c\r\nd:e:f\r\n", ["a:b:c", "d:e:f"]), ("a:b:c，d:e:f", ["a:b:c", "d:e:f"]), (",,a:b:c,,", ["a:b:c"]), ("a:b:c a:b:c", ["a:b:c", "a:b:c"]),
        ('["q \\"r\\" s"]', ['q "r" s']),
    ]


@pytest.mark.parametrize("book_rows", [10**6, 0])
def test_packed_dialects(spark, book_rows):
    usual = [(-1 - i, f"a:b:c{i},d:e:f") for i in range(200)] + [(-1000 - i, f"a:b:c{i}") for i in range(200)]
    df = spark.createDataFrame(usual + [(i, raw) for i, (raw, _) in enumerate(PACKED)], "id long, f string")
    got = {}
    for r in packed_fields.split_packed(df, "id", ["f"], book_rows=book_rows).orderBy("pos").collect():
        got.setdefault(r["id"], []).append(r["value"])
    assert {i: got.get(i, []) for i in range(len(PACKED))} == {i: want for i, (_, want) in enumerate(PACKED)}


def test_packed_table(spark):
    data = [(1, "a:b:c,d:e:f", "x"), (1, "a:b:c,d:e:f", "x"), (None, "a:b:c", "y"), (2, None, "z"), (3, ",".join(f"a:b:c{i}" for i in range(20_000)), "long")]
    got = packed_fields.split_packed(spark.createDataFrame(data, "id long, f string, value string").withColumn("pos", F.lit("clash")), "id", ["f"])
    assert got.where("id = 1").count() == 4 and got.where("id is null").count() == 1 and got.where("id = 3").count() == 20_000 and got.where("id = 2").count() == 0
    assert rows(got.where("id = 1"), "pos", "value") == {(1, "a:b:c"), (2, "d:e:f")}
    assert packed_fields.split_packed(spark.createDataFrame([], "id long, f string"), "id", ["f"]).count() == 0


# orphans


def test_runs_of_integer_keys(spark):
    spans = spark.createDataFrame([("a", x, x + 1, x) for x in (1, 2, 3, 3, 7, 9, 10)] + [("b", 0, 9, 0), ("b", 2, 5, 2)], "key string, a long, b long, first long")
    assert rows(orphans.compress_runs(spans, ["key"])) == {("a", 1, 4, 1), ("a", 7, 8, 7), ("a", 9, 11, 9), ("b", 0, 9, 0)}


def test_single_integers_and_crowded_instants(spark):
    parents = spark.createDataFrame([("a", x) for x in (1, 2, 2, 5)] + [("h", 7)], "k string, n long")
    refs = spark.createDataFrame([(i, "h", 7 if i % 2 else 8) for i in range(40)] + [(100, "a", 2), (101, "a", 3), (102, "a", 0), (103, "h", None)], "id int, k string, at long")
    got = {r["id"]: r["reason"] for r in orphans.match_runs(refs, ["k"], "at", parents, ["k"], "n", None, hot_rows=5).withColumn("reason", orphans.orphan_reason("at")).collect()}
    assert got == {i: None if i % 2 else "deleted" for i in range(40)} | {100: None, 101: "deleted", 102: "late", 103: "missing"}


@pytest.mark.parametrize("hot", [10**9, 3])
def test_match_runs(spark, hot):
    spans = [("a", 0, 5), ("a", 3, 8), ("a", 20, None), ("a", 20, None), ("b", 10, 12), (None, 0, 9), ("a", 9, 9), ("c", 0, 1), ("c", 1, 2), ("c", 50, 60)]
    parents = spark.createDataFrame(spans, "k string, s long, e long").withColumn("at", F.lit("clash"))
    refs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([("a", -1), ("a", 7), ("a", 8), ("a", 19), ("a", 25), ("b", 3), ("b", 11), ("b", 12), ("z", 1), (None, 1), ("a", None), ("a", 7), ("c", 1), ("c", 2), ("c", 49), ("c", 55), ("c", 99)])], "id int, k string, at long")
    got = {r["id"]: r["reason"] for r in orphans.match_runs(refs, ["k"], "at", parents, ["k"], "s", "e", hot_rows=hot).withColumn("reason", orphans.orphan_reason("at")).collect()}
    assert got == {0: "late", 1: None, 2: "deleted", 3: "deleted", 4: None, 5: "late", 6: None, 7: "deleted", 8: "missing", 9: "missing", 10: "missing", 11: None, 12: None, 13: "deleted", 14: "deleted", 15: None, 16: "deleted"}


def test_match_runs_empty(spark):
    parents, refs = spark.createDataFrame([], "k string, s long, e long"), spark.createDataFrame([(1, "a", 1)], "id int, k string, at long")
    assert orphans.match_runs(refs, ["k"], "at", parents, ["k"], "s", "e").select("run_end").first()[0] is None
    assert orphans.match_runs(refs.limit(0), ["k"], "at", parents, ["k"], "s", "e").count() == 0


# nested records


def test_nested_edge_cases(spark):
    users = {"UserDetailList": [{"GroupList": "lone", "AttachedManagedPolicies": {"PolicyArn": " x "}, "UserPolicyList": None}, {"GroupList": ["a", None], "AttachedManagedPolicies": [{}, {"PolicyArn": None}]}, {"UserPolicyList": [{"PolicyDocument": "%7B%22Version%22%3A%22v1%22%7D"}, {"PolicyDocument": '{"Version": null}'}, {"PolicyDocument": {"Version": "v2"}}, {}]}]}
    data = [(1, json.dumps(users)), (2, json.dumps({"AuthorizationDetails": {"RoleDetailList": {"AttachedManagedPolicies": [{"PolicyArn": "r"}]}}})), (3, None), (4, ""), (5, "not json"), (6, "{}"), (7, json.dumps({"UserDetailList": [{"GroupList": ["g" * 100_000]}]}))]
    got = rows(nested.items(spark.createDataFrame(data, "dump_id long, dump string").withColumn("item", F.lit(1)), ["dump_id"]))
    assert got == {
        (1, "UserDetailList", 1, "GroupList", 1, "lone"), (1, "UserDetailList", 1, "AttachedManagedPolicies", 1, "x"), (1, "UserDetailList", 2, "GroupList", 1, "a"), (1, "UserDetailList", 2, "GroupList", 2, ""),
        (1, "UserDetailList", 2, "AttachedManagedPolicies", 1, ""), (1, "UserDetailList", 2, "AttachedManagedPolicies", 2, ""), (1, "UserDetailList", 3, "UserPolicyList", 1, "v1"), (1, "UserDetailList", 3, "UserPolicyList", 2, ""),
        (1, "UserDetailList", 3, "UserPolicyList", 3, "v2"), (1, "UserDetailList", 3, "UserPolicyList", 4, ""), (2, "RoleDetailList", 1, "AttachedManagedPolicies", 1, "r"), (7, "UserDetailList", 1, "GroupList", 1, "g" * 100_000),
    }
    assert nested.items(spark.createDataFrame([], "dump_id long, dump string"), ["dump_id"]).count() == 0


def test_documents_and_their_statements(spark):
    doc = {"Version": "v", "Statement": {"Effect": "Allow", "Action": "a", "Resource": ["r", "q"]}}
    dump = {
        "UserDetailList": [{"UserPolicyList": [{"PolicyName": "p", "PolicyDocument": doc}, {"PolicyName": "none"}]}], "GroupDetailList": {"GroupPolicyList": {"PolicyName": "g", "PolicyDocument": json.dumps({"Statement": [{}, {"Sid": "s"}]})}},
        "RoleDetailList": [{"RoleName": "r", "AssumeRolePolicyDocument": "%7B%22Version%22%3A%22t%22%7D", "RolePolicyList": None}, {"RoleName": "bare"}], "Policies": [{"Arn": "x", "PolicyVersionList": [{"VersionId": "v1", "Document": doc}, {"VersionId": "v2"}]}, {}],
    }
    data = [(1, json.dumps(dump)), (2, json.dumps({"AuthorizationDetails": dump})), (3, None), (4, ""), (5, "not json"), (6, "{}")]
    docs = nested.documents(spark.createDataFrame(data, "dump_id long, dump string").withColumn("kind", F.lit(1)), ["dump_id"])
    one = {("UserDetailList", 1, "inline", 1, "p", "v"), ("UserDetailList", 1, "inline", 2, "none", None), ("GroupDetailList", 1, "inline", 1, "g", None), ("RoleDetailList", 1, "trust", 1, "r", "t"), ("Policies", 1, "version", 1, "v1", "v"), ("Policies", 1, "version", 2, "v2", None)}
    assert rows(docs.drop("document")) == {(k, *r) for k in (1, 2) for r in one}
    st = nested.statements(docs.where("dump_id = 1"), ["dump_id"])
    assert {(r["parent_list"], r["statement_pos"], r["sid"], tuple(r["resources"] or ())) for r in st.collect()} == {("UserDetailList", 1, None, ("r", "q")), ("Policies", 1, None, ("r", "q")), ("GroupDetailList", 1, None, ()), ("GroupDetailList", 2, "s", ())}


def test_spread_join_of_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(901, None), (902, "unknown")], "id long, k string")
    right = left.where("k is not null and k != 'unknown'").groupBy("k").agg(F.count("*").alias("load"), F.min("id").alias("v"))
    got = spread_join(left, right, ["k"], "load", F.xxhash64("id"))
    want = left.join(right.drop("load"), "k", "left").select("id", "k", "v")
    assert rows(got) == rows(want) and got.count() == 902 and got.columns == ["id", "k", "v"]


# key states


def test_key_states(spark):
    data = [("a", 1.0)] * 6 + [("b", float("nan")), ("b", None), (None, 5.0), ("c", 2.0)]
    s = key_states.key_states(spark.createDataFrame(data, "k string, m double").withColumn("n_rows", F.lit(0)), "k", ["m"])
    got = {r["key_value"]: r for r in s.collect()}
    assert (got["a"]["n_rows"], got["b"]["avg_m"], got["c"]["sum_m"]) == (6, None, 2.0) and abs(got["a"]["share"] - 6 / 9) < 1e-12
    assert rows(key_states.dominating(s, 0.5), "key_value") == {("a",)}
    assert key_states.key_states(spark.createDataFrame([], "k string"), "k").count() == 0


# drift


def feed(spark, docs, name="f"):
    data = [(i, name, datetime(2025, 1, 1 + i), json.dumps(d) if not isinstance(d, str) and d is not None else d) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, "file_id long, feed_id string, exported_at timestamp, content string")


def test_drift_kinds(spark):
    docs = [{"a": 1, "o": {"x": "1"}}] * 2 + [{"a": 1, "o": {"y": "1"}, "new": {"in": 1}}] * 2 + [{"a": "s", "o": {"y": "1"}, "new": {"in": 1}}] * 2 + [{"a": "s", "o": {"y": "1"}}] * 2
    df = feed(spark, docs)
    files = drift.read_files(df.unionByName(df.limit(3)), values=True)
    got = rows(drift.changes(files), "file_id", "change_kind", "field_path", "new_path")
    assert got == {(2, "renamed", "o.x", "o.y"), (2, "added", "new", ""), (6, "removed", "new", ""), (4, "type", "a", "")}
    table_ = {r["file_id"]: r for r in drift.consistent(files, drift.changes(files), defaults={"new.in": ["7"]}).collect()}
    assert table_[0]["data"]["o.x"] == ["1"] and table_[7]["data"]["o.x"] == ["1"] and table_[0]["data"]["new.in"] == [7.0] and table_[3]["data"]["new.in"] == [1.0]
    assert table_[0]["data"]["a"] == ["1"] or table_[0]["data"]["a"] == [1.0]
    assert "renamed o.y to o.x" in table_[7]["applied"] and "default new.in" in table_[0]["applied"]
    assert got == brute.p5([(r.file_id, r.feed_id, r.exported_at, r.content) for r in df.collect()])


def test_drift_edge_cases(spark):
    assert drift.changes(drift.read_files(feed(spark, []))).count() == 0
    odd = feed(spark, [None, "", "not json", "[1, 2]", {"k": None}])
    assert drift.read_files(odd).count() == 5 and drift.changes(drift.read_files(odd)).count() == 0


def test_one_table_for_all_feeds(spark):
    """Casts to the type that most files have, values that can't be cast kept apart, the same fields for every feed."""
    a = feed(spark, [{"n": 1}, {"n": 2.5}, {"n": "3"}, {"n": "x", "only": True}], "a")
    b = feed(spark, [{"m": ["p", "q"]}, {"m": None}], "b").withColumn("file_id", F.col("file_id") + 10)
    files = drift.read_files(a.unionByName(a).unionByName(b), values=True)
    got = {r["file_id"]: r for r in drift.consistent(files, drift.changes(files)).collect()}
    assert len(got) == 6 and {tuple(r["data"].asDict()) for r in got.values()} == {("m", "n", "only")}
    kind, _ = drift.target_schema(drift.path_uses(drift.routed(files, drift.changes(files))).collect(), [])
    assert kind == {"m": "string", "n": "number", "only": "boolean"} or kind == {"m": "string", "n": "string", "only": "boolean"}
    kind, names = drift.target_schema([Row(path=p, n_files=n, string=n, number=0, boolean=0) for p, n in (("a.new.x", 3), ("a.old.x", 1), ("A.OLD.y", 2), ("a.old.Y", 1), ("p", 1), ("q", 5))], [("a.old", "a.new"), ("p", "q"), ("q", "p")])
    assert set(kind) == {"a.old.x", "A.OLD.y", "p"} and names["a.new.x"] == "a.old.x" and names["q"] == names["p"] == "p"
    assert [got[i]["data"]["n"] for i in range(4)] == [["1"], ["2.5"], ["3"], ["x"]] and got[10]["data"]["m"] == ["p", "q"] and got[11]["data"]["m"] is None
    more = drift.read_files(a.unionByName(feed(spark, [{"n": 4}] * 3, "c").withColumn("file_id", F.col("file_id") + 20)), values=True)
    cast = {r["file_id"]: r for r in drift.consistent(more, drift.changes(more)).collect()}
    assert cast[2]["data"]["n"] == [3.0] and cast[3]["data"]["n"] is None and [tuple(x) for x in cast[3]["uncast"]] == [("n", "x")] and "cast n from string to number" in cast[2]["applied"]
    assert drift.consistent(files.limit(0), drift.changes(files)).count() == 0
    with pytest.raises(ValueError, match="max_paths"):
        drift.consistent(files, drift.changes(files), max_paths=2)


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id")
    got = [tuple(r) for r in global_index(df, ["g", "id"]).orderBy("idx").collect()]
    assert [r[2] for r in got] == list(range(1000)) and [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert global_index(df.limit(0), ["g", "id"]).count() == 0


# records in other dress


def test_same_records_notations(spark):
    texts = ['{"Effect": "Allow", "Action": ["s3:Get", "x"]}', "{'ACTION': ['S3:GET', 'x'], 'EFFECT': 'Allow'} ;", "action = s3:get, X\neffect = allow.", "effect=[Allow] | action=[s3 : Get, x]", "Effect: Allow\nAction:\n- s3:Get\n  - x\n", "\t" + '{"effect":["allow"],"action":["s3:get","x"]}', '{"Effect": "Allow", "Action": ["x", "s3:Get"]}', '{"Effect": "Allow", "Action": ["s3:Get"]}']
    data = [(i + 10, "f", t) for i, t in enumerate(texts)] + [(1, "other", texts[0]), (90, "f", None), (91, "f", ""), (92, "f", ""), (93, "f", "free text"), (94, "f", "FREE  TEXT!"), (10, "f", texts[0])]
    df = spark.createDataFrame(data, "id long, family string, t string").withColumn("pairs", F.lit("clash"))
    got = rows(same_records.same_records(df, "id", "family", "t"), "id", "first_id")
    assert got == {(10, 10), (11, 10), (12, 10), (13, 10), (14, 10), (15, 10), (16, 16), (17, 17), (1, 1), (91, 91), (92, 91), (93, 93), (94, 93)}
    assert rows(same_records.same_records(df, "id", "family", "t", hot_rows=2), "id", "first_id") == got  # dealt to several tasks
    assert "SortAggregate" not in same_records.same_records(df, "id", "family", "t")._jdf.queryExecution().toString()
    assert same_records.same_records(df.limit(0), "id", "family", "t").count() == 0
    assert rows(same_records.distinct_records(df.where("id < 16 and family = 'f'"), "id", "family", "t")) == {("f", 10, 6)}


def test_same_records_collision(spark, monkeypatch):
    monkeypatch.setattr(same_records, "_lane", lambda pairs, seed: F.lit(0).cast("bigint"))
    df = spark.createDataFrame([(1, "f", '{"a": "x"}'), (2, "f", '{"a": "y"}'), (3, "f", '{"A": "Y"}'), (4, "f", '{"a": "X "}')], "id long, family string, t string")
    assert rows(same_records.same_records(df, "id", "family", "t"), "id", "first_id") == {(1, 1), (4, 1), (2, 2), (3, 2)}
