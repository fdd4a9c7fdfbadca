"""Plans, risks, rebuilds, staged application and rollouts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.operators import migration as G
from driftkit.operators.schema_diff import schema_diff
from tests.test_schema import cat, idx

OLD = {"users": [("id", "INTEGER", False, None, 1), ("name", "TEXT")]}


def plan(spark, old, new, with_catalog=True, old_idx=None, new_idx=None):
    a, b = cat(spark, old), cat(spark, new)
    steps = G.migration_plan(schema_diff(a, b, old_idx, new_idx), b if with_catalog else None).orderBy("step")
    return [(r["step"], r["action"], r["detail"], r["warning"]) for r in steps.collect()]


def test_plan_add_table(spark):
    new = {**OLD, "logs": [("id", "INTEGER", False, None, 1), ("message", "TEXT", True, "''", 0)]}
    assert plan(spark, OLD, new) == [(1, "create table", "id INTEGER, message TEXT NOT NULL DEFAULT ''", None)]
    assert plan(spark, OLD, new, with_catalog=False) == [(1, "create table", None, None)]


def test_plan_drop_table(spark):
    assert plan(spark, {**OLD, "sessions": [("id", "INT")]}, OLD) == [
        (1, "drop table", None, "drops table sessions and ALL its data permanently")]


def test_plan_add_column(spark):
    assert plan(spark, OLD, {"users": [*OLD["users"], ("verified_at", "TEXT")]}) == [
        (1, "add column", "verified_at", None)]


def test_plan_rebuild(spark):
    old = {"users": [*OLD["users"], ("legacy_id", "INTEGER")]}
    new = {"users": [("id", "BIGINT", False, None, 1), ("name", "TEXT"), ("email", "TEXT")]}
    detail = "remove column legacy_id, change id type INTEGER→BIGINT, add column email"
    assert plan(spark, old, new) == [(1, "rebuild table", detail, "drops column users.legacy_id and its data")]
    assert "skipped" in plan(spark, old, new, with_catalog=False)[0][3]


def test_plan_steps_and_composite_key(spark):
    old = {**OLD, "a": [("x", "INT")], "z": [("x", "INT")]}
    new = {**OLD, "z": [("x", "INT"), ("y", "INT")], "k": [("p", "INT", True, None, 2), ("q", "INT", True, None, 1)]}
    b = cat(spark, new)
    changes = schema_diff(cat(spark, old), b, idx(spark, [("users", "i1", False)]), idx(spark, [("users", "i2", False)]))
    rows = G.migration_plan(changes, b).orderBy("step").collect()
    assert [(r["step"], r["table"], r["action"]) for r in rows] == [
        (1, "a", "drop table"), (2, "k", "create table"), (3, "users", "drop index"), (4, "users", "note new index"),
        (5, "z", "add column")]
    assert rows[1]["key"] == ["q", "p"]
    assert [r["table"] for r in G.plan_warnings(G.migration_plan(changes, b)).collect()] == ["a"]


def test_risks(spark):
    old = {**OLD, "gone": [("id", "INT")], "t": [("a", "INT"), ("b", "INT"), ("c", "INT")], "empty": [("a", "INT")]}
    new = {"users": [*OLD["users"], ("must", "TEXT", True)], "t": [("a", "BIGINT"), ("b", "INT", True)],
           "empty": [("a", "INT"), ("must", "TEXT", True)], "fresh": [("a", "INT")]}
    counts = spark.createDataFrame([("gone", 3), ("t", 5), ("empty", 0), ("users", 1)], "table string, rows bigint")
    got = {(r["table"], r["risk"], r["rows"]) for r in G.migration_risks(schema_diff(cat(spark, old), cat(spark, new)), counts).collect()}
    assert got == {("gone", "DROP TABLE", 3), ("t", "TYPE CHANGE", 5), ("t", "NULLABILITY CHANGE", 5),
                   ("t", "DROP COLUMN", 5), ("users", "ADD COLUMN", 1)}
    unknown = G.migration_risks(schema_diff(cat(spark, old), cat(spark, new)), counts.limit(0)).collect()
    assert {r["risk"] for r in unknown} == {"DROP TABLE", "TYPE CHANGE", "NULLABILITY CHANGE", "DROP COLUMN"}
    assert all(r["rows"] is None for r in unknown)


def test_coercion_loss(spark):
    df = spark.createDataFrame([("1", 1.0), ("01", 1.5), (" 7", None), ("x", 2.0), (None, 3.0)], "t string, d double")
    got = {r["column"]: (r["rows"], r["lost"], r["altered"]) for r in G.coercion_loss(df, {"t": "int", "d": T.LongType()}).collect()}
    assert got == {"t": (5, 1, 2), "d": (5, 0, 1)}


def layout(*fields):
    types = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, types[t], nullable) for n, t, nullable in fields])


def test_rebuild(spark):
    df = spark.createDataFrame([(1, "alice", "x"), (2, "bob", "y")], "id int, name string, legacy string")
    out = G.rebuild_table(df, layout(("id", "bigint", False), ("name", "string", True), ("tag", "string", False)), {"tag": "-"})
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "alice", "-"), (2, "bob", "-")]
    bad = layout(("name", "int", True))
    with pytest.raises(Exception, match="does not fit"):
        G.rebuild_table(df, bad).collect()
    assert [r["name"] for r in G.rebuild_table(df, bad, on_bad="null").collect()] == [None, None]
    with pytest.raises(Exception, match="NULL not allowed"):
        G.rebuild_table(df, layout(("email", "string", False))).collect()


def test_dry_run_per_member(spark):
    df = spark.createDataFrame(
        [("a", 1, "1", 1), ("a", 2, "2", None), ("b", 1, "x", 1), ("b", 1, None, 9), ("c", 1, "1", 1)],
        "member string, id int, v string, p int")
    parents = spark.createDataFrame([("a", 1), ("b", 1)], "member string, id int")
    got = G.migration_dry_run(df, layout(("id", "int", False), ("v", "int", False)), "member", keys=["id"],
                              parents=[G.Parent(("p",), parents, ("id",))])
    assert {tuple(r) for r in got.collect()} == {
        ("a", 2, 0, 0, 0, 0, True), ("b", 2, 1, 2, 1, 1, False), ("c", 1, 0, 0, 0, 1, False)}


def test_dry_run_measures_rebuilt_values(spark):
    df = spark.createDataFrame(
        [("a", "1", "5"), ("a", "01", "5"), ("b", "1", "x"), ("b", "2", "6"), ("c", "y", "5"), (None, "3", "5"), (None, "03", "7")],
        "member string, id string, p string")
    parents = spark.createDataFrame([("a", "05"), ("b", "5"), ("c", "5"), (None, "5"), ("b", "no")], "member string, id string")
    target = layout(("id", "int", False), ("p", "int", True))
    got = G.migration_dry_run(df, target, "member", keys=["id"], parents=[G.Parent(("p",), parents, ("id",))])
    assert {tuple(r) for r in got.collect()} == {
        ("a", 2, 0, 0, 1, 0, False), ("b", 2, 1, 0, 0, 1, False), ("c", 1, 1, 1, 0, 0, False), (None, 2, 0, 0, 1, 1, False)}
    lenient = G.migration_dry_run(df.filter("member = 'c'"), target, "member", on_bad="null").first()
    assert (lenient["lost_casts"], lenient["null_violations"], lenient["ok"]) == (1, 1, False)
    allowed = layout(("id", "int", True), ("p", "int", True))
    assert G.migration_dry_run(df.filter("member = 'c'"), allowed, "member", on_bad="null").first()["ok"]


def test_impossible_types(spark):
    df = spark.createDataFrame([("a", [1]), ("a", None)], "member string, v array<int>")
    assert tuple(G.coercion_loss(df, {"v": "int"}).first()) == ("v", "int", 2, 1, 0)
    row = G.migration_dry_run(df, layout(("v", "int", True)), "member").first()
    assert (row["lost_casts"], row["ok"]) == (1, False)
    assert [r["v"] for r in G.rebuild_table(df, layout(("v", "int", True)), on_bad="null").collect()] == [None, None]


def test_rollout_of_measured_members(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "member string, id string")
    order = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3)], "name string, pos bigint")
    target = layout(("id", "int", True))
    got = {r["member"]: (r["state"], r["halted"]) for r in G.rollout_dry_run(df, target, "member", order).collect()}
    assert got == {"a": ("applied", True), "b": ("failed", True), "c": ("skipped", True)}
    held = G.rollout_dry_run(df, target, "member", order, canary=1).collect()
    assert {(r["member"], r["state"], r["halted"]) for r in held} == {("a", "applied", False), ("b", "canary", False), ("c", "canary", False)}
    tried = {r["member"]: r["state"] for r in G.rollout_dry_run(df, target, "member").collect()}
    assert tried == {"a": "dry-run", "b": "failed", "c": "dry-run"}
