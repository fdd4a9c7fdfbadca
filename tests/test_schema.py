"""Catalogs, schema changes, specs and their validation."""

import json

import pytest
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.functions import change_text, risk_text
from driftkit.operators import schema_diff as S
from driftkit.operators import validation as V
from driftkit.sources import specs
from driftkit.sources.catalog import catalog
from driftkit.sources.tables import load_tables


def cat(spark, tables, database="db"):
    """Catalog of {table: [(column, type, not_null, default, pk), ...]}; short tuples are filled up."""
    rows = []
    for table, columns in tables.items():
        for i, c in enumerate(columns):
            name, kind, not_null, default, pk = (*c, *(None, None, False, None, 0)[len(c):])
            rows.append((database, table, i + 1, name, kind, not_null, default, pk, None, None))
    return spark.createDataFrame(rows, M.CATALOG)


def idx(spark, indexes):
    return spark.createDataFrame([("db", t, i, u, None, None) for t, i, u in indexes], M.INDEXES)


def listed(changes):
    return {(r["kind"], r["table"], r["subject"], r["detail"]) for r in changes.collect()}


USERS = {"users": [("id", "INTEGER", False, None, 1), ("name", "TEXT")]}


def test_same_schema(spark):
    assert S.schema_diff(cat(spark, USERS), cat(spark, USERS)).count() == 0


def test_table_added_is_one_change(spark):
    new = {**USERS, "logs": [("id", "INTEGER"), ("message", "TEXT")]}
    assert listed(S.schema_diff(cat(spark, USERS), cat(spark, new))) == {("table added", "logs", None, None)}
    assert listed(S.schema_diff(cat(spark, new), cat(spark, USERS))) == {("table removed", "logs", None, None)}
    assert [tuple(r) for r in S.diff_tables(cat(spark, USERS), cat(spark, new)).collect()] == [
        ("db", "table added", "logs", 2)]


def test_columns(spark):
    new = {"users": [("id", "BIGINT", False, None, 1), ("email", "TEXT")]}
    assert listed(S.schema_diff(cat(spark, USERS), cat(spark, new))) == {
        ("column type changed", "users", "id", "INTEGER→BIGINT"),
        ("column added", "users", "email", None), ("column removed", "users", "name", None)}


def test_not_null_is_a_change_but_default_and_key_are_not(spark):
    strict = {"users": [("id", "INTEGER", False, None, 1), ("name", "TEXT", True)]}
    assert listed(S.schema_diff(cat(spark, USERS), cat(spark, strict))) == {
        ("column type changed", "users", "name", "TEXT→TEXT")}
    other = {"users": [("id", "INTEGER", False, None, 0), ("name", "TEXT", False, "'x'", 0)]}
    a, b = cat(spark, USERS), cat(spark, other)
    assert S.schema_diff(a, b).count() == 0
    assert S.schema_diff(a, b, compare_default=True, compare_pk=True).count() == 2


def test_all_columns_replaced_keeps_the_table(spark):
    a, b = cat(spark, {"t": [("x", "INT")]}), cat(spark, {"t": [("y", "INT")]})
    assert {k for k, *_ in listed(S.schema_diff(a, b))} == {"column added", "column removed"}


def test_indexes_only_on_shared_tables(spark):
    new = {**USERS, "logs": [("id", "INTEGER")]}
    old_i = idx(spark, [("users", "idx_old", False), ("users", "idx_same", False)])
    new_i = idx(spark, [("users", "idx_email", True), ("users", "idx_same", True), ("logs", "idx_logs", False)])
    got = listed(S.schema_diff(cat(spark, USERS), cat(spark, new), old_i, new_i))
    assert got == {("table added", "logs", None, None), ("index added", "users", "idx_email", None),
                   ("index removed", "users", "idx_old", None)}
    assert {r["subject"] for r in S.diff_indexes(old_i, new_i, cat(spark, USERS), cat(spark, new)).collect()} == {
        "idx_email", "idx_old"}


def test_internal_tables_and_errors_are_left_out(spark):
    new = {**USERS, "sqlite_sequence": [("x", "INT")], "_cf_KV": [("x", "INT")], "sqliteXfoo": [("x", "INT")]}
    failed = spark.createDataFrame([("db", *[None] * 8, "no such file")], M.CATALOG)
    changes = S.schema_diff(cat(spark, USERS), cat(spark, new).unionByName(failed))
    assert listed(changes) == {("table added", "sqliteXfoo", None, None)}


def test_fleet_in_one_go(spark):
    old = cat(spark, USERS, "a").unionByName(cat(spark, USERS, "b"))
    new = cat(spark, USERS, "a").unionByName(cat(spark, {"users": USERS["users"][:1]}, "b"))
    changes = S.schema_diff(old, new)
    assert [(r["database"], r["kind"]) for r in changes.collect()] == [("b", "column removed")]
    verdict = {r["database"]: r["matches"] for r in S.verify_schema(new, old).collect()}
    assert verdict == {"a": True, "b": False}


def test_verify_counts_databases_in_one_grouping(spark):
    same, other = cat(spark, USERS, "a"), {"users": [("id", "TEXT")], "logs": [("id", "INT")]}
    got = same.unionByName(cat(spark, USERS, None)).unionByName(cat(spark, USERS, "only"))
    verdict = S.verify_schema(got, same.unionByName(cat(spark, other, None)))
    assert {tuple(r) for r in verdict.collect()} == {("a", 0, True), (None, 2, False), ("only", 1, False)}
    assert "Join" not in verdict._jdf.queryExecution().executedPlan().toString()


def test_catalog_of_frames(spark):
    df = spark.createDataFrame([(1, [1.0], "x")], "id bigint not null, v array<float>, t string")
    rows = catalog(spark, {"t": df}, "db", {"t": ["t", "id"]}, {"t": {"t": "'-'"}}).orderBy("ordinal").collect()
    assert [(r["column"], r["type"], r["not_null"], r["default_value"], r["pk"]) for r in rows] == [
        ("id", "bigint", True, None, 2), ("v", "array<float>", False, None, 0), ("t", "string", False, "'-'", 1)]
    with pytest.raises(ValueError):
        catalog(spark, {"t": df}, "db", {"t": ["nope"]})


def test_load_tables(spark, tmp_path):
    for name in ("b", "a", "sqlite_stat1"):
        spark.range(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.range(3).write.json(str(tmp_path / "c.json"))
    assert list(load_tables(spark, str(tmp_path))) == ["a", "b"]
    assert load_tables(spark, str(tmp_path), ["c"], "json")["c"].count() == 3
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), ["missing"])


def changes_of(spark, rows):
    return spark.createDataFrame(rows, "kind string, table string, subject string, detail string")


def verdicts(result):
    return sorted((r["verdict"], r["kind"], r["table"], r["subject"], r["copies"]) for r in result.collect())


def passed(result):
    return V.validation_passed(result).first()["passed"]


ADDED = ("column added", "users", "verified_at", None)


def test_validation_passes(spark):
    d = changes_of(spark, [ADDED])
    result = V.validate(d, d)
    assert passed(result) and verdicts(result) == [("confirmed", "column added", "users", "verified_at", 1)]


def test_validation_unexpected_and_missing(spark):
    d = changes_of(spark, [ADDED, ("table removed", "sessions", None, None)])
    result = V.validate(d, changes_of(spark, [ADDED]))
    assert not passed(result)
    assert ("unexpected", "table removed", "sessions", None, 1) in verdicts(result)
    empty = changes_of(spark, []).limit(0)
    result = V.validate(empty, changes_of(spark, [("table added", "audit_logs", None, None)]))
    assert not passed(result) and verdicts(result)[0][0] == "missing"
    assert passed(V.validate(empty, empty))


def test_validation_tables_and_indexes(spark):
    d = changes_of(spark, [
        ("table added", "new_table", None, None), ("table removed", "old_table", None, None),
        ("index added", "users", "idx_users_email", None), ("index removed", "users", "idx_users_old", None)])
    assert V.validation_passed(V.validate(d, d)).first()["confirmed"] == 4


def test_validation_matches_repeats_one_to_one(spark):
    kind = ("column type changed", "t", "c")
    d = changes_of(spark, [(*kind, "a→b"), (*kind, "a→b"), (*kind, "a→c")])
    result = {(r["verdict"], r["detail"], r["copies"]) for r in V.validate(d, d.limit(2)).collect()}
    assert result == {("confirmed", "a→b", 2), ("unexpected", "a→c", 1)}
    more = d.unionByName(d)
    result = {(r["verdict"], r["copies"]) for r in V.validate(d, more).collect()}
    assert result == {("confirmed", 2), ("confirmed", 1), ("missing", 3)}


def full_diff(spark):
    old = {**USERS, "gone": [("id", "INT")], "odd": [("a", "INT"), ("b", "TEXT")]}
    new = {**USERS, "logs": [("id", "INT")], "odd": [("a", "BIGINT"), ("c", "TEXT")]}
    return S.schema_diff(cat(spark, old), cat(spark, new), idx(spark, [("users", "i1", False)]),
                         idx(spark, [("users", "i2", True)]))


def test_spec_round_trip(spark, tmp_path):
    changes = full_diff(spark)
    spec = V.spec_from_diff(changes, "test migration")
    assert passed(V.validate(changes, V.spec_changes(spec)))
    path = str(tmp_path / "spec")
    specs.save_spec(spec, path)
    expected, ranges = specs.load_spec(spark, path)
    assert passed(V.validate(changes, expected)) and ranges.count() == 0
    assert expected.count() == changes.count() == 7


def test_spec_file(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({
        "description": "x",
        "schema": {"added_tables": ["logs"], "modified_tables": [
            {"table": "users", "added_columns": [{"name": "bio", "type": "TEXT"}],
             "changed_columns": [{"name": "id", "type": "BIGINT"}]}]},
        "data": {"users": {"min_rows": 10}, "logs": {"max_rows": 5}},
    }, indent=2))
    expected, ranges = specs.load_spec(spark, str(path))
    assert {(r["kind"], r["table"], r["subject"]) for r in expected.collect()} == {
        ("table added", "logs", None), ("column added", "users", "bio"), ("column type changed", "users", "id")}
    assert {(r["table"], r["min_rows"], r["max_rows"]) for r in ranges.collect()} == {("users", 10, None), ("logs", None, 5)}
    assert specs.read_spec(spark, str(path)).first()["version"] == 1


def test_broken_spec_fails(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text("{invalid json")
    with pytest.raises(Exception):  # noqa: B017
        specs.load_spec(spark, str(path))[0].collect()


def test_schema_diff_is_mirrored_and_ignores_repeats(spark):
    old = cat(spark, {**USERS, "gone": [("id", "INT")], "odd": [("a", "INT"), ("b", "TEXT")]})
    new = cat(spark, {**USERS, "logs": [("id", "INT")], "odd": [("a", "BIGINT"), ("c", "TEXT")]})
    swap = {"added": "removed", "removed": "added"}

    def turned(kind):
        noun, verb = kind.rsplit(" ", 1)
        return f"{noun} {swap.get(verb, verb)}"

    there = {(k, t, s) for k, t, s, _ in listed(S.schema_diff(old, new))}
    back = {(turned(k), t, s) for k, t, s, _ in listed(S.schema_diff(new, old))}
    assert there == back and len(there) == 5
    twice = S.schema_diff(old.unionByName(old), new.unionByName(new).unionByName(new))
    assert twice.count() == 5 and {(k, t, s) for k, t, s, _ in listed(twice)} == there


def test_rows_are_not_sorted_before_the_first_shuffle(spark):
    plan = full_diff(spark)._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("name", plan.rindex("Exchange hashpartitioning(database"))
    assert "SortAggregate" in plan[:dealt]
    assert "Sort" not in plan[dealt:]


def test_one_shuffle_and_one_sort_of_flat_rows(spark):
    plan = full_diff(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("- Sort ") == 1
    dealt = plan[plan.index("Exchange "):]
    assert "struct" not in dealt and "collect_list" not in plan


def test_table_with_many_changes_next_to_one_that_came_and_one_that_went(spark):
    wide = [(f"c{i}", "INT") for i in range(300)]
    old = cat(spark, {"wide": [("id", "INT"), *wide], "gone": wide, "same": wide})
    new = cat(spark, {"wide": [("id", "TEXT")], "logs": wide, "same": wide})
    unique = idx(spark, [("wide", "i", None), ("gone", "i", True), ("same", "i", False)])
    plain = idx(spark, [("wide", "j", False), ("logs", "j", True), ("same", "i", True)])
    got = [tuple(r) for r in S.schema_diff(old, new, unique, plain).select(
        "kind", "table", "subject", "detail", "old.type", "new.type").collect()]
    want = [("column removed", "wide", c, None, "INT", None) for c, _ in wide] + [
        ("column type changed", "wide", "id", "INT→TEXT", "INT", "TEXT"),
        ("index removed", "wide", "i", None, None, None), ("index added", "wide", "j", None, None, None),
        ("table removed", "gone", None, None, None, None), ("table added", "logs", None, None, None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_are_dealt_into_as_many_partitions_as_asked_for(spark):
    old, new = cat(spark, {**USERS, "gone": [("id", "INT")]}), cat(spark, {"users": [("id", "TEXT")], "logs": [("id", "INT")]})
    dealt = S.schema_diff(old, new, idx(spark, [("users", "i", True)]), idx(spark, []), partitions=13)
    assert dealt.rdd.getNumPartitions() == 13
    assert listed(dealt) == listed(S.schema_diff(old, new, idx(spark, [("users", "i", True)]), idx(spark, [])))
    assert dealt.count() == 5
    assert S.diff_columns(old, new, partitions=13).rdd.getNumPartitions() == 13


def test_indexes_of_unknown_tables_are_left_out(spark):
    stray = idx(spark, [("nowhere", "i", False)])
    assert S.schema_diff(cat(spark, USERS), cat(spark, USERS), None, stray).count() == 0


def test_summary_and_detail(spark):
    changes = full_diff(spark)
    assert S.change_summary(changes).first().asDict() == {
        "database": "db", "tables_added": 1, "tables_removed": 1, "tables_modified": 2}
    assert {(r["table"], r["column_changes"], r["index_changes"]) for r in S.change_detail(changes).collect()} == {
        ("odd", 3, 0), ("users", 0, 2)}


def test_texts(spark):
    rows = changes_of(spark, [("table added", "t", None, None), ("column type changed", "t", "c", "a→b")])
    text = change_text(F.col("table"), F.col("subject"), F.col("kind"), F.col("detail"))
    assert {r[0] for r in rows.select(text).collect()} == {"t: table added", "t.c: column type changed a→b"}
    risks = spark.createDataFrame([("drop", 3), ("drop", None)], "d string, n bigint")
    assert [r[0] for r in risks.select(risk_text(F.col("d"), F.col("n"))).collect()] == ["drop (3 rows affected)", "drop"]
