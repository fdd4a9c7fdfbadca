"""Counts, keys, NULLs, foreign keys and the backup report."""

from driftkit.operators import checks as C
from driftkit.plans.compare import check, diff_database


def items(spark, n):
    return spark.createDataFrame([(i, f"v{i}") for i in range(n)], "id bigint, val string")


def test_equal_rows_match(spark):
    rows = C.compare_row_counts({"items": items(spark, 2)}, {"items": items(spark, 2)}).collect()
    assert [tuple(r) for r in rows] == [("items", 2, 2, True)]


def test_missing_table_and_rows_do_not_match(spark):
    got = C.compare_row_counts(
        {"items": items(spark, 1), "extra": items(spark, 1)}, {"items": items(spark, 3), "gone": items(spark, 0).limit(0)}
    )
    assert {tuple(r) for r in got.collect()} == {("items", 1, 3, False), ("gone", 0, 0, False)}


def report(spark, backup, reference=None, **kw):
    return check(spark, backup, reference, **kw).first().asDict()


def test_backup_passes(spark):
    got = report(spark, {"items": items(spark, 2)}, {"items": items(spark, 2)}, with_data=True, keys={"items": ["id"]})
    assert got["passed"] and got["schema_ok"] and got["data_ok"] and got["integrity_ok"]


def test_backup_with_another_schema_fails(spark):
    got = report(spark, {"items": items(spark, 2).withColumnRenamed("val", "extra")}, {"items": items(spark, 2)})
    assert not got["passed"] and got["schema_ok"] is False and got["schema_changes"] == 2 and got["data_ok"] is None


def test_backup_with_missing_rows_fails(spark):
    got = report(spark, {"items": items(spark, 1)}, {"items": items(spark, 3)}, with_data=True)
    assert not got["passed"] and got["data_ok"] is False and got["schema_ok"] is True
    assert tuple(got["tables"][0]) == ("items", 1, 3, False)


def test_backup_without_reference(spark):
    got = report(spark, {"items": items(spark, 2)}, keys={"items": ["id"]}, with_data=True)
    assert got["passed"] and got["schema_ok"] is None and got["data_ok"] is None
    assert tuple(got["tables"][0]) == ("items", 2, None, None)


def test_backup_with_broken_keys_fails(spark):
    bad = spark.createDataFrame([(1, "a"), (1, None), (None, "c")], "id bigint, val string")
    got = report(spark, {"items": bad}, keys={"items": ["id"]}, not_null={"items": ["val"]})
    assert not got["passed"]
    assert got["integrity_errors"] == [
        "items.id: 1 NULL(s)", "items.val: 1 NULL(s)", "items: 1 duplicate key(s), 1 extra row(s)"]


def test_unique_check_leaves_nulls_to_the_other_check(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 2), (1, 2), (1, 3)], "a int, b int")
    assert C.pk_unique_check(df, ["a"]).first().asDict() == {"duplicate_keys": 1, "extra_rows": 2, "is_unique": False}
    assert {tuple(r) for r in C.duplicate_keys(df, ["a", "b"]).collect()} == {(1, 2, 2)}
    assert {tuple(r) for r in C.not_null_check(df, ["a", "b"]).collect()} == {("a", 2, 5), ("b", 0, 5)}


FK = C.ForeignKey("children", ("parent_id",), "parents", ("id",))


def family(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "id bigint")
    children = spark.createDataFrame(
        [(i, p) for i, p in enumerate([1, 9, 9, 9, None, 8, 7, 6, 2])], "id bigint, parent_id bigint")
    return {"parents": parents, "children": children}


def test_foreign_keys(spark):
    assert tuple(C.fk_check(family(spark), [FK]).first()) == ("children", "parent_id", "parents", 4, 6)
    whole = {**family(spark), "parents": spark.range(10)}
    assert C.fk_check(whole, [FK]).first()["orphan_rows"] == 0


def test_foreign_key_sample(spark):
    rows = C.fk_sample(family(spark), [FK], {"children": ["id"]}).collect()
    assert [(r["key"], r["row_key"], r["violations"]) for r in rows] == [
        ("6", "7", 6), ("7", "6", 6), ("8", "5", 6), ("9", "1", 6), ("9", "2", 6)]


def test_row_ranges(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5)], "table string, rows bigint")
    ranges = spark.createDataFrame(
        [("a", 1, 5), ("b", 6, None), ("c", 1, None), ("c", None, 3)], "table string, min_rows bigint, max_rows bigint")
    got = {(r["table"], r["detail"]) for r in C.check_row_ranges(counts, ranges).collect()}
    assert got == {("b", "5 not in 6.."), ("c", "0 not in 1..")}


def test_database_diff(spark):
    diff = diff_database(spark, {"t": items(spark, 3)}, {"t": items(spark, 2).drop("val")}, {"t": ["id"]})
    assert [r["kind"] for r in diff.schema.collect()] == ["column removed"]
    assert [tuple(r) for r in diff.data.collect()] == [("t", 0, 1, 0)]


def mixed(spark):
    """Children whose keys are whole numbers of other sizes, texts, times and pairs, some unreadable, some NULL."""
    child = spark.createDataFrame(
        [(1, 1, "1", "a", 2.5), (2, 1 << 40, "x", "b", 1.0), (3, None, None, "zz", None), (4, 1, "7", None, 3.0), (5, 9, "09", "a", 2.5)],
        "id int, big long, code string, name string, price double",
    )
    parents = {
        "small": spark.createDataFrame([(1,), (9,), (None,)], "k int"),
        "names": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, p double"),
    }
    fks = [
        C.ForeignKey("child", ("big",), "small", ("k",)), C.ForeignKey("child", ("code",), "small", ("k",)),
        C.ForeignKey("child", ("name",), "names", ("k",)), C.ForeignKey("child", ("name", "price"), "names", ("k", "p")),
        C.ForeignKey("child", ("big", "name"), "pairs", ("a", "b")),
    ]
    parents["pairs"] = spark.createDataFrame([(1, "a"), (9, "zz")], "a short, b string")
    return {"child": child, **parents}, fks


def test_keys_of_many_types_in_one_pass(spark):
    tables, fks = mixed(spark)
    got = {(r["columns"], r["parent"]): (r["orphan_keys"], r["orphan_rows"]) for r in C.fk_check(tables, fks).collect()}
    assert got == {
        ("big", "small"): (1, 1), ("code", "small"): (2, 2), ("name", "names"): (1, 1), ("name, price", "names"): (1, 2),
        ("big, name", "pairs"): (2, 2),
    }
    for fk in fks:  # the same as one relation at a time
        alone = C.orphan_keys(tables["child"], tables[fk.parent], fk)
        assert (alone.count(), sum(r["rows"] for r in alone.collect())) == got[", ".join(fk.columns), fk.parent]


def test_sample_of_many_types(spark):
    tables, fks = mixed(spark)
    rows = C.fk_sample(tables, fks, {"child": ["id"]}, n=1).collect()
    got = {(r["columns"], r["parent"]): (r["key"], r["row_key"], r["violations"]) for r in rows}
    assert got[("big", "small")] == (str(1 << 40), "2", 1) and got[("code", "small")][2] == 2
    assert got[("name, price", "names")] == ("a, 2.5", "1", 2) and len(rows) == 5


def test_each_table_is_scanned_once(spark, tmp_path):
    tables, fks = mixed(spark)
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    stored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    plan = C.fk_check(stored, fks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(tables)
    plan = C.fk_sample(stored, fks, {"child": ["id"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
