import pytest
from pyspark.sql import types as T

from driftkit.operators import layout as C
from driftkit.operators import migration as G
from tests.test_schema import cat


def test_types_of_other_engines(spark):
    assert C.read_type("INTEGER") == T.LongType() and C.read_type("") == C.read_type(None) == T.StringType()
    assert C.read_type("VARCHAR(9)") is not None and C.read_type("array<int>") == T.ArrayType(T.IntegerType())
    assert C.read_type("decimal(12,99)") is None and C.read_type("no such type") is None


def test_a_layout_holds_types_defaults_keys_and_nullability(spark):
    declared = cat(spark, {"t": [("b", "TEXT", True, "'x'", 0), ("a", "INTEGER", False, None, 2), ("c", "int", False, "1 + 1", 1)]})
    layout = C.compile_layouts(declared)["t"]
    assert [(f.name, f.dataType, f.nullable) for f in layout.schema] == [
        ("b", T.StringType(), False), ("a", T.LongType(), False), ("c", T.IntegerType(), False)]
    assert layout.key == ("c", "a")
    df = spark.createDataFrame([("7", 0)], "a string, gone int")
    assert [tuple(r) for r in G.rebuild_table(df, layout.schema, layout.defaults).collect()] == [("x", 7, 2)]
    dry = G.migration_dry_run(df.selectExpr("a", "'m' AS m"), layout.schema, "m", layout.defaults, layout.key).first()
    assert dry["ok"] and dry["duplicate_keys"] == 0


@pytest.mark.parametrize("column, problem", [
    (("x", "no such type"), "t.x: unreadable type"), (("A", "int"), "t.A: repeated column"),
    (("x", "int", False, "'text'", 0), "t.x: unreadable default"), (("x", "int", False, "other + 1", 0), "t.x: unreadable default"),
    (("x", "int", False, "(", 0), "t.x: unreadable default"),
])
def test_problems_are_named(spark, column, problem):
    with pytest.raises(ValueError, match=problem.replace(".", r"\.")):
        C.compile_layouts(cat(spark, {"t": [("a", "int"), column]}))


def test_problems_of_a_fleet_are_rows(spark):
    declared = cat(spark, {"t": [("a", "int"), ("A", "int"), ("b", "wrong")], "u": [("a", "TEXT")]})
    assert sorted(tuple(r)[1:] for r in C.layout_problems(declared).collect()) == [
        ("t", "A", "repeated column"), ("t", "b", "unreadable type wrong")]
    assert C.layout_problems(declared.filter("false")).count() == 0 and C.compile_layouts(declared.filter("false")) == {}


def test_layouts_of_two_databases_are_refused(spark):
    one = cat(spark, {"t": [("a", "int")]})
    with pytest.raises(ValueError, match="one database"):
        C.compile_layouts(one.unionByName(one.selectExpr("'other' AS database", *[f"`{c}`" for c in one.columns if c != "database"])))
