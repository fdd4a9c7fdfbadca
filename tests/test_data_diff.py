"""Row comparison on small and random tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftkit.operators import data_diff as D

SCHEMA = "id bigint, name string, amount double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


OLD = [(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (4, "d", 4.0)]
NEW = [(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0), (5, "e", 5.0)]


def test_counts(spark):
    got = one(D.diff_counts(frame(spark, OLD), frame(spark, NEW), ["id"]))
    assert got == {"added": 1, "removed": 1, "changed": 2}


def test_same_table_has_no_difference(spark):
    t = frame(spark, OLD)
    assert one(D.diff_counts(t, t, ["id"])) == {"added": 0, "removed": 0, "changed": 0}
    assert D.diff_rows(t, t, ["id"]).count() == 0
    assert D.diff_multiset(t, t).count() == 0


def test_rows_carry_old_and_new(spark):
    rows = {r["key"]["id"]: r for r in D.diff_rows(frame(spark, OLD), frame(spark, NEW), ["id"]).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {2: "changed", 3: "changed", 4: "removed", 5: "added"}
    assert (rows[2]["old"]["name"], rows[2]["new"]["name"]) == ("b", "B")
    assert rows[4]["new"] is None and rows[5]["old"] is None


def test_diff_is_mirrored(spark):
    a, b = frame(spark, OLD), frame(spark, NEW)
    there = {(r["key"]["id"], r["status"], r["old"], r["new"]) for r in D.diff_rows(a, b, ["id"]).collect()}
    back = {(r["key"]["id"], r["status"], r["new"], r["old"]) for r in D.diff_rows(b, a, ["id"]).collect()}
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    assert there == {(k, swap[s], o, n) for k, s, o, n in back}


def test_limit_applies_to_the_finished_diff(spark):
    rows = D.diff_rows(frame(spark, OLD), frame(spark, NEW), ["id"], limit=2).collect()
    assert [r["key"]["id"] for r in rows] == [2, 3]


def test_cells(spark):
    cells = D.diff_cells(frame(spark, OLD), frame(spark, NEW), ["id"]).collect()
    assert {tuple(r) for r in cells} == {(2, "name", "b", "B"), (3, "amount", None, "3")}


def test_added_and_removed_rows(spark):
    a, b = frame(spark, OLD), frame(spark, NEW)
    assert [r["id"] for r in D.added_rows(a, b, ["id"]).collect()] == [5]
    assert [r["id"] for r in D.removed_rows(a, b, ["id"]).collect()] == [4]


def test_null_key_counts_as_a_key(spark):
    a = frame(spark, [(None, "a", 1.0), (1, "b", 1.0)])
    b = frame(spark, [(None, "A", 1.0), (1, "b", 1.0)])
    assert one(D.diff_counts(a, b, ["id"])) == {"added": 0, "removed": 0, "changed": 1}
    assert D.added_rows(a, b, ["id"]).count() == 0


def test_text_mode(spark):
    a = frame(spark, [(1, "1", 1.0), (2, None, 2.5)])
    b = spark.createDataFrame([("1", 1, "1"), ("2", None, "2.5")], "id string, name int, amount string")
    assert one(D.diff_counts(a, b, ["id"], compare="text")) == {"added": 0, "removed": 0, "changed": 0}
    c = spark.createDataFrame([("1", None, "1"), ("2", 7, "2.5")], "id string, name int, amount string")
    assert one(D.diff_counts(a, c, ["id"], compare="text"))["changed"] == 2


def test_retyped_column_reads_in_its_new_type(spark):
    a = spark.createDataFrame([(1, "7"), (2, "x"), (3, "y"), (4, None)], "id int, v string")
    b = spark.createDataFrame([(1, 7), (2, None), (3, 3), (4, None)], "id int, v int")
    assert one(D.diff_counts(a, b, ["id"])) == {"added": 0, "removed": 0, "changed": 2}
    cells = {tuple(r) for r in D.diff_cells(a, b, ["id"]).collect()}
    assert cells == {(2, "v", "x", None), (3, "v", "y", "3")}


def test_column_that_cannot_be_read_in_its_new_type(spark):
    a = spark.createDataFrame([(1, [1]), (2, None)], "id int, v array<int>")
    b = spark.createDataFrame([(1, 1), (2, None)], "id int, v int")
    assert {tuple(r) for r in D.diff_cells(a, b, ["id"]).collect()} == {(1, "v", "[1]", "1")}


def test_nested_values_and_special_floats(spark):
    schema = "id int, m map<string,int>, l array<struct<k:map<string,int>>>, f double"
    a = spark.createDataFrame([(1, {"a": 1, "b": 2}, [({"x": 1, "y": 2},)], float("nan")), (2, {"a": 1}, None, 0.0)], schema)
    b = spark.createDataFrame([(1, {"b": 2, "a": 1}, [({"y": 2, "x": 1},)], float("nan")), (2, {"a": 2}, None, -0.0)], schema)
    assert one(D.diff_counts(a, b, ["id"])) == {"added": 0, "removed": 0, "changed": 1}
    cells = D.diff_cells(a, b, ["id"]).collect()
    assert [(r["id"], r["column"]) for r in cells] == [(2, "m")]


def test_zeros_nans_and_retyped_columns(spark):
    schema = "id int, f double, g array<float>, h string"
    a = spark.createDataFrame([(1, 0.0, [0.0], "7"), (2, float("nan"), None, "x"), (3, None, [], "8")], schema)
    b = spark.createDataFrame([(1, -0.0, [-0.0], 7), (2, float("nan"), None, None), (3, None, None, 8)],
                              schema.replace("string", "int"))
    assert one(D.diff_counts(a, b, ["id"])) == {"added": 0, "removed": 0, "changed": 2}
    cells = {(r["id"], r["column"]) for r in D.diff_cells(a, b, ["id"]).collect()}
    assert cells == {(2, "h"), (3, "g")}


def test_nulls_and_empties_are_told_apart(spark):
    schema = "id int, a string, b string, l array<string>, m array<struct<x:int,y:int>>, n map<string,int>"
    a = spark.createDataFrame([
        (1, "v", None, None, None, None), (2, None, None, [], None, None), (3, None, None, [None], None, None),
        (4, None, None, None, [(1, None)], None), (5, None, None, None, [None], None), (6, None, None, None, None, {}),
        (7, "ab", "c", ["ab", "c"], [], {"k": None})], schema)
    b = spark.createDataFrame([
        (1, None, "v", None, None, None), (2, None, None, None, None, None), (3, None, None, [], None, None),
        (4, None, None, None, [(None, 1)], None), (5, None, None, None, [(None, None)], None),
        (6, None, None, None, None, None), (7, "ab", "c", ["ab", "c"], [], {"k": None})], schema)
    assert one(D.diff_counts(a, b, ["id"]))["changed"] == 6


def test_keyless_net_counts(spark):
    a, b = frame(spark, OLD), frame(spark, NEW[:1])
    assert one(D.diff_counts(a, b)) == {"added": 0, "removed": 3, "changed": 0}
    assert one(D.diff_counts(b, a)) == {"added": 3, "removed": 0, "changed": 0}


def test_unknown_key_is_refused(spark):
    with pytest.raises(ValueError):
        D.diff_counts(frame(spark, OLD), frame(spark, NEW), ["nope"])


def brute_force(old, new):
    """Per key, what is left after equal rows cancel."""
    left = Counter(new)
    left.subtract(Counter(old))
    keys = {}
    for row, n in left.items():
        if n:
            lost, gained = keys.setdefault(row[0], (Counter(), Counter()))
            (gained if n > 0 else lost)[row[1:]] += abs(n)
    rows, counts = Counter(), {"added": 0, "removed": 0, "changed": 0}
    for key, (lost, gained) in keys.items():
        if lost.total() == 1 and gained.total() == 1:
            counts["changed"] += 1
            rows[("changed", key, next(iter(lost)), next(iter(gained)))] += 1
        else:
            counts["added"] += gained.total()
            counts["removed"] += lost.total()
            for v, n in lost.items():
                rows[("removed", key, v, None)] += n
            for v, n in gained.items():
                rows[("added", key, None, v)] += n
    return counts, rows


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_with_repeats_and_nulls(spark, seed):
    rng = random.Random(seed)

    def table():
        return [
            (rng.choice([None, *range(12)]), rng.choice(["x", "y", None]), rng.choice([0.5, None]))
            for _ in range(rng.randint(0, 40))
        ]

    old, new = table(), table()
    counts, rows = brute_force(old, new)
    a, b = frame(spark, old), frame(spark, new)
    assert one(D.diff_counts(a, b, ["id"])) == counts
    got = Counter()
    for r in D.diff_rows(a, b, ["id"]).collect():
        got[(r["status"], r["key"]["id"], r["old"] and tuple(r["old"]), r["new"] and tuple(r["new"]))] += r["copies"]
    assert got == rows
    # Taking the lost copies away and adding the gained ones turns old into new.
    patched = Counter(old)
    for r in D.diff_multiset(a, b).collect():
        patched[tuple(r)[:3]] += r["copies"] if r["status"] == "added" else -r["copies"]
    assert +patched == Counter(new)


def test_hot_key_is_not_multiplied(spark):
    # A third of both sides shares one key; a join of the two would give a million pairs.
    old = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("id"), F.col("id").alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 7, -F.col("v") - 1).otherwise(F.col("v")))
    rows = D.diff_rows(old, new, ["id"])
    assert one(rows.groupBy().pivot("status", ["added", "removed", "changed"]).count()) == {
        "added": 1000, "removed": 1000, "changed": None}


def test_page_and_total(spark):
    df = spark.range(50).select((F.lit(49) - F.col("id")).alias("id"))
    rows, total = D.page(df, ["id"], limit=3, offset=10)
    assert [r["id"] for r in rows.collect()] == [10, 11, 12] and total.first()["total"] == 50
    after, _ = D.page(df, ["id"], limit=3, after=[12])
    assert [r["id"] for r in after.collect()] == [13, 14, 15]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 20])
def test_pages_hold_every_row_once(spark, size):
    rows = [(k // 4, None if k % 3 == 0 else "x", [k]) for k in range(10)] + [(1, "x", [5]), (None, None, None), (1, "x", [5])]
    df = spark.createDataFrame(rows, "a int, b string, l array<int>").select("a", "b")
    names, read, after, seen = D.page_order(df, ["a"]), [], None, 1
    assert names == ["a", "b"]
    while True:
        got = [tuple(r) for r in D.page(df, ["a"], limit=size, after=after, seen=seen)[0].collect()]
        if not got:
            break
        seen = got.count(got[-1]) + (seen if list(got[-1]) == after else 0)
        after = list(got[-1])
        read += got
    assert sorted(read, key=str) == sorted(((a, b) for a, b, _ in rows), key=str)


def test_text_form_of_numbers(spark):
    df = spark.createDataFrame(
        [(10**15, 1e15, 1.0), (10**14, 1e14, 2.5), (9 * 10**18, 9e18, -0.0), (-7, -7.0, 1e300)], "i long, d double, x double")
    df = df.withColumn("c", F.col("i").cast("decimal(30,4)")).withColumn("e", F.lit("1.50").cast("decimal(5,2)"))
    def text(c):
        return D.text_form(F.col(c), df.schema[c].dataType)
    for r in df.select(text("i").alias("i"), text("d").alias("d"), text("c").alias("c"), text("e").alias("e")).collect():
        assert r["i"] == r["d"] == r["c"] and r["e"] == "1.5"
    assert [r[0] for r in df.select(text("x")).collect()] == ["1", "2.5", "0", "1.0E300"]


def test_retyped_keys(spark):
    old = spark.createDataFrame([("1", 1), ("x", 2), ("y", 2), (None, 3), ("4", 4)], "k string, v int")
    new = spark.createDataFrame([(1, 5), (None, 6), (9, 9), (4, 4)], "k bigint, v int")
    rows = D.diff_rows(old, new, ["k"])
    assert {(r["status"], r["key"]["k"]) for r in rows.collect()} == {
        ("changed", "1"), ("removed", "x"), ("removed", "y"), ("changed", None), ("added", "9")}
    assert all(not n.startswith("__") for f in rows.schema.fields if f.name in ("old", "new") for n in f.dataType.names)
    assert {r["k"] for r in D.added_rows(old, new, ["k"]).collect()} == {9}
    assert {r["k"] for r in D.removed_rows(old, new, ["k"]).collect()} == {"x", "y"}
    assert one(D.diff_counts(old, new, ["k"])) == {"added": 1, "removed": 2, "changed": 2}


def test_tables_of_two_databases(spark):
    t = frame(spark, OLD)
    got = D.diff_tables_data(
        {"same": t, "gone": t, "empty_gone": t.limit(0), "bare": t},
        {"same": t, "new": t, "bare": frame(spark, OLD[:1])}, {"same": ["id"]},
    )
    assert {tuple(r) for r in got.collect()} == {
        ("gone", 0, 4, 0), ("empty_gone", 0, 0, 0), ("new", 4, 0, 0), ("bare", 0, 3, 0)}
