import random
from itertools import combinations

import pytest

from driftkit.operators import keys as K
from driftkit.plans.compare import diff_database
from driftkit.sources.catalog import catalog


def brute(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for s in combinations(range(len(names)), size):
            values = [tuple(r[i] for i in s) for r in rows]
            full = all(v is not None for t in values for v in t)
            key = tuple(names[i] for i in s)
            if rows and full and len(set(values)) == len(rows) and not any(set(k) <= set(key) for k in found):
                found.append(key)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_by_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [
        (k // 6, k % 6, draw.randint(0, 3), str(k) if seed % 2 else draw.choice(["a", None]), float(draw.randint(0, 400)))
        for k in range(36)
    ]
    if seed == 3:
        rows = rows + rows[:1]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a int, b int, c long, d string, e double").repartition(4)
    assert K.key_candidates(df, 3) == brute(rows, names, 3)


def test_one_repeated_row_among_many_is_found(spark):
    df = spark.range(5000).selectExpr("id AS a", "id % 50 AS b", "id div 50 AS c", "CASE id WHEN 4999 THEN 0 ELSE id END AS near")
    assert K.key_candidates(df, 2) == [("a",), ("b", "c"), ("b", "near"), ("c", "near")]


def test_nested_columns_and_empty_tables(spark):
    df = spark.createDataFrame([([1], {"k": 1}), ([2], {"k": 1})], "a array<int>, m map<string,int>")
    assert K.key_candidates(df) == [("a",)]
    assert K.key_candidates(df.filter("false")) == []


def test_keys_from_the_catalog(spark):
    t = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "a int, b int, v string")
    after = spark.createDataFrame([(1, 1, "x"), (1, 2, "z")], "a int, b int, v string")
    declared = catalog(spark, {"t": t}, "db", {"t": ["b", "a"]})
    assert K.declared_keys(declared) == {"t": ["b", "a"]}
    assert [tuple(r) for r in diff_database(spark, {"t": t}, {"t": after}, declared=declared).data.collect()] == [("t", 0, 0, 1)]
    # a key that one version lost does not serve, one that is given goes first
    assert K.keys_for({"t": t}, {"t": after.drop("b")}, {}, declared) == {}
    assert K.keys_for({"t": t}, {"t": after}, {"t": ["a"]}, declared) == {"t": ["a"]}
    with pytest.raises(ValueError):
        K.declared_keys(declared.unionByName(catalog(spark, {"t": t}, "other", {"t": ["a"]})))
