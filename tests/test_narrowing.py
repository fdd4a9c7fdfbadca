import datetime
import decimal

import pytest

from driftkit.operators.migration import coercion_loss
from driftkit.operators.narrowing import narrowest_types

D = decimal.Decimal
NOON, NIGHT = datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 1, 2)


@pytest.mark.parametrize("dtype, values, narrowest", [
    ("bigint", [1, -128, None], "tinyint"), ("bigint", [128], "smallint"), ("bigint", [1 << 31], "bigint"), ("int", [40000], "int"),
    ("bigint", [-(1 << 31)], "int"), ("bigint", [None], "void"),
    ("double", [1.0, -2.0], "tinyint"), ("double", [0.5, 2.0], "float"), ("double", [0.1], "double"), ("double", [-0.0], "float"),
    ("double", [float("nan"), 1.0], "float"), ("double", [float("inf")], "float"), ("double", [1e300], "double"),
    ("double", [2.0**53], "bigint"), ("float", [3.0], "tinyint"), ("float", [1.5], "float"),
    ("decimal(20,5)", [D("12.50000"), D("0.25000")], "decimal(4,2)"), ("decimal(20,5)", [D("7.00000")], "tinyint"),
    ("decimal(38,0)", [D(10) ** 30], "decimal(31,0)"), ("decimal(10,4)", [D("0.0001"), D("-3")], "decimal(5,4)"),
    ("string", ["1", "-7"], "tinyint"), ("string", ["007"], "string"), ("string", ["-0"], "string"), ("string", ["+1"], "string"),
    ("string", ["99999999999999999999"], "string"), ("string", ["1.50", "2.25"], "decimal(3,2)"), ("string", ["1.50", "2.5"], "string"),
    ("string", ["0.25", "0.75"], "decimal(2,2)"), ("string", ["1.5", "2"], "string"), ("string", ["1.5E10", "2.0"], "double"),
    ("string", ["-0.0"], "double"), ("string", ["true", "false", None], "boolean"), ("string", ["True"], "string"),
    ("string", ["2024-02-29"], "date"), ("string", ["2023-02-29"], "string"), ("string", ["2024-01-01 10:00:00"], "timestamp_ntz"),
    ("string", ["", "1"], "string"), ("string", [" 1"], "string"),
    ("timestamp_ntz", [NIGHT], "date"), ("timestamp_ntz", [NIGHT, NOON], "timestamp_ntz"), ("timestamp", [NIGHT], "date"),
    ("boolean", [True], "boolean"), ("array<int>", [[1]], "array<int>"), ("binary", [b"1"], "binary"),
])
def test_the_meet_of_the_values(spark, dtype, values, narrowest):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    row = narrowest_types(df).first()
    assert (row["narrowest"], row["rows"], row["nulls"]) == (narrowest, len(values), values.count(None))
    if narrowest not in ("void", dtype):  # nothing is lost
        loss = coercion_loss(df, {"v": narrowest}).first()
        assert (loss["lost"], loss["altered"]) == (0, 0)


def test_all_columns_in_one_pass(spark, tmp_path):
    spark.range(50).selectExpr("id", "CAST(id AS string) AS `a b`", "id / 4 AS q").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = narrowest_types(df)
    assert [(r["column"], r["narrowest"]) for r in out.collect()] == [("id", "tinyint"), ("a b", "tinyint"), ("q", "float")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {r["narrowest"] for r in narrowest_types(df.filter("id < 0")).collect()} == {"void"}
