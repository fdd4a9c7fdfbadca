"""What the physical plans must look like for large and skewed tables."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from driftkit.operators import checks as C
from driftkit.operators import data_diff as D
from driftkit.operators import drift as R
from driftkit.operators import fleet as L
from driftkit.queries import base
from driftkit.queries import inputs as I
from driftkit.queries.base import derive, table

SF_DIR = "/root/testdata/sf0.01"


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def shuffled(spark):
    """No broadcast joins, and partitions count as skewed early."""
    with conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20000",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        yield spark


def executed(df):
    """The plan that ran, after the adaptive steps."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]


def hot(spark, rows=60_000):
    """A third of the rows share key 7, spread over many input splits."""
    return spark.range(0, rows, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000).alias("k"),
        F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"),
    )


def test_hot_key_is_split_in_membership_joins(shuffled):
    rows = hot(shuffled)
    others = shuffled.range(500).select(F.col("id").alias("k"))
    kept = D.removed_rows(rows, others, ["k"])
    assert "skew=true" in executed(kept) and kept.count() == 40_000


def test_hot_fleet_is_split_in_rollouts(shuffled):
    outcomes = hot(shuffled).select(F.col("k").alias("fleet"), F.col("v").alias("pos"), (F.col("v") != 30_000).alias("ok"), "pad")
    for canary in (900, 20_000):
        plan = executed(L.rollout_states(outcomes, canary=canary))
        assert "skew=true" in plan

    def seven(canary):
        states = L.rollout_states(outcomes, canary).filter("fleet = 7")
        return {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}

    assert seven(900) == {"applied": 900, "canary": 19_100}
    assert seven(20_000) == {"applied": 10_000, "failed": 1, "skipped": 9_999}


def test_hot_database_is_split_when_looking_for_its_newest_snapshot(shuffled):
    rows = hot(shuffled).select(F.col("k").alias("database"), (F.col("v") % 2).alias("captured_at"), "pad")
    assert R.latest_snapshot(rows).filter("database = 7").count() == 10_000
    assert "skew=true" in executed(R.latest_snapshot(rows))


def test_foreign_keys_are_counted_before_the_join(shuffled):
    fk = C.ForeignKey("c", ("k",), "p", ("k",))
    plan = executed(C.orphan_keys(hot(shuffled), shuffled.range(50).select(F.col("id").alias("k")), fk))
    # Two shuffles, both behind a partial aggregation, and none between them and the join.
    assert len(re.findall(r"Exchange hashpartitioning\(k", plan)) == 2
    join_at = plan.index("SortMergeJoin")
    assert plan.index("Exchange hashpartitioning") > plan.index("HashAggregate", join_at)
    assert "partial_count" in plan


def test_only_differences_are_shuffled_twice(spark):
    old, new = table(spark, SF_DIR, "orders"), derive(spark, SF_DIR, I.ORDERS_AFTER)
    plan = executed(D.diff_counts(old, new, I.ORDERS_KEYS))
    wide = [s for s in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "o_totalprice" in s]
    narrow = [s for s in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "o_totalprice" not in s]
    assert len(wide) == 1 and len(narrow) == 1
    assert "Join" not in plan


def test_tables_bucketed_by_key_are_diffed_without_a_shuffle(spark, tmp_path):
    orders = table(spark, SF_DIR, "orders")
    for name in ("bucketed_old", "bucketed_new"):
        orders.write.bucketBy(8, "o_orderkey").option("path", str(tmp_path / name)).saveAsTable(name)
    try:
        new = spark.table("bucketed_new").withColumn("o_totalprice", F.col("o_totalprice") + 1)
        counts = D.diff_counts(spark.table("bucketed_old"), new, ["o_orderkey"])
        assert "Exchange hashpartitioning" not in executed(counts)
        assert counts.first().asDict() == {"added": 0, "removed": 0, "changed": orders.count()}
    finally:
        for name in ("bucketed_old", "bucketed_new"):
            spark.sql(f"DROP TABLE {name}")


def test_row_listing_reuses_the_wide_shuffle(spark):
    old, new = table(spark, SF_DIR, "lineitem"), derive(spark, SF_DIR, I.LINEITEM_AFTER)
    plan = executed(D.diff_rows(old, new, I.LINEITEM_KEYS))
    wide = [s for s in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "l_extendedprice" in s]
    assert plan.count("ReusedExchange") >= 2 and len(wide) - plan.count("ReusedExchange") == 1


def test_scans_read_only_the_columns_and_rows_they_need(spark):
    lineitem = table(spark, SF_DIR, "lineitem")
    unique = executed(C.pk_unique_check(lineitem, I.LINEITEM_KEYS))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in unique
    assert "IsNotNull(l_orderkey)" in unique
    pages = lineitem.select("l_orderkey", "l_linenumber")
    after, _ = D.page(pages, ["l_orderkey", "l_linenumber"], 10, after=[5000, 3])
    assert "GreaterThanOrEqual(l_orderkey,5000)" in executed(after) or "GreaterThan(l_orderkey,5000)" in executed(after)
    counts = executed(D.row_counts({"lineitem": lineitem}))
    assert "ReadSchema: struct<>" in counts


def test_no_cartesian_products_or_python(spark):
    from driftkit import queries as registered

    for name, query in registered.queries().items():
        if name in ("watch_drift", "history_timeline", "snapshot_round_trip"):
            continue
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        assert "Python" not in plan and "Pandas" not in plan, name


def test_the_larger_a_fleet_the_more_partitions_compare_it(spark, monkeypatch):
    from driftkit import queries as registered

    assert base.tasks(spark, "/root/testdata/sf0.001", "orders") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(base, "ROWS_PER_TASK", 100)
    n = base.tasks(spark, SF_DIR, "orders")
    assert n == -(-table(spark, SF_DIR, "orders").count() // 100) > 100
    plan = executed(registered.queries()["change_list"](spark, SF_DIR))
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#.*, (\d+)\), REPARTITION_BY_NUM", plan)
    assert set(dealt) == {("o_custkey", str(n)), ("database", str(n))}
    # The grouping of the inputs and the sort of the diff use these; the session's own number of partitions is not.
    assert "ENSURE_REQUIREMENTS" not in plan
