import pytest
from pyspark.sql import functions as F

from driftkit.operators import drift as R
from driftkit.operators import order_index as O
from driftkit.operators.data_diff import page_order


@pytest.fixture(scope="module")
def rows(spark):
    # A third of the rows are copies of one, some keys are NULL, some values nested.
    made = [(None if k % 7 == 0 else k % 50, "x" if k % 3 else "y", [k % 2]) for k in range(600)]
    return spark.createDataFrame([*made, *[(5, "hot", [0])] * 300], "a int, b string, c array<int>").repartition(5)


def _sorted(df):
    return sorted(([r["a"] is not None, r["a"] or 0, r["b"]] for r in df.collect()))


def _plain(rows):
    return [[r["a"] is not None, r["a"] or 0, r["b"]] for r in rows]


def test_positions_are_those_of_the_sorted_table(spark, rows):
    index = O.order_index(rows, ["a"], ranges=7)
    assert index.total() == 900 and index.order == tuple(page_order(rows, ["a"]))
    placed = O.positioned(index).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(900))
    assert _plain(placed) == _sorted(rows)


def test_copies_of_one_row_are_spread_over_ranges(rows):
    counts = [r["rows"] for r in O.order_index(rows, ["a"], ranges=7).ranges.collect()]
    assert len(counts) == 7 and max(counts) < 2 * 900 / 7


@pytest.mark.parametrize("offset, limit", [(0, 10), (95, 400), (899, 5), (900, 5), (0, 900), (450, 0)])
def test_a_page_holds_its_rows(rows, offset, limit):
    index = O.order_index(rows, ["a", "b"], ranges=6)
    page = O.page_at(index, offset, limit).orderBy("position").collect()
    assert [r["position"] for r in page] == list(range(900))[offset : offset + limit]
    assert _plain(page) == _sorted(rows)[offset : offset + limit]


def test_a_page_reads_its_ranges_only(rows):
    index = O.order_index(rows, ["a"], ranges=9)
    plan = O.page_at(index, 400, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Sort" not in plan
    assert "PushedFilters: [IsNotNull(__range), GreaterThanOrEqual(__range" in plan


@pytest.mark.parametrize("key", [(None,), (0,), (5,), (5, "hot"), (5, "hou"), (49, "z"), (1000,)])
def test_offset_of_a_key(rows, key):
    index = O.order_index(rows, ["a", "b"], ranges=6)
    wanted = [key[0] is not None, key[0] or 0, *key[1:]]
    assert O.offset_of(index, key) == sum(r[: len(wanted)] < wanted for r in _sorted(rows))


def test_pages_number_all_rows_and_an_index_is_found_again(spark, rows):
    index = O.open_index(spark, O.order_index(rows, ["b"]).path)
    sizes = O.pages(index, 70).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in sizes] == [70] * 12 + [60]
    index.release()
    with pytest.raises(Exception):
        O.open_index(spark, index.path)


def test_ranks_in_groups(rows):
    got = O.ranked(O.order_index(rows, ["b", "a"], ranges=8), ["b"])
    for r in got.groupBy("b").agg(F.collect_set("rank").alias("ranks"), F.max("size").alias("n")).collect():
        assert sorted(r["ranks"]) == list(range(r["n"]))
    with pytest.raises(ValueError):
        O.ranked(O.order_index(rows, ["a"]), ["b"])


def test_an_empty_table_has_an_empty_index(spark, rows):
    index = O.order_index(rows.filter("false"), ["a"])
    assert index.total() == 0 and O.page_at(index, 0, 10).count() == 0 and O.pages(index, 5).count() == 0
    assert O.offset_of(index, (1,)) == 0


def test_many_newest_checks_are_those_of_the_window(spark, monkeypatch):
    history = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.timestamp_seconds(F.col("id") % 90).alias("checked_at"), "id",
    )
    few = [tuple(r) for r in R.history_last(history, 20, ["id"]).collect()]
    monkeypatch.setattr(R, "_KEPT_BY_TASK", 10)
    assert [tuple(r) for r in R.history_last(history, 20, ["id"]).collect()] == few
