"""As-of lookups, drift against the baseline in force, refused mixtures, merges without positions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftkit.operators import drift as R
from driftkit.operators import fleet as L
from driftkit.operators.as_of import as_of

DAY = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k) for k in range(60)]
CATALOG = "database string, `table` string, `column` string, type string, not_null boolean, captured_at timestamp, error string"


@pytest.mark.parametrize("seed", range(3))
def test_as_of_is_the_last_fact_up_to_the_event(spark, seed):
    draw = random.Random(seed)

    def some(n):
        # One key has half of all; times tie; some keys and times are NULL.
        return [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([*DAY, None])) for _ in range(n)]

    events, facts = some(300), some(25)
    got = as_of(
        spark.createDataFrame(events, "k string, t timestamp").repartition(4).withColumn("id", F.lit(1)),
        spark.createDataFrame(facts, "k string, t timestamp"), ["k"], "t", "f",
    )
    want = [
        (k, t, 1, max((u for j, u in facts if j == k and u is not None and t is not None and u <= t), default=None))
        for k, t in events
    ]
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, want))


def test_as_of_without_facts_or_events(spark):
    none = spark.createDataFrame([], "k string, t timestamp")
    one = spark.createDataFrame([("a", DAY[0])], "k string, t timestamp")
    assert as_of(one, none, ["k"], "t", "f").collect()[0]["f"] is None
    assert as_of(none, one, ["k"], "t", "f").count() == 0


def _rows(database, at, *columns, error=None):
    return [(database, "t", c, y, False, at, error) for c, y in columns]


def _in_force(spark):
    bases = _rows("a", DAY[0], ("x", "int")) + _rows("a", DAY[10], ("x", "int"), ("y", "int"))
    live = (
        _rows("a", DAY[0], ("x", "int")) + _rows("a", DAY[5], ("x", "int"), ("y", "int"))
        + _rows("a", DAY[12], ("x", "int"), ("y", "int")) + _rows("a", DAY[13], ("x", "text"), ("y", "int"))
        + _rows("b", DAY[5], ("x", "int")) + [("a", None, None, None, None, DAY[14], "gone")]
    )
    return spark.createDataFrame(bases, CATALOG), spark.createDataFrame(live, CATALOG)


def test_each_capture_meets_the_baseline_of_its_time(spark):
    got = {r["checked_at"]: r for r in R.drift_in_force(*_in_force(spark)).collect()}
    assert set(got) == {DAY[0], DAY[5], DAY[12], DAY[13], DAY[14]}  # b has no baseline
    assert [got[DAY[k]]["has_drift"] for k in (0, 5, 12, 13, 14)] == [False, True, False, True, None]
    assert [got[DAY[k]]["baseline_at"] for k in (5, 12)] == [DAY[0], DAY[10]]
    assert [c["kind"] for c in got[DAY[13]]["changes"]] == ["column type changed"]
    assert got[DAY[14]]["error"] == "gone" and got[DAY[14]]["changes"] == []


def test_the_newest_baseline_judges_snapshots(spark):
    bases, live = _in_force(spark)
    got = {r["checked_at"]: r["has_drift"] for r in R.drift_of_snapshots(bases, live).collect()}
    assert got == {DAY[0]: True, DAY[5]: False, DAY[12]: False, DAY[13]: True, DAY[14]: None}


def test_only_differing_captures_meet_the_baseline(spark):
    bases, live = _in_force(spark)
    plan = R.drift_in_force(bases, live)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "Cross" not in plan


def test_several_captures_are_refused(spark):
    bases, live = _in_force(spark)
    one = R.latest_snapshot(bases)
    with pytest.raises(Exception, match="several captures"):
        R.drift(bases, live).collect()
    with pytest.raises(Exception, match="several captures"):
        R.drift(one, live).collect()
    registry = spark.createDataFrame([(1, "a", "/a", None, [])], "pos long, name string, dsn string, baseline string, tags array<string>")
    with pytest.raises(Exception, match="several captures"):
        L.fleet_check(registry, bases, R.latest_snapshot(live)).collect()
    with pytest.raises(Exception, match="several captures"):
        L.fleet_check(registry, one, live).collect()
    assert R.drift(one, R.latest_snapshot(live.filter("error is null"))).count() == 1


REGISTRY = "pos long, name string, dsn string, baseline string, tags array<string>"


def test_members_without_a_position_keep_what_they_bring(spark):
    known = spark.createDataFrame([(1, "a", "/old", "/base", ["x"])], REGISTRY)
    coming = spark.createDataFrame([
        (5, "a", "/five", "/b5", ["five"]), (None, "a", "/none", "/bn", ["none"]), (None, "new", "/n", "/bn", ["t"]),
    ], REGISTRY)
    got = {r["name"]: r for r in L.fleet_merge(known, coming).collect()}
    assert (got["a"]["dsn"], got["a"]["tags"], got["a"]["pos"], got["a"]["baseline"]) == ("/none", ["none"], 1, "/base")
    assert (got["new"]["dsn"], got["new"]["baseline"], got["new"]["tags"], got["new"]["pos"]) == ("/n", "/bn", ["t"], None)
    assert (got["a"]["updated"], got["new"]["added"], got["new"]["updated"]) == (2, 1, 0)


def test_transitions_go_on_after_a_restart(spark, tmp_path):
    from driftkit.streaming import transitions as W

    def rows(at, is_baseline, *columns, error=None):
        listed = [("a", "t", k, c, y, False, None, 0, at, error, is_baseline) for k, (c, y) in enumerate(columns)]
        return listed or [("a", None, None, None, None, None, None, None, at, error, is_baseline)]

    def arrive(*captures):
        made = spark.createDataFrame([r for c in captures for r in c], W.ARRIVING)
        made.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        q = W.closed_captures(W.arriving(spark, f"{tmp_path}/in"), "2 days", f"{tmp_path}/closed", f"{tmp_path}/c1")
        q.awaitTermination()
        W.watch_transitions(spark, f"{tmp_path}/closed", f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
        out = spark.read.schema(W.TRANSITIONS).parquet(f"{tmp_path}/out").orderBy("checked_at").collect()
        return [(DAY.index(r["checked_at"]), r["before"], r["state"], r["appeared"], r["vanished"]) for r in out]

    x, y, z = ("x", "int"), ("y", "int"), ("x", "text")
    first = arrive(
        rows(DAY[0], True, x), rows(DAY[0], False, x), rows(DAY[1], False, x, y), rows(DAY[2], False, x, y),
        rows(DAY[3], False, z), rows(DAY[4], False, x), rows(DAY[9], False, x, y),
    )
    told = [(1, "ok", "drift", 1, 0), (3, "drift", "drift", 1, 1), (4, "drift", "ok", 0, 0)]
    assert first == told  # the ninth day is not closed yet
    second = arrive(
        rows(DAY[2], False, z),  # late: not judged
        rows(DAY[9], False, x, y),  # repeated: once
        rows(DAY[10], False, error="gone"), rows(DAY[11], False, x, y), rows(DAY[12], True, x, y),
        rows(DAY[13], False, x, y), rows(DAY[20], False, x, y),
    )
    assert second == [*told, (9, "ok", "drift", 1, 0), (10, "drift", "error", None, None), (11, "error", "drift", 1, 0),
                      (13, "drift", "ok", 0, 0)]
