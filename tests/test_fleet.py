"""Registries, drift, history, snapshots, rollouts and the watch."""

import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.operators import drift as R
from driftkit.operators import fleet as L
from driftkit.sources.history import append_report, load_history
from driftkit.sources.registry import load_registry, save_registry
from driftkit.sources.snapshots import load_index_snapshots, load_snapshots, save_index_snapshot, save_snapshot
from driftkit.streaming.alerts import alert_payload
from driftkit.streaming.watch import snapshot_stream, watch
from tests.test_schema import cat

UTC = datetime.timezone.utc


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour, tzinfo=UTC)


def members(spark, rows):
    full = [(i, *(tuple(r) + (None,) * 4)[:4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, M.REGISTRY)


def test_registry_round_trip_without_tokens(spark, tmp_path):
    reg = members(spark, [("users", "turso://tok@org/users", None, ["region:us"]), ("orders", "/db/orders.db")])
    save_registry(reg, str(tmp_path / "r"))
    back = {r["name"]: r for r in load_registry(spark, str(tmp_path / "r")).collect()}
    assert back["users"]["tags"] == ["region:us"] and back["users"]["dsn"] == "turso://org/users"
    assert back["orders"]["pos"] == 1


def test_registry_problems(spark):
    def problems(rows):
        return {(r["problem"], r["name"]) for r in L.registry_problems(members(spark, rows)).collect()}

    assert {(r["problem"]) for r in L.registry_problems(members(spark, [("a", "x")]).limit(0)).collect()} == {"no databases"}
    assert problems([("", "x")]) == {("no name", "")}
    assert problems([("a", None)]) == {("no dsn", "a")}
    assert problems([("a", "x"), ("a", "y")]) == {("duplicate name", "a")}
    assert problems([("a", "x"), ("b", "y")]) == set()


def test_tags(spark):
    reg = members(spark, [("a", "x", None, ["prod"]), ("b", "x", None, ["staging"]), ("c", "x", None, ["prod", "us"]), ("d", "x")])
    assert [L.fleet_filter(reg, t).count() for t in ("", "prod", "nope")] == [4, 2, 0]


def test_providers(spark):
    reg = members(spark, [("a", "turso://t@o/d"), ("b", "d1://x"), ("c", "/x.db")])
    assert [r["provider"] for r in L.with_provider(reg).orderBy("name").collect()] == ["turso", "d1", "local"]


def test_merge(spark):
    old = members(spark, [("a", "old", "base", ["keep"])])
    new = members(spark, [("a", "new", "other"), ("b", "b1", "bb", ["t"]), ("b", "b2", None, [])])
    merged = L.fleet_merge(old, new)
    got = {r["name"]: (r["dsn"], r["baseline"], r["tags"], r["added"], r["updated"]) for r in merged.collect()}
    assert got == {"a": ("new", "base", ["keep"], 0, 1), "b": ("b2", "bb", ["t"], 1, 1)}
    assert tuple(L.merge_counts(merged).first()) == (1, 2)


def users(spark, database="users", extra=()):
    return cat(spark, {"users": [("id", "INTEGER", False, None, 1), *extra]}, database)


def failed(spark, database):
    return spark.createDataFrame([(database, *[None] * 8, "unable to open")], M.CATALOG)


def test_drift(spark):
    base = users(spark)
    assert R.drift(base, users(spark)).first()["has_drift"] is False
    more = cat(spark, {"users": [("id", "INTEGER", False, None, 1)], "audit_logs": [("id", "INTEGER")]}, "users")
    got = R.drift(base, more).first()
    assert got["has_drift"] and [(c["kind"], c["table"]) for c in got["changes"]] == [("table added", "audit_logs")]
    got = R.drift(more, base).first()
    assert [(c["kind"], c["table"]) for c in got["changes"]] == [("table removed", "audit_logs")]


def test_unreadable_member_has_no_verdict(spark):
    got = R.drift(users(spark), failed(spark, "users")).first()
    assert got["has_drift"] is None and got["error"] == "unable to open" and got["changes"] == []


def test_fleet_states(spark):
    reg = members(spark, [(n, f"/{n}.db") for n in ("new", "bad", "same", "drifted", "newbad", "emptied")])
    base = users(spark, "bad")
    for n in ("same", "drifted", "emptied"):
        base = base.unionByName(users(spark, n))
    live = failed(spark, "bad").unionByName(failed(spark, "newbad")).unionByName(users(spark, "same"))
    live = live.unionByName(users(spark, "drifted", [("email", "TEXT")])).unionByName(users(spark, "new"))
    live = live.unionByName(spark.createDataFrame([("emptied", *[None] * 9)], M.CATALOG))
    states = L.fleet_check(reg, base, live)
    assert {r["database"]: r["state"] for r in states.collect()} == {
        "new": "no-baseline", "newbad": "no-baseline", "bad": "error", "same": "ok", "drifted": "drift",
        "emptied": "drift"}
    assert L.fleet_counts(states).first().asDict() == {
        "ok": 1, "drift": 2, "no_baseline": 2, "error": 1, "has_problems": True}
    assert not L.fleet_counts(states.filter("state = 'ok'")).first()["has_problems"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snaps")
    assert load_snapshots(spark, path).count() == 0
    save_snapshot(users(spark), path, at(1))
    save_snapshot(users(spark, extra=[("email", "TEXT")]).unionByName(failed(spark, "x")), path, at(2))
    save_snapshot(users(spark, "other"), path, at(1, 5))
    stored = load_snapshots(spark, path)
    assert stored.count() == 4
    latest = R.latest_snapshot(stored)
    assert {(r["database"], r["column"]) for r in latest.collect()} == {
        ("users", "id"), ("users", "email"), ("other", "id")}
    since = load_snapshots(spark, path, datetime.date(2024, 1, 2))
    assert since.count() == 2 and "PartitionFilters: [isnotnull(captured_date" in since._jdf.queryExecution().toString()
    reg = members(spark, [("users", "x"), ("none", "x")])
    assert {r["name"]: r["has_baseline"] for r in L.fleet_status(reg, stored).collect()} == {"users": True, "none": False}


def reports(spark, rows):
    return spark.createDataFrame([(s, at(1), t, d, [], None) for s, t, d in rows], M.DRIFT_REPORT)


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    append_report(reports(spark, [("a", at(3), True)]), path)
    append_report(reports(spark, [("a", at(2), False), ("b", at(4), False)]), path)
    (tmp_path / "history" / "hand.json").write_text("\n\n")
    history = load_history(spark, path, ordered=True)
    assert [r["checked_at"].day for r in history.collect()] == [2, 3, 4]
    summary = {r["source"]: r for r in R.history_summary(history).collect()}
    assert (summary["a"]["total_checks"], summary["a"]["drift_count"], summary["b"]["last_drift"]) == (2, 1, None)
    assert summary["a"]["last_checked"] == summary["a"]["last_drift"]
    assert [(r["source"], r["has_drift"]) for r in R.history_last(history, 1).collect()] == [("a", True), ("b", False)]
    (tmp_path / "history" / "bad.json").write_text("{invalid json\n")
    with pytest.raises(Exception):  # noqa: B017
        load_history(spark, path).collect()


def test_history_keeps_microseconds(spark, tmp_path):
    path = str(tmp_path / "h")
    append_report(reports(spark, [("a", at(3).replace(microsecond=123456), True)]), path)
    assert load_history(spark, path).first()["checked_at"].microsecond == 123456


def model(outcomes, canary, dry_run):
    """A rollout walked step by step."""
    states, halted, done = [], False, 0
    for ok in outcomes:
        if dry_run:
            states.append("dry-run" if ok else "failed")
        elif halted:
            states.append("skipped")
        elif canary and done >= canary:
            states.append("canary")
        else:
            states.append("applied" if ok else "failed")
            done, halted = done + ok, halted or not ok
    return states


def test_rollout_states_against_model(spark):
    patterns = list(itertools.product([True, False], repeat=4))
    rows = [(f, p, ok) for f, pattern in enumerate(patterns) for p, ok in enumerate(pattern)]
    outcomes = spark.createDataFrame(rows, "fleet int, pos int, ok boolean")
    for canary, dry_run in itertools.product(range(4), [False, True]):
        got = L.rollout_states(outcomes, canary, dry_run).orderBy("fleet", "pos").collect()
        assert [r["state"] for r in got] == [s for p in patterns for s in model(p, canary, dry_run)]


def test_rollout_states_with_ties_against_model(spark):
    rows = [(f, p // 3, f"m{p % 3}", ok) for f, pattern in enumerate(itertools.product([True, False], repeat=5)) for p, ok in enumerate(pattern)]
    outcomes = spark.createDataFrame(rows, "fleet int, pos int, name string, ok boolean")
    for canary in range(4):
        got = L.rollout_states(outcomes, canary).orderBy("fleet", "pos", "name").collect()
        assert [r["state"] for r in got] == [s for p in itertools.product([True, False], repeat=5) for s in model(p, canary, False)]


def test_rollout_refuses_members_without_a_position(spark):
    outcomes = spark.createDataFrame([(1, None, True), (1, 2, False)], "fleet int, pos int, ok boolean")
    with pytest.raises(Exception, match="no position"):
        L.rollout_states(outcomes).collect()


def test_rollout_counts(spark):
    rows = [(s,) for s in ("applied", "dry-run", "failed", "skipped", "canary")]
    assert tuple(L.rollout_counts(spark.createDataFrame(rows, "state string")).first()) == (2, 1, 2)


def drifted(spark):
    new = cat(spark, {"users": [("id", "BIGINT", False, None, 1)], "logs": [("id", "INTEGER")]}, "db1")
    return R.drift(users(spark, "db1").withColumn("captured_at", F.lit(at(1))), new, checked_at=at(2))


def test_alerts(spark):
    quiet = R.drift(users(spark), users(spark))
    assert alert_payload(quiet).count() == 0 and alert_payload(quiet, "slack").count() == 0
    generic = json.loads(alert_payload(drifted(spark)).first()["payload"])
    assert generic["text"] == "Schema drift detected in db1 (2 changes)"
    assert [c["kind"] for c in generic["result"]["changes"]] == ["column type changed", "table added"]
    slack = json.loads(alert_payload(drifted(spark), "slack").first()["payload"])
    assert slack["blocks"][2]["text"]["text"] == "• `logs` *added*\n• `users` modified — 1 column change(s)"
    assert slack["blocks"][1]["fields"][2]["text"] == "*Baseline*\n2024-01-01 00:00 UTC"
    with pytest.raises(ValueError):
        alert_payload(drifted(spark), "fax")


def test_watch_sees_indexes(spark, tmp_path):
    path, kept, out, mark = (str(tmp_path / n) for n in ("in", "indexes", "out", "checkpoint"))
    index = spark.createDataFrame([("a", "users", "idx", True, None, None)], M.INDEXES)
    baseline = users(spark, "a").withColumn("captured_at", F.lit(at(1)))
    save_index_snapshot(index, kept, at(2))
    save_snapshot(users(spark, "a"), path, at(2))
    save_snapshot(users(spark, "a"), path, at(3))

    def run():
        watch(snapshot_stream(spark, path), lambda: baseline, out, mark, baseline_indexes=index,
              indexes=lambda: load_index_snapshots(spark, kept)).awaitTermination()
        return {(r["checked_at"].day, r["has_drift"]) for r in load_history(spark, out).collect()}

    assert run() == {(2, False), (3, True)}
    save_index_snapshot(index, kept, at(4))
    save_snapshot(users(spark, "a"), path, at(4))
    assert run() == {(2, False), (3, True), (4, False)}


def test_watch(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    baseline = users(spark, "a").unionByName(users(spark, "b")).withColumn("captured_at", F.lit(at(1)))

    def run():
        watch(snapshot_stream(spark, path), baseline, out, mark).awaitTermination()
        return {(r["source"], r["checked_at"].day, r["has_drift"], r["error"])
                for r in load_history(spark, out).collect()}

    save_snapshot(users(spark, "a").unionByName(users(spark, "nobody")), path, at(2))
    first = run()
    assert first == {("a", 2, False, None)}
    assert run() == first
    save_snapshot(users(spark, "a", [("email", "TEXT")]), path, at(3))
    failed(spark, "b").withColumn("captured_at", F.lit(at(3))).write.mode("append").parquet(path + "/captured_date=2024-01-03")
    assert run() == first | {("a", 3, True, None), ("b", 3, None, "unable to open")}
    # The newest batch runs again, as after a failure before it was marked done: nothing is doubled.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    before = load_history(spark, out).count()
    run()
    assert load_history(spark, out).count() == before == 3
