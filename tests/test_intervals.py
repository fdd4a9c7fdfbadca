import datetime
import random

import pytest

from driftkit import model as M
from driftkit.sources import intervals as V

DAY = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k) for k in range(40)]


def rows(database, day, *columns, error=None):
    made = [(database, "t", k, c, y, False, None, 0, DAY[day], error) for k, (c, y) in enumerate(columns)]
    return made or [(database, None, None, None, None, None, None, None, DAY[day], error)]


def add(spark, path, *captures):
    V.append_captures(spark.createDataFrame([r for c in captures for r in c], M.CATALOG).repartition(3), str(path))
    return V.open_store(spark, str(path))


def plain(df):
    return sorted(map(str, [tuple(r) for r in df.collect()]))


X, Y, Z = ("x", "int"), ("y", "int"), ("x", "text")


def test_an_unchanged_capture_adds_no_events(spark, tmp_path):
    store = add(spark, tmp_path, rows("a", 0, X, Y), rows("a", 1, X, Y))
    assert store.events.count() == 2 and store.captures.count() == 2
    store = add(spark, tmp_path, rows("a", 2, X, Y), rows("b", 2, X))
    assert store.events.count() == 3 and store.captures.count() == 4


def test_lines_that_go_and_come_back(spark, tmp_path):
    store = add(spark, tmp_path, rows("a", 0, X), rows("a", 1, X, Y), rows("a", 2, X))
    store = add(spark, tmp_path, rows("a", 3, X, Y), rows("a", 4, Z))
    spans = {(r["line"], r["since"]): (r["until"], r["valid_from"], r["valid_to"]) for r in V.intervals(store).collect()}
    assert sorted(v[0] is None for v in spans.values()) == [False, False, False, True]
    assert sorted((k[1], v[0]) for k, v in spans.items() if '"y"' in k[0]) == [(2, 3), (4, 5)]
    (ended,) = [v for k, v in spans.items() if k[1] == 1]
    assert ended == (5, DAY[0], DAY[4])


@pytest.mark.parametrize("seed", range(2))
def test_every_capture_is_rebuilt(spark, tmp_path, seed):
    draw = random.Random(seed)
    captures = []
    for database in ("hot", "a", "b"):
        for day in sorted(draw.sample(range(40), 25 if database == "hot" else 6)):
            some = [(c, draw.choice(["int", "text"])) for c in "uvwxyz" if draw.random() < 0.6]
            captures.append(rows(database, day, *some, *some[:1]))  # one line twice
    store = None
    for first, last in ((0, 15), (15, 16), (16, 40)):
        part = [c for c in captures if first <= DAY.index(c[0][8]) < last]
        if part:
            store = add(spark, tmp_path, *part)
    want = [r for c in captures for r in c if r[1] is not None]
    assert plain(V.every_capture(store)) == sorted(str(r) for r in want)
    for at in (DAY[15], DAY[20], None):
        taken = {}
        for c in captures:
            if at is None or c[0][8] <= at:
                taken[c[0][0]] = c
        newest = [r for c in taken.values() for r in c if r[1] is not None]
        assert plain(V.captures_as_of(store, at)) == sorted(str(r) for r in newest)


def test_unreadable_members_and_empty_databases(spark, tmp_path):
    store = add(spark, tmp_path, rows("a", 0, X), rows("b", 0, error="gone"))
    store = add(spark, tmp_path, rows("a", 1))
    assert [r["capture"] for r in store.captures.orderBy("capture").collect()] == [1, 2]
    assert V.captures_as_of(store).count() == 0 and V.captures_as_of(store, DAY[0]).count() == 1


def test_an_older_capture_is_refused(spark, tmp_path):
    add(spark, tmp_path, rows("a", 5, X))
    with pytest.raises(Exception, match="not newer"):
        add(spark, tmp_path, rows("a", 5, Y))
    assert V.open_store(spark, str(tmp_path)).events.count() == 1


def test_an_append_that_broke_off_does_not_count(spark, tmp_path):
    add(spark, tmp_path, rows("a", 0, X))
    lost = spark.createDataFrame([("a", '{"table":"t","column":"y"}', 1, 2, True, "lost")], V.EVENTS)
    lost.write.mode("append").parquet(f"{tmp_path}/events")
    store = V.open_store(spark, str(tmp_path))
    assert store.events.count() == 1
    store = add(spark, tmp_path, rows("a", 1, X, Y))
    assert [r["column"] for r in V.captures_as_of(store).orderBy("column").collect()] == ["x", "y"]


def test_nothing_stored(spark, tmp_path):
    store = V.open_store(spark, str(tmp_path / "none"))
    assert V.intervals(store).count() == V.every_capture(store).count() == V.captures_as_of(store).count() == 0
