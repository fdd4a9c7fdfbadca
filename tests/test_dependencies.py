import random

from driftkit import model as M
from driftkit.operators import dependencies as D
from driftkit.operators.dependencies import dependency_levels
from driftkit.operators.migration import migration_plan

TABLES, KEYS = "database string, `table` string", "database string, `table` string, parent string"


def brute(tables, fks):
    """Level, component and whether in a cycle of each (database, table), by plain search."""
    out = {}
    for db in {d for d, _ in tables}:
        nodes = {t for d, t in tables if d == db}
        up = {n: {p for d, t, p in fks if d == db and t == n and p in nodes and p != n} for n in nodes}

        def reach(n):
            seen, todo = set(), list(up[n])
            while todo:
                p = todo.pop()
                if p not in seen:
                    seen.add(p)
                    todo += up[p]
            return seen

        far = {n: reach(n) for n in nodes}
        mates = {n: {n} | {m for m in far[n] if n in far[m]} for n in nodes}

        def level(n):
            above = {p for m in mates[n] for p in up[m]} - mates[n]
            return max((level(p) + 1 for p in above), default=0)

        for n in nodes:
            out[db, n] = (level(n), min(mates[n]), len(mates[n]) > 1)
    return out


def check(spark, tables, fks):
    got = dependency_levels(spark.createDataFrame(tables, TABLES).repartition(3), spark.createDataFrame(fks, KEYS)).collect()
    assert {(r["database"], r["table"]): (r["level"], r["component"], r["in_cycle"]) for r in got} == brute(tables, fks)
    assert len(got) == len(set(tables))
    return got


def test_random_schemas_with_cycles(spark):
    draw = random.Random(1)
    tables, fks = [], []
    for d in range(12):
        names = [f"t{k}" for k in range(draw.randint(1, 12))]
        tables += [(f"d{d}", n) for n in names]
        fks += [(f"d{d}", draw.choice(names), draw.choice(names)) for _ in range(draw.randint(0, 14))]
    got = check(spark, tables + tables[:5], fks + fks[:9])
    assert any(r["in_cycle"] for r in got) and max(r["level"] for r in got) > 2


def test_a_long_chain_and_a_long_cycle(spark):
    tables = [(d, f"t{k:02}") for d in "ab" for k in range(33)]
    fks = [(d, f"t{k:02}", f"t{k - 1:02}") for d in "ab" for k in range(1, 33)] + [("b", "t00", "t32")]
    got = check(spark, tables, fks)
    assert max(r["level"] for r in got if r["database"] == "a") == 32
    assert {r["component"] for r in got if r["database"] == "b"} == {"t00"}


def test_keys_that_lead_nowhere(spark):
    tables = [("a", "t"), ("a", "u"), ("b", "t")]
    fks = [("a", "t", "t"), ("a", "t", None), ("a", "t", "gone"), ("a", "gone", "t"), ("b", "t", "u"), (None, "t", "u")]
    check(spark, tables, fks)
    assert check(spark, tables, []) and dependency_levels(spark.createDataFrame([], TABLES), spark.createDataFrame(fks, KEYS)).count() == 0


def test_a_plan_creates_parents_first_and_drops_them_last(spark):
    kinds = [("zeta", M.TABLE_ADDED), ("alpha", M.TABLE_ADDED), ("old", M.TABLE_REMOVED), ("base", M.TABLE_REMOVED)]
    changes = spark.createDataFrame(
        [("d", k, t, None, None) for t, k in kinds] + [("d", M.COLUMN_ADDED, "mid", "c", None)],
        "database string, kind string, `table` string, subject string, detail string",
    )
    levels = dependency_levels(
        spark.createDataFrame([("d", t) for t in ("zeta", "alpha", "old", "base", "mid")], TABLES),
        spark.createDataFrame([("d", "alpha", "zeta"), ("d", "old", "base")], KEYS),
    )
    plan = migration_plan(changes, None, levels).orderBy("step").collect()
    assert [(r["action"], r["table"]) for r in plan] == [
        ("create table", "zeta"), ("create table", "alpha"), ("add column", "mid"), ("drop table", "old"), ("drop table", "base"),
    ]
    assert [r["table"] for r in migration_plan(changes).orderBy("step").collect()] == ["alpha", "base", "mid", "old", "zeta"]


def test_databases_of_all_sizes_agree(spark, monkeypatch):
    draw = random.Random(7)
    tables, fks = [], []
    for d, size in enumerate([1, 2, 5, 64, 65]):
        names = [f"t{k}" for k in range(size)]
        tables += [(f"d{d}", n) for n in names]
        fks += [(f"d{d}", draw.choice(names), draw.choice(names)) for _ in range(size // 2)]
        fks += [(f"d{d}", f"t{k}", f"t{k - 1}") for k in range(size - size % 9, size)]
    fks += [("d2", "t1", "t0")] * 200
    check(spark, tables, fks)
    # in a row, by the number of rows, by the number of tables
    for most, rows in ((64, 150), (4, 10_000)):
        monkeypatch.setattr(D, "TABLES", most)
        monkeypatch.setattr(D, "ROWS", rows)
        check(spark, tables, fks)


def test_small_databases_take_few_jobs(spark):
    """A fleet of small databases is gathered once; rounds of joins are for large ones."""
    tables = [(f"d{d}", f"t{k}") for d in range(50) for k in range(6)]
    fks = [(f"d{d}", f"t{k}", f"t{k - 1}") for d in range(50) for k in range(1, 6)]
    spark.sparkContext.setJobGroup("levels", "levels")
    got = dependency_levels(spark.createDataFrame(tables, TABLES), spark.createDataFrame(fks, KEYS))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    spark.sparkContext.setJobGroup("", "")
    assert {(r["table"], r["level"]) for r in got.collect()} == {(f"t{k}", k) for k in range(6)}
    assert jobs <= 12


def test_unnamed_tables_and_databases(spark):
    got = dependency_levels(
        spark.createDataFrame([("a", None), ("a", "t"), ("a", "u"), (None, "t"), (None, "u")], TABLES),
        spark.createDataFrame([("a", "u", "t"), (None, "u", "t"), ("a", None, "t")], KEYS),
    ).collect()
    assert sorted((str(r["database"]), str(r["table"]), r["level"], str(r["component"]), r["in_cycle"]) for r in got) == [
        ("None", "t", 0, "t", False), ("None", "u", 0, "u", False),
        ("a", "None", 0, "None", False), ("a", "t", 0, "t", False), ("a", "u", 1, "u", False),
    ]
