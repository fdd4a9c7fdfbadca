"""Schema migrations planned, measured and carried out as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M
from driftkit.functions.values import cast_or_null, comparable, read_as
from driftkit.operators.fleet import rollout_states
from driftkit.operators.keyed import lookup, without_match
from driftkit.operators.schema_diff import DATABASE, readable

_TABLE = [*DATABASE, "table"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def table_definitions(catalog: DataFrame) -> DataFrame:
    """Per table: ``definition``, its columns in order as text, and ``key``, its key columns in order."""
    text = F.concat_ws(
        " ", F.col("column"), F.when(F.col("type") != "", F.col("type")),
        F.when(F.col("not_null"), "NOT NULL"),
        F.when(F.col("default_value") != "", F.concat(F.lit("DEFAULT "), "default_value")),
    )
    columns = F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text"))))
    key = F.array_sort(F.collect_list(F.when(F.col("pk") > 0, F.struct("pk", "column"))))
    return readable(catalog).groupBy(*_TABLE).agg(
        F.array_join(columns["text"], ", ").alias("definition"), key["column"].alias("key")
    )


def migration_plan(
    changes: DataFrame, new_catalog: DataFrame | None = None, levels: DataFrame | None = None
) -> DataFrame:
    """Ordered steps per database: ``step, table, action, key, detail, warning``.

    A table that loses or changes a column is rebuilt; otherwise its new columns
    are added one by one. Index changes are noted. Steps go by table name. With
    the ``levels`` of tables (``dependency_levels``) tables are created after those
    they refer to, then altered, and dropped before them.
    """

    def items(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("subject", "detail"))))

    tables = changes.groupBy(*_TABLE).agg(
        F.bool_or(F.col("kind") == M.TABLE_ADDED).alias("__added"),
        F.bool_or(F.col("kind") == M.TABLE_REMOVED).alias("__removed"),
        *[items(k).alias(n) for n, k in {
            "__add": M.COLUMN_ADDED, "__drop": M.COLUMN_REMOVED, "__change": M.COLUMN_CHANGED,
            "__new_index": M.INDEX_ADDED, "__old_index": M.INDEX_REMOVED,
        }.items()],
    )
    if new_catalog is not None:
        tables = tables.join(table_definitions(new_catalog), _TABLE, "left")
    else:
        tables = tables.withColumn("definition", F.lit(None).cast("string")).withColumn(
            "key", F.lit(None).cast("array<string>")
        )

    none = F.lit(None).cast("string")
    known = F.col("definition").isNotNull()

    def step(action: str, detail: Column, warning: Column, key: Column | None = None) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            (key if key is not None else F.lit(None)).cast("array<string>").alias("key"),
            detail.cast("string").alias("detail"), warning.cast("string").alias("warning"),
        )

    def each(name: str, action: str) -> Column:
        return F.transform(name, lambda c: step(action, c["subject"], none))

    # The wording of details and warnings.
    described = F.array_join(F.concat(
        F.transform("__drop", lambda c: F.concat(F.lit("remove column "), c["subject"])),
        F.transform("__change", lambda c: F.concat(F.lit("change "), c["subject"], F.lit(" type "), c["detail"])),
        F.transform("__add", lambda c: F.concat(F.lit("add column "), c["subject"])),
    ), ", ")
    losses = F.array_join(F.transform("__drop", lambda c: F.concat(
        F.lit("drops column "), F.col("table"), F.lit("."), c["subject"], F.lit(" and its data"))), "; ")
    unavailable = F.concat(
        F.lit("table "), F.col("table"), F.lit(" needs rebuild but new definition is unavailable — skipped")
    )
    gone = F.concat(F.lit("drops table "), F.col("table"), F.lit(" and ALL its data permanently"))

    rebuilt = step(
        "rebuild table",
        F.when(known, described),
        F.when(~known, unavailable).otherwise(F.nullif(losses, F.lit(""))),
        F.col("key"),
    )
    needs_rebuild = (F.size("__drop") > 0) | (F.size("__change") > 0)
    altered = F.concat(
        F.when(needs_rebuild, F.array(rebuilt)).otherwise(each("__add", "add column")),
        each("__old_index", "drop index"),
        each("__new_index", "note new index"),
    )
    steps = (
        F.when(F.col("__added"), F.array(step("create table", F.col("definition"), none, F.col("key"))))
        .when(F.col("__removed"), F.array(step("drop table", none, gone)))
        .otherwise(altered)
    )
    turn = F.lit(0)
    if levels is not None:
        tables = lookup(tables, levels.select(*_TABLE, F.col("level").alias("__level")), _TABLE)
        level = F.coalesce("__level", F.lit(0))
        phase = F.when(F.col("__added"), 0).when(F.col("__removed"), 2).otherwise(1)
        turn = F.struct(phase.alias("phase"), F.when(F.col("__removed"), -level).otherwise(level).alias("level"))
    listed = tables.select(*_TABLE, steps.alias("__steps"), turn.alias("__turn"))
    earlier = Window.partitionBy(*DATABASE).orderBy("__turn", "table").rowsBetween(Window.unboundedPreceding, -1)
    numbered = listed.withColumn("__before", F.coalesce(F.sum(F.size("__steps")).over(earlier), F.lit(0)))
    return numbered.select(*_TABLE, "__before", F.posexplode("__steps").alias("__i", "s")).select(
        *DATABASE, (F.col("__before") + F.col("__i") + 1).cast("int").alias("step"), "table", "s.*"
    )


def plan_warnings(plan: DataFrame) -> DataFrame:
    """The steps of a plan that destroy something."""
    return plan.filter(F.col("warning").isNotNull())


def migration_risks(changes: DataFrame, counts: DataFrame) -> DataFrame:
    """Risky changes and the rows they touch: ``table, risk, description, rows``.

    ``counts`` has ``rows`` per table of the old database; a table it lacks has
    unknown rows. A new NOT NULL column without a default is a risk only where
    there are rows.
    """
    subject, old, new = F.col("subject"), F.col("old"), F.col("new")
    undefaulted = new["not_null"] & (F.coalesce(new["default_value"], F.lit("")) == "")
    retyped = ~old["type"].eqNullSafe(new["type"])
    risk = (
        F.when(F.col("kind") == M.TABLE_REMOVED, "DROP TABLE")
        .when(F.col("kind") == M.COLUMN_REMOVED, "DROP COLUMN")
        .when((F.col("kind") == M.COLUMN_CHANGED) & retyped, "TYPE CHANGE")
        .when(F.col("kind") == M.COLUMN_CHANGED, "NULLABILITY CHANGE")
        .when((F.col("kind") == M.COLUMN_ADDED) & undefaulted, "ADD COLUMN")
    )
    def nullability(item: Column) -> Column:
        return F.when(item["not_null"], "NOT NULL").otherwise("NULL")

    # The wording of descriptions.
    column = F.concat(F.col("risk"), F.lit(" "), F.col("table"), F.lit("."), subject)
    description = (
        F.when(F.col("risk") == "DROP TABLE",
               F.concat(F.lit("DROP TABLE "), F.col("table"), F.lit(" — all data permanently lost")))
        .when(F.col("risk") == "DROP COLUMN", F.concat(column, F.lit(" — column data permanently lost")))
        .when(F.col("risk") == "TYPE CHANGE",
              F.concat(column, F.lit(" "), F.col("detail"), F.lit(" — values may be coerced")))
        .when(F.col("risk") == "NULLABILITY CHANGE",
              F.concat(column, F.lit(" "), nullability(old), F.lit("→"), nullability(new)))
        .otherwise(F.concat(column, F.lit(" NOT NULL without DEFAULT — rebuild will fail on existing rows")))
    )
    by = [c for c in _TABLE if c in counts.columns]
    return (
        changes.withColumn("risk", risk)
        .filter(F.col("risk").isNotNull())
        .join(counts.select(*by, "rows"), by, "left")
        .filter((F.col("risk") != "ADD COLUMN") | (F.col("rows") > 0))
        .select(*_TABLE, "risk", description.alias("description"), "rows")
    )


def coercion_loss(df: DataFrame, targets: Mapping[str, T.DataType | str]) -> DataFrame:
    """What a type change would really do: ``column, new_type, rows, lost, altered``.

    ``lost`` values cannot be read in the new type at all; ``altered`` ones can,
    but do not come back the same. One pass serves all columns.
    """
    counts = [F.count(F.lit(1)).alias("__rows")]
    for i, (name, new_type) in enumerate(targets.items()):
        old_type = df.schema[name].dataType
        read = cast_or_null(df, _c(name), new_type)
        same = cast_or_null(df, read, old_type).eqNullSafe(_c(name))
        counts += [
            F.count_if(_c(name).isNotNull() & read.isNull()).alias(f"__lost{i}"),
            F.count_if(read.isNotNull() & ~same).alias(f"__altered{i}"),
        ]
    shown = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(t if isinstance(t, str) else t.simpleString()).alias("new_type"),
            F.col("__rows").alias("rows"), F.col(f"__lost{i}").alias("lost"), F.col(f"__altered{i}").alias("altered"),
        )
        for i, (name, t) in enumerate(targets.items())
    ]
    return df.agg(*counts).select(F.explode(F.array(*shown)).alias("c")).select("c.*")


def rebuild_table(
    df: DataFrame,
    target: T.StructType,
    defaults: Mapping[str, object] | None = None,
    on_bad: str = "fail",
) -> DataFrame:
    """``df`` in the layout of ``target``: common columns cast, new ones filled, the rest gone.

    With ``on_bad="fail"`` a value the new type cannot hold, or a NULL in a
    column that must not have any, stops the job; ``"null"`` turns such values
    into NULL.
    """
    if on_bad not in ("fail", "null"):
        raise ValueError("on_bad must be 'fail' or 'null'")
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in target.fields:
        if field.name not in have:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        elif df.schema[field.name].dataType == field.dataType:
            value = _c(field.name)
        else:
            value = read_as(df, field.name, field.dataType)
            if on_bad == "fail":
                unread = _c(field.name).isNotNull() & value.isNull()
                problem = F.lit(f"{field.name}: value does not fit {field.dataType.simpleString()}")
                value = F.when(unread, F.raise_error(problem).cast(field.dataType)).otherwise(value)
        if on_bad == "fail" and not field.nullable:
            problem = F.raise_error(F.lit(f"{field.name}: NULL not allowed")).cast(field.dataType)
            value = F.coalesce(value, problem)
        out.append(value.alias(field.name))
    return df.select(*out)


@dataclass(frozen=True)
class Parent:
    """``columns`` of the migrated table must be found in ``rows.parent_columns``.

    When ``rows`` has the member column too, each member is held against its own
    parent rows.
    """

    columns: tuple[str, ...]
    rows: DataFrame
    parent_columns: tuple[str, ...]


def migration_dry_run(
    df: DataFrame,
    target: T.StructType,
    member: str,
    defaults: Mapping[str, object] | None = None,
    keys: Sequence[str] = (),
    parents: Sequence[Parent] = (),
    on_bad: str = "fail",
) -> DataFrame:
    """What a rebuild would break, per member, without writing anything.

    ``rows, lost_casts, null_violations, duplicate_keys, orphan_rows, ok``.
    Everything is measured on the rebuilt values, so keys that only the cast
    makes equal are found. A value lost in the cast is a violation where NULL
    is not allowed; elsewhere ``on_bad="null"`` lets it pass. A NULL member is a
    member like the others.
    """
    mark = "__member"
    given = defaults or {}
    fields = [f for f in target.fields if f.name != member]
    values = {
        f.name: read_as(df, f.name, f.dataType) if f.name in df.columns else F.lit(given.get(f.name)).cast(f.dataType)
        for f in fields
    }
    # a key may use columns that the rebuild drops
    values |= {c: _c(c) for c in [*keys, *[c for p in parents for c in p.columns]] if c not in values and c != member}

    def total(flags: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b.cast("bigint"), flags, F.lit(0).cast("bigint"))

    retyped = [f.name for f in fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    rows = df.select(
        F.struct(_c(member).alias("value")).alias(mark),  # never NULL, so that a NULL member joins too
        total([_c(n).isNotNull() & values[n].isNull() for n in retyped]).alias("__l"),
        total([values[f.name].isNull() for f in fields if not f.nullable]).alias("__v"),
        *[c.alias(n) for n, c in values.items()],
    )
    types = {f.name: f.dataType for f in rows.schema.fields}
    measures = ("rows", "lost_casts", "null_violations", "duplicate_keys", "orphan_rows")

    def part(found: DataFrame, **given: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return found.select(mark, *[given.get(m, zero).cast("bigint").alias(m) for m in measures])

    base = rows.groupBy(mark).agg(F.count(F.lit(1)).alias("n"), F.sum("__l").alias("l"), F.sum("__v").alias("v"))
    parts = [part(base, rows=F.col("n"), lost_casts=F.col("l"), null_violations=F.col("v"))]

    def named(columns: Sequence[str]) -> list[str]:
        return [mark if c == member else c for c in columns]

    if keys:
        own = [c for c in named(keys) if c != mark]
        key = [comparable(_c(k), types[k]).alias(k) for k in own]
        filled = reduce(lambda a, b: a & b, [_c(k).isNotNull() for k in own], F.lit(True))
        repeated = rows.filter(filled).select(mark, *key).groupBy(mark, *[_c(k) for k in own]).count()
        parts.append(part(repeated.filter("count > 1"), duplicate_keys=F.lit(1)))
    for p in parents:
        own = [mark] if member in p.rows.columns else []
        columns = named(p.columns)
        filled = reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in columns])
        held = rows.filter(filled).groupBy(*dict.fromkeys([mark, *columns])).agg(F.count(F.lit(1)).alias("__n"))
        parent_types = [types[c] for c in columns]
        known = p.rows.select(
            *[F.struct(_c(member).alias("value")).cast(types[mark]).alias(mark) for _ in own],
            *[read_as(p.rows, pc, t).alias(c) for pc, c, t in zip(p.parent_columns, columns, parent_types, strict=True)],
        ).distinct()
        orphans = without_match(held, known, list(dict.fromkeys([*own, *columns])))
        parts.append(part(orphans, orphan_rows=F.col("__n")))
    summed = reduce(DataFrame.unionByName, parts).groupBy(mark).agg(*[F.sum(m).alias(m) for m in measures])
    passes = ("lost_casts",) if on_bad == "null" else ()
    broken = reduce(lambda a, b: a + b, [F.col(m) for m in measures[1:] if m not in passes])
    return summed.select(F.col(f"{mark}.value").alias(member), *measures, (broken == 0).alias("ok"))


def rollout_dry_run(
    tables: DataFrame, target: T.StructType, member: str, order: DataFrame | None = None, canary: int = 0, **measured: object
) -> DataFrame:
    """A dry run of all members in one job: ``tables`` holds their rows, told apart by ``member``.

    What would break per member, and the ``state`` of each: every member tried,
    or, with ``order`` (the registry's ``name`` and ``pos``), as the rollout
    would go, with ``halted``: whether it would stop at a failure.
    """
    found = migration_dry_run(tables, target, member, **measured)
    if order is None:
        return rollout_states(found.withColumn("pos", F.lit(0)), dry_run=True).drop("pos")
    placed = found.join(order.select(F.col("name").alias(member), "pos", "name"), member)
    states = rollout_states(placed.withColumn("fleet", F.lit("fleet")), canary).drop("fleet")
    stopped = states.agg(F.bool_or(F.col("state") == M.FAILED).alias("halted"))
    return states.withColumn("halted", stopped.scalar())
