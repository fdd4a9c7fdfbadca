"""In what order tables can be created: their levels over foreign keys, with cycles as one.

A database of at most ``TABLES`` tables is one row: its tables in order, what each
reaches as the bits of a whole number, all found inside the row, once for all
databases that share their tables and keys. Databases with more
tables, or with more than ``ROWS`` rows to gather, go through rounds of joins: what a
table reaches is found by doubling the length of known ways, so the rounds grow with
the logarithm of the longest one. Tables that reach each other are one component;
levels are counted over components. Such databases go through a round together, and
every round is written before the next one reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftkit.operators.keyed import lookup, membership
from driftkit.operators.schema_diff import DATABASE
from driftkit.session import discard, work_dir

#: Tables of a database that is worked out in its row: the bits of a long.
TABLES = 64
#: Rows of tables and foreign keys, repeats included, that are gathered in a row.
ROWS = 10_000


class _Rounds:
    """Tables written one after the other, in one folder that goes as a whole."""

    def __init__(self, df: DataFrame):
        self.spark, self.n = df.sparkSession, 0
        self.path = f"{work_dir(self.spark).rstrip('/')}/levels-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _reached(edges: DataFrame, by: Sequence[str], rounds: _Rounds) -> DataFrame:
    """Every pair (``child``, ``parent``) that some way of edges joins."""
    ways, n = rounds.store(edges, "ways"), -1
    while n != (n := ways.count()):
        on = ways.select(*by, F.col("child").alias("parent"), F.col("parent").alias("__next"))
        longer = ways.join(on, [*by, "parent"]).select(*by, "child", F.col("__next").alias("parent"))
        ways = rounds.store(ways.unionByName(longer).distinct(), "ways")
    return ways


def _by_rounds(tables: DataFrame, fks: DataFrame, by: Sequence[str], rounds: _Rounds) -> DataFrame:
    """Levels of tables in databases of any size."""
    every = rounds.store(tables.select(*by, "table").distinct(), "tables")

    def known(column: str) -> DataFrame:
        return every.withColumnRenamed("table", column)

    edges = fks.select(*by, F.col("table").alias("child"), "parent").filter("child <> parent").distinct()
    edges = rounds.store(edges.join(known("child"), [*by, "child"]).join(known("parent"), [*by, "parent"]).select(*by, "child", "parent"), "edges")
    ways = _reached(edges, by, rounds)
    back = ways.select(*by, F.col("parent").alias("child"), F.col("child").alias("parent"))
    mutual = ways.join(back, [*by, "child", "parent"]).filter("child <> parent")
    first = mutual.groupBy(*by, F.col("child").alias("table")).agg(F.min("parent").alias("__other"))
    members = rounds.store(lookup(every, first, [*by, "table"]).select(
        *by, "table", F.least(F.coalesce("__other", "table"), "table").alias("component"), F.col("__other").isNotNull().alias("in_cycle"),
    ), "members")

    def component(df: DataFrame, column: str) -> DataFrame:
        names = members.select(*by, F.col("table").alias(column), F.col("component").alias(f"__{column}"))
        return df.join(names, [*by, column]).drop(column).withColumnRenamed(f"__{column}", column)

    over = rounds.store(component(component(edges, "child"), "parent").filter("child <> parent").distinct(), "over")
    levels = rounds.store(members.select(*by, "component", F.lit(0).alias("level")).distinct(), "level")
    top, before = 0, -1
    while top != before:
        above = over.join(levels.withColumnRenamed("component", "parent"), [*by, "parent"])
        raised = above.groupBy(*by, F.col("child").alias("component")).agg((F.max("level") + 1).alias("__raised"))
        levels = rounds.store(lookup(levels, raised, [*by, "component"]).select(
            *by, "component", F.greatest("level", F.coalesce("__raised", F.lit(0))).alias("level")
        ), "level")
        # Level k is right after k rounds, and each round up to the highest level raises the top by one.
        before, top = top, levels.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    return lookup(members, levels, [*by, "component"]).select(*by, "table", "level", "component", "in_cycle")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _has(bits: Column, place: Column) -> Column:
    return bits.bitwiseAND(_bit(place)) != 0


def _bits(places: Column) -> Column:
    """The whole number with the bits at ``places``, counted from 0, set."""
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda all_, k: all_.bitwiseOR(_bit(k)))


def _levels_of(names: Column, edges: Column) -> Column:
    """``table, level, component, in_cycle`` of each of ``names``, which are in order; edges are pairs of places from 0."""
    places = F.transform(names, lambda _, i: i)

    def solved(edges: Column, places: Column) -> Column:
        parents = F.transform(places, lambda i: _bits(F.transform(F.filter(edges, lambda e: e["child"] == i), lambda e: e["parent"])))
        # With the k-th table allowed in between: whoever reaches it reaches what it reaches.
        reached = F.aggregate(places, parents, lambda ways, k: _let(
            ways[k], lambda onward: F.transform(ways, lambda w: F.when(_has(w, k), w.bitwiseOR(onward)).otherwise(w))
        ))
        return _let(reached, lambda reach: placed(reach, places))

    def mutual(reach: Column, i: Column, j: Column) -> Column:
        return _has(reach[i], j) & _has(reach[j], i)

    def placed(reach: Column, places: Column) -> Column:
        above = F.transform(places, lambda i: _bits(F.filter(places, lambda j: _has(reach[i], j) & ~_has(reach[j], i))))
        return _let(above, lambda up: _let(settled(up, places), lambda done: F.transform(names, lambda name, i: F.struct(
            name.alias("table"),
            F.size(F.filter(done, lambda d: ~_has(d, i))).alias("level"),
            F.when(_has(reach[i], i), names[F.filter(places, lambda j: mutual(reach, i, j))[0]]).otherwise(name).alias("component"),
            _has(reach[i], i).alias("in_cycle"),
        ))))

    def settled(up: Column, places: Column) -> Column:
        """The k-th number holds the tables of level k and below: all that is above them is in the one before."""
        start = F.array(F.lit(0).cast("bigint"))
        rounds = F.aggregate(places, start, lambda done, _: _let(F.element_at(done, -1), lambda last: F.concat(
            done, F.array(_bits(F.filter(places, lambda i: up[i].bitwiseAND(F.bitwise_not(last)) == 0)))
        )))
        return F.slice(rounds, 2, F.size(rounds))

    return _let(places, lambda p: _let(edges, lambda e: solved(e, p)))


def _in_rows(graphs: DataFrame, by: Sequence[str], rounds: _Rounds) -> DataFrame:
    """Levels of tables in databases of one row each: ``names`` and ``edges``, both in order.

    Databases of a fleet share their schemas, so each different one is worked out once.
    """
    placed = F.transform("edges", lambda e: F.struct(
        (F.array_position("names", e["child"]) - 1).alias("child"), (F.array_position("names", e["parent"]) - 1).alias("parent"),
    ))
    known = F.filter(placed, lambda e: (e["child"] >= 0) & (e["parent"] >= 0))
    shape = ["names", "edges"]
    solved = rounds.store(graphs.select(*shape).distinct().withColumn("solved", _levels_of(F.col("names"), known)), "solved")
    found = lookup(graphs, solved, shape)
    return found.select(*by, F.explode("solved").alias("t")).select(*by, "t.*")


def dependency_levels(tables: DataFrame, fks: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """``level, component, in_cycle`` of every table (``table``), given foreign keys (``table``, ``parent``).

    A table without parents has level 0, another one more than its highest parent.
    Tables that depend on each other share a level and a ``component``, named after
    the first of them; a table on its own is its own component. A table that refers
    to itself depends on nothing new. Repeated foreign keys count once, those that
    name a table which is not there or is NULL do not count.
    """
    rounds = _Rounds(tables)
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))
    edges = fks.select(*by, F.col("table").alias("child"), "parent").filter(named & F.expr("child <> parent"))
    nothing = F.lit(None).cast("struct<child:string,parent:string>")
    rows = tables.select(*by, F.struct("table").alias("t"), nothing.alias("e")).unionByName(
        edges.select(*by, F.lit(None).cast("struct<table:string>").alias("t"), F.struct("child", "parent").alias("e"))
    )
    crowded = rounds.store(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS).select(*by), "crowded")
    some_crowded = not crowded.isEmpty()
    gathered = membership(rows, crowded, by, False) if some_crowded else rows
    graphs = rounds.store(gathered.groupBy(*by).agg(
        F.array_sort(F.collect_set("t"))["table"].alias("names"), F.array_sort(F.collect_set("e")).alias("edges"),
    ).filter(F.size("names") > 0), "graphs")
    out = _in_rows(graphs.filter(F.size("names") <= TABLES), by, rounds)

    wide = graphs.filter(F.size("names") > TABLES)
    some_wide = not wide.isEmpty()
    if some_crowded or some_wide:
        many = wide.select(*by, F.explode("names").alias("table"))
        refer = wide.select(*by, F.explode("edges").alias("e")).select(*by, F.col("e.child").alias("table"), "e.parent")
        if some_crowded:
            many = many.unionByName(membership(tables.select(*by, "table"), crowded, by, True))
            refer = refer.unionByName(membership(fks.select(*by, "table", "parent"), crowded, by, True))
        out = out.unionByName(_by_rounds(many, refer, by, rounds))
    kept = f"{rounds.path}-levels"
    out.write.parquet(kept)
    discard(rounds.spark, rounds.path)
    return rounds.spark.read.schema(out.schema).parquet(kept)
