"""Which columns are a key: declared by a catalog, or found in the rows.

The search goes through the sets of columns by size. A set is left out if it holds
a key already (only minimal keys are listed), if its columns cannot tell so many
rows apart, or if two rows that agree on it turn up in a sample drawn by value, so
that all copies of a value are in it or none. What is left is counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftkit.functions.values import comparable
from driftkit.operators.checks import pk_unique_check
from driftkit.operators.schema_diff import readable

_ERROR = 0.02  # of the sketches
_SPARE = 1.25  # twelve times that error, above the estimate
_SHARE = 64  # one value in so many is looked at before all are


def declared_keys(catalog: DataFrame) -> dict[str, list[str]]:
    """The key columns of each table that a catalog of one database declares, in key order.

    What comes to the driver is as long as the schema is wide.
    """
    rows = readable(catalog).filter(F.col("pk") > 0).select("database", "table", "column", "pk").distinct().collect()
    if len({r["database"] for r in rows}) > 1:
        raise ValueError("keys are those of one database")
    keys: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["table"], r["pk"], r["column"])):
        keys.setdefault(r["table"], []).append(r["column"])
    return keys


def key_candidates(df: DataFrame, most: int = 3, columns: Sequence[str] | None = None) -> list[tuple[str, ...]]:
    """The minimal keys of ``df`` with up to ``most`` columns, smallest first, in column order.

    A key has no NULL and no two equal rows. An empty table has no key that its rows
    could show. One pass takes the counts and sketches, one per size the sample;
    each set that is left costs a grouping by its columns.
    """
    columns = list(columns or df.columns)
    facts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(f"`{c}`").alias(f"__filled{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(_value(df, c), _ERROR).alias(f"__distinct{i}") for i, c in enumerate(columns)],
    ).first()
    rows = facts["__rows"]
    if not rows:
        return []
    about = {c: facts[f"__distinct{i}"] for i, c in enumerate(columns) if facts[f"__filled{i}"] == rows}
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        tried = []
        for names in combinations(about, size):
            apart = 1.0
            for c in names:
                apart *= about[c] * _SPARE
            if apart >= rows and not any(set(key) <= set(names) for key in found):
                tried.append(names)
        repeated = _seen_twice(df, tried) if tried else set()
        found += [names for k, names in enumerate(tried) if k not in repeated and pk_unique_check(df, names).first()["is_unique"]]
    return found


def _value(df: DataFrame, name: str) -> Column:
    return comparable(F.col(f"`{name}`"), df.schema[name].dataType)


def _seen_twice(df: DataFrame, sets: Sequence[Sequence[str]]) -> set[int]:
    """The numbers of the sets on which two of the rows with a sampled value agree.

    A digest stands for the values, so that all sets go through one grouping.
    """
    drawn = []
    for k, names in enumerate(sets):
        values = [_value(df, c) for c in names]
        sampled = F.pmod(F.xxhash64(*values), F.lit(_SHARE)) == 0
        drawn.append(F.when(sampled, F.struct(F.lit(k).alias("set"), F.sha2(F.to_json(F.array(*[
            F.to_json(F.struct(v.alias("v"))) for v in values
        ])), 256).alias("digest"))))
    rows = df.select(F.explode(F.filter(F.array(*drawn), lambda d: d.isNotNull())).alias("d")).select("d.*")
    twice = rows.groupBy("set", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("set").distinct()
    return {r["set"] for r in twice.collect()}


def keys_for(
    old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], given: Mapping[str, Sequence[str]], declared: DataFrame | None
) -> dict[str, list[str]]:
    """The keys to compare by: those given, else those declared whose columns both versions have."""
    keys = {t: list(k) for t, k in given.items()}
    for t, key in (declared_keys(declared) if declared is not None else {}).items():
        shared = set(old[t].columns) & set(new[t].columns) if t in old and t in new else set()
        if t not in keys and set(key) <= shared:
            keys[t] = key
    return keys
