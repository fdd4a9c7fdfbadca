"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "__found"


def _null_safe(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``others`` with its keys renamed out of the way, and the condition that matches them to ``rows``."""
    names = [f"__key{i}" for i in range(len(keys))]
    renamed = others.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    matches = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return renamed, reduce(lambda a, b: a & b, matches)


def lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key.

    A key repeated in ``rows`` is left to the adaptive skew join: the null-safe
    condition keeps both join inputs plain shuffles, which that rule can split.
    """
    renamed, match = _null_safe(rows, facts, keys)
    return rows.join(renamed, match, "left").drop(*[f"__key{i}" for i in range(len(keys))])


def membership(rows: DataFrame, members: DataFrame, keys: Sequence[str], present: bool) -> DataFrame:
    """``rows`` whose key is among those of ``members``, or is not.

    The member keys are made distinct first, map-side, so a key repeated there
    shuffles once per task. A lookup of a mark stands in for the semi and anti
    joins, because the optimizer would move those below an aggregation in
    ``rows`` and shuffle what it was to reduce.
    """
    marked = members.select(*[F.col(f"`{k}`") for k in keys]).distinct().withColumn(_FOUND, F.lit(True))
    found = F.col(_FOUND)
    return lookup(rows, marked, keys).filter(found.isNotNull() if present else found.isNull()).drop(_FOUND)


def without_match(counted: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``counted``, one per key, whose key is not among the distinct ``known`` ones; NULL equals nothing.

    Both sides are aggregated by the key, so their shuffles serve the join too.
    """
    marked = known.withColumn(_FOUND, F.lit(True))
    return counted.join(marked, list(keys), "left").filter(F.col(_FOUND).isNull()).drop(_FOUND)
