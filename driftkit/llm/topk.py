"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are packed in blocks in vertical layout, one array per dimension, with
the dimensions that carry most mass first. Every block of queries meets every
block of candidates. A query adds up its score over one block of dimensions
after the other; after each, candidates whose score so far plus the most that
the remaining dimensions can add (the product of the remaining norms) stays
below the k-th best score known are taken out and the rest is compacted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, stored

SCALE = 1024
_SAFE = 2.0**53


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(``id``, ``v`` array of long): floor(scale * x) of every component, x as double.

    Rows whose vector is null or holds a null, NaN or infinite component are left out, as are null keys.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("x"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & good).select(
        "id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks (``dim``, ``block``, ``ids``, ``v``) of at most ``size`` vectors of one length, dimension by dimension.

    Blocks are cut inside the partitions that the rows already have; nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> dict:
            nonlocal made
            ids, vectors = waiting.pop(dim)
            v = np.array(vectors, np.int64).reshape(len(ids), dim).T
            made += 1
            return {"dim": [dim], "block": [base + made], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "v": [np.ascontiguousarray(v).tobytes()]}

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for dim in list(waiting):
            yield block(dim)

    return stored(by_batch(rows, "dim int, block long, n int, ids binary, v binary", work), name)


def _search(k: int, width: int):
    def best(q: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, rest: np.ndarray, floor: float):
        """Ids and scores that may be among the k best of one query; ``floor`` is the k-th best known."""
        left = np.sqrt(np.concatenate((np.cumsum((q * q)[::-1])[::-1], [0]))) if len(q) else np.zeros(1)
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), v.dtype)
        for start in range(0, len(q), width):
            stop = min(start + width, len(q))
            part = v[start:stop]
            score = score + q[start:stop] @ (part if len(alive) == part.shape[1] else part[:, alive])
            bound = left[stop] * rest[stop // width if stop < len(q) else -1][alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:  # what k candidates are sure to reach
                sure = np.partition(score - bound, len(alive) - k)[len(alive) - k]
                floor = max(floor, float(sure))
            keep = score + bound >= floor
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return ids[alive], score

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        at, top, names = None, {}, None

        def rows() -> dict:
            kept = [top[n] for n in range(len(names))]
            return {
                "query_id": np.repeat(names, [len(i) for i, _ in kept]),
                "vec_id": np.concatenate([i for i, _ in kept]),
                "score": np.concatenate([s for _, s in kept]),
            }

        for batch in batches:
            for dim, block, qids, qv, ids, v in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (dim, block):
                    if at is not None:
                        yield rows()
                    at, names = (dim, block), np.frombuffer(qids, np.int64)
                    top = {x: (np.empty(0, np.int64), np.empty(0, np.int64)) for x in range(len(names))}
                    queries = np.frombuffer(qv, np.int64).reshape(dim, len(names))
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(v, np.int64).reshape(dim, len(ids))
                order = np.argsort(-(v.astype(float) ** 2).sum(1), kind="stable")
                x = v[order].astype(float)
                mass = (x * x)[::-1].cumsum(0)[::-1]
                edges = list(range(0, dim, width))
                rest = np.sqrt(np.vstack([mass[e] for e in edges] + [np.zeros(len(ids))])) if dim else np.zeros((1, len(ids)))
                y = queries[order].astype(float)
                exact = dim == 0 or float(np.sqrt((y * y).sum(0).max(initial=0))) * float(rest[0].max(initial=0)) < _SAFE
                use, asked = (x, y) if exact else (v[order], queries[order])
                for n, own in enumerate(names):
                    have_i, have_s = top[n]
                    floor = float(have_s[-1]) if len(have_s) == k else -np.inf
                    if not exact and floor > -np.inf:
                        floor -= abs(floor) * 1e-9  # doubles do not hold such scores in full
                    got_i, got_s = best(asked[:, n], own, ids, use, rest, floor)
                    if len(got_i):
                        i, s = np.concatenate((have_i, got_i)), np.concatenate((have_s, got_s.astype(np.int64)))
                        pick = np.lexsort((i, -s))[:k]
                        top[n] = i[pick], s[pick]
        if at is not None:
            yield rows()

    return work


def top_k(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10,
    block: int = 4096, width: int = 8,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k best of all other rows for each query.

    Queries are the rows whose key is divisible by ``every``; scores are inner
    products of integer vectors, ties go to the smaller key. A query with fewer
    than k candidates gets them all. Vectors that are null or hold a null or
    non-finite component take no part; vectors meet those of their own length
    only. Rows that repeat a key are candidates each, and none is a candidate
    of its own key; different vectors under one query key share its k places.
    An empty table gives an empty result.

    A task holds one block of queries and one of candidates at a time, and
    keeps k rows a query; the k best of all blocks are then ranked after each
    task has dropped what cannot be among them.
    """
    rows = integer_vectors(df, key, vector)
    candidates = _packed(rows, block, "candidates").withColumnRenamed("block", "cand")
    asked = rows.filter(F.col("id") % every == 0).distinct().coalesce(1 + _partitions(rows) // every)
    queries = _packed(asked, block, "queries")
    queries = queries.select("dim", F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("v").alias("qv"))
    sides = candidates.select("dim", "cand").join(queries.select("dim", "q"), "dim")
    deals = F.pmod(F.xxhash64("q", "cand"), F.lit(max(1, _partitions(rows))))
    pairs = sides.join(queries, ["dim", "q"]).join(candidates, ["dim", "cand"]).withColumn("deal", deals)
    pairs = pairs.repartition(max(1, _partitions(rows)), "deal").sortWithinPartitions("dim", "q", "cand")
    found = by_batch(
        pairs.select("dim", "q", "qids", "qv", "ids", "v"), "query_id long, vec_id long, score long", _search(k, width)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
