"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred vectors are the rows of a matrix that stays distributed. A step takes
the right vector v to the left one, u = Yv, and that back, Y'u; both products
leave one pass over the rows, which returns a few numbers per dimension. Left
vectors have an entry per row and are never stored or sent: a row's entries follow
from its own values by the recurrence, for the driver keeps its coefficients. Each
new vector is orthogonalised against all that came before. The singular values of
the small bidiagonal matrix are the deviations, its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import by_batch, scratch, stored

SCALE, SHIFT = 1024, 100_000
MOST = 8
NONE = 1e-12  # of the whole deviation: less is rounding
CONVERGED = 1e-14
LEAST = 1e-11  # of the trace: a component with less has no direction of its own


def fixed_point(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``id``, ``x``): floor(1024 c) + 100000 of every entry c, as longs.

    Rows without a vector, with an empty one, or with a null, NaN or infinite entry
    are left out. An entry beyond the longs is an error.
    """
    c = df[vector]
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def entry(e):
        scaled = F.floor(e.cast("double") * SCALE)
        beyond = F.raise_error(F.lit("an entry is too large for a whole number")).cast("bigint")
        return F.when(F.abs(e.cast("double")) < 2.0**52, scaled.cast("bigint") + SHIFT).otherwise(beyond)

    return df.filter(whole).select(df[key].alias("id"), F.transform(c, entry).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, a row each."""
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums per dimension; ``floor`` and ``rest`` split the mean."""

    n: int
    sums: tuple[int, ...]

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Entries less their mean; the whole part is taken off first, exactly."""
        return (x - self.floor).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None beyond the longs."""
        off = x - self.floor
        left = [s % self.n for s in self.sums]
        reach = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if reach**2 * len(left) < 1 << 63:
            return ((off * self.n - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = ((off.astype(object) * self.n - np.array(left, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _totals(rows: DataFrame, work) -> dict[int, float]:
    """The sums by position over all rows of what ``work`` returns for the batches, a partition's first."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield {"at": np.arange(len(total), dtype=np.int32), "v": total}

    kind = "long" if work is _halves else "double"
    found = by_batch(rows.select("x"), f"at int, v {kind}", run)
    return {r["at"]: r["v"] for r in found.groupBy("at").agg(F.sum("v").alias("v")).collect()}


def _halves(x: np.ndarray) -> np.ndarray:
    """Upper and lower halves of the entries, summed apart, so that no sum overflows."""
    return np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), [len(x)]])


def centre(rows: DataFrame) -> Centre | None:
    """The centre of the vectors; None where there are none."""
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().limit(2).collect()]
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths have no covariance")
    d = lengths[0]
    found = _totals(rows, _halves)
    return Centre(int(found[2 * d]), tuple((int(found[k]) << 32) + int(found[d + k]) for k in range(d)))


class _Lanczos:
    """Bidiagonalisation of the centred rows, apart from the directions in ``locked``."""

    def __init__(self, rows: DataFrame, at: Centre, trace: float, locked: np.ndarray, seed: int):
        self.rows, self.at, self.locked = rows, at, locked
        self.d = len(at.sums)
        self.scale = np.sqrt(trace)
        self.draw = np.random.default_rng(seed)
        self.right = np.zeros((self.d, 0))  # the v
        self.live: list[int] = []  # the v that have a left vector
        self.back = np.zeros((self.d, 0))  # Y'u of these
        self.b = np.zeros((0, 0))  # Y right = left b
        self.rest = 0.0  # the last length off the diagonal

    def _free(self, w: np.ndarray) -> np.ndarray:
        """``w`` less its part in all earlier directions, taken off twice."""
        every = np.hstack([self.locked, self.right])
        for _ in range(2):
            w = w - every @ (every.T @ w)
        return w

    def _next(self) -> np.ndarray | None:
        """The next right vector; a random one where the last led nowhere new."""
        if self.right.shape[1] + self.locked.shape[1] >= self.d:
            return None
        if self.live and self.live[-1] == self.right.shape[1] - 1:
            w = self._free(self.back[:, -1])
            self.rest = float(np.linalg.norm(w))
            if self.rest > NONE * self.scale:
                return w / self.rest
        self.rest = 0.0
        w = self._free(self._free(self.draw.standard_normal(self.d)))
        return w / np.linalg.norm(w)

    def step(self) -> bool:
        """One more right and left vector, by one pass over the rows; False when the space is used up."""
        v = self._next()
        if v is None:
            return False
        at, j = self.at, len(self.live)
        known, bidiagonal = self.right[:, self.live], self.b[:, self.live]
        rest = self.rest

        def work(x: np.ndarray) -> np.ndarray:
            y = at.apply(x)
            t = y @ v
            left = np.linalg.solve(bidiagonal.T, (y @ known).T).T if j else np.zeros((len(y), 0))
            if j:
                t = t - rest * left[:, -1]
            return np.concatenate([left.T @ t, y.T @ t, [t @ t]])

        found = _totals(self.rows, work)
        sums = np.array([found[k] for k in range(len(found))])
        over, back, square = sums[:j], sums[j:-1], sums[-1]
        size = np.sqrt(max(square - over @ over, 0.0))
        column = over.copy()
        if j:
            column[-1] += rest
        self.b = np.hstack([self.b, column[:, None]])
        self.right = np.hstack([self.right, v[:, None]])
        if size > NONE * self.scale:
            self.b = np.vstack([self.b, np.append(np.zeros(self.b.shape[1] - 1), size)])
            self.live.append(self.right.shape[1] - 1)
            self.back = np.hstack([self.back, ((back - self.back @ over) / size)[:, None]])
        return True

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors, and how far each is from being one."""
        if not self.b.size:
            return np.zeros(0), np.zeros((self.d, 0)), np.zeros(0)
        p, s, qt = np.linalg.svd(self.b, full_matrices=False)
        w = self._free(self.back[:, -1]) if self.live[-1] == self.right.shape[1] - 1 else np.zeros(self.d)
        return s, self.right @ qt.T, np.abs(np.linalg.norm(w) * p[-1])

    def run(self, wanted: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Values and vectors once ``wanted`` have converged, and whether the whole space is used up.

        From half of the space on the other half is cheaper than a second look.
        """
        while self.step():
            k = self.right.shape[1] + self.locked.shape[1]
            if 2 * k < self.d and k % 4 == 0:
                s, q, off = self.found()
                if len(s) > wanted and (off[:wanted] <= CONVERGED * self.scale).all():
                    return s, q, False
        s, q, _ = self.found()
        return s, q, True


@dataclass(frozen=True)
class Components:
    """Unit ``vectors`` (a column each) with falling ``values``, of the covariance whose trace is given."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.apply(x) @ self.vectors / np.sqrt(self.values)


def components(rows: DataFrame, at: Centre, most: int = MOST, seed: int = 1) -> Components:
    """The first ``most`` principal components of ``rows`` (``id``, ``x``).

    Lanczos sees one direction of equal values at a time, so after the first run
    another starts among all that is orthogonal to what was found, until it finds
    nothing larger; where a run has used up the space nothing can be missing.
    Fewer come back where the rows span fewer.
    """
    d = len(at.sums)
    trace = _totals(rows, lambda x: (at.apply(x) ** 2).sum(keepdims=True).ravel())[0]
    values, vectors = np.zeros(0), np.zeros((d, 0))
    while trace > 0:
        s, q, whole = _Lanczos(rows, at, trace, vectors, seed).run(most)
        before = values
        every, found = np.concatenate([values, s[:most]]), np.hstack([vectors, q[:, :most]])
        order = np.argsort(-every, kind="stable")[:most]
        values, vectors = every[order], found[:, order]
        if whole or (len(before) == most and values[-1] <= before[-1] * (1 + 1e-10)):
            break
        seed += 1
    kept = values**2 > LEAST * trace
    vectors, _ = np.linalg.qr(vectors[:, kept]) if kept.any() else (vectors[:, kept], None)
    return Components(at, vectors, values[kept] ** 2 / at.n, trace / at.n)


def identity_error(rows: DataFrame, found: Components) -> float:
    """The largest entry of the whitened rows' covariance less the identity; 0 without components."""
    k = len(found.values)
    if not k:
        return 0.0

    def work(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums = _totals(rows, work)
    flat = np.array([sums[i] for i in range(k + k * k)]) / found.centre.n
    mean = flat[:k]
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``).

    A row per remaining row and component. ``deviation`` is n^2 times the squared
    distance from the mean, null where it goes beyond the longs; ``explained`` is
    the component's share of the trace. Repeated rows and keys count as often as
    they come; a null key is a key. Equal vectors only, a single row or an empty
    table have no components and so no rows. Only two columns are read, whatever
    else the table holds. Vectors of different lengths are an error.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = stored(fixed_point(df, key, vector), "entries")
    at = centre(rows)
    if at is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, {SCHEMA}")
    found = components(rows, at, most)
    error = identity_error(rows, found)
    k, explained = len(found.values), found.values / found.trace if found.trace else found.values

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, m = _matrix(batch), batch.num_rows
            yield {
                "id": batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "n": np.full(m * k, at.n),
                "deviation": [v for v in at.deviations(x) for _ in range(k)],
                "whitened": found.whitened(x).ravel(),
                "explained": np.tile(explained, m),
                "identity_error": np.full(m * k, error),
            }

    return by_batch(rows, f"id {kind}, {SCHEMA}", work).withColumnRenamed("id", key)
