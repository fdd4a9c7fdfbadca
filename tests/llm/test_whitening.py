"""Whitened vectors against a dense eigendecomposition, and exact deviations against whole numbers."""

import numpy as np
import pytest

from driftkit.llm.whitening import Centre, centre, components, fixed_point, whiten

SCHEMA = "vec_id long, embedding array<double>, id string, x string, at int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame(
        [(int(i), None if v is None else [None if c is None else float(c) for c in v], "i", "x", 1)
         for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], SCHEMA
    )


def dense(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    y = (off / n).astype(float)
    values, q = np.linalg.eigh(y.T @ y / n)
    return (off**2).sum(1), y, values[::-1], q[:, ::-1]


def check(spark, vectors, near=1e-9, most=8, distinct=True):
    vectors = np.asarray(vectors, float)
    out = whiten(frame(spark, vectors), most=most).toPandas()
    deviation, y, values, q = dense(vectors)
    k = out.component.max()
    assert len(out) == k * len(vectors) and (out.n == len(vectors)).all() and out.identity_error.max() < 1e-4
    assert out.identity_error.nunique() == 1
    for c in range(1, k + 1):
        part = out[out.component == c].sort_values("vec_id")
        assert (part.deviation.to_numpy() == deviation.astype(np.int64)).all()
        assert abs(part.explained.iloc[0] / (values[c - 1] / values.sum()) - 1) < 1e-9
        if distinct:
            z = y @ q[:, c - 1] / np.sqrt(values[c - 1])
            w = part.whitened.to_numpy()
            assert np.abs(w * np.sign(w @ z) - z).max() < near
    return out


def test_a_flat_spectrum(spark):
    check(spark, np.random.default_rng(1).standard_normal((400, 24)))


def test_many_dimensions_stop_once_converged(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((500, 120)) * np.concatenate([[40, 30, 25, 20, 16, 12, 10, 8], np.linspace(1, 0.5, 112)])
    check(spark, vectors)


def test_equal_values_are_all_found(spark):
    out = check(spark, np.vstack([np.eye(20), -np.eye(20)]), distinct=False)
    assert out.component.max() == 8


def test_equal_values_among_many_dimensions_are_all_found(spark):
    # Three directions of one size: a single Lanczos run sees one of them.
    big = np.zeros((6, 100))
    big[[0, 1], 0], big[[2, 3], 1], big[[4, 5], 2] = (9, -9), (9, -9), (9, -9)
    small = np.random.default_rng(3).choice([-0.25, 0.25], (300, 100))
    out = whiten(frame(spark, np.vstack([big, small])), most=4).toPandas()
    *_, values, _ = dense(np.vstack([big, small]))
    got = out.groupby("component").explained.first().to_numpy()
    assert np.allclose(got, values[:4] / values.sum(), rtol=1e-8)


def test_fewer_directions_than_components(spark):
    draw = np.random.default_rng(4)
    out = check(spark, draw.standard_normal((5, 30)))
    assert out.component.max() == 4  # five rows span four directions round their mean
    line = np.outer(np.arange(12), [1, 2, 0, -1]) / 4
    assert check(spark, line).component.max() == 1


def test_rows_that_take_no_part(spark):
    good = np.random.default_rng(5).standard_normal((30, 6))
    bad = [None, [], [None] + [1.0] * 5, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    ids = [*range(30), *range(100, 105)]
    got = whiten(frame(spark, [*good.tolist(), *bad], ids)).toPandas()
    assert set(got.vec_id) == set(range(30)) and (got.n == 30).all()
    alone = whiten(frame(spark, good)).toPandas()
    assert (got.sort_values(["vec_id", "component"]).deviation.to_numpy()
            == alone.sort_values(["vec_id", "component"]).deviation.to_numpy()).all()


def test_repeated_rows_and_keys_count_each(spark):
    vectors = np.random.default_rng(6).standard_normal((10, 3))
    out = whiten(frame(spark, np.vstack([vectors, vectors]), [1] * 20))
    assert out.count() == 60 and out.first()["n"] == 20


@pytest.mark.parametrize("vectors", [np.zeros((0, 3)), np.ones((1, 3)), np.ones((4, 3))])
def test_no_spread_no_components(spark, vectors):
    out = whiten(frame(spark, vectors))
    assert out.count() == 0
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_different_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="lengths"):
        whiten(frame(spark, [[1.0, 2.0], [1.0]]))


def test_sums_and_deviations_are_exact_beyond_doubles():
    at = Centre(3, (3 * 2**52 + 1, 5))
    x = np.array([[2**52, 1], [2**52 + 1, 2], [2**52, 2]], np.int64)
    off = [[3 * int(a) - s for a, s in zip(row, at.sums)] for row in x]
    assert at.deviations(x) == [sum(c * c for c in row) for row in off]
    assert Centre(2, (0,)).deviations(np.array([[2**40], [-(2**40)]], np.int64)) == [None, None]


def test_centre_adds_up_whole_numbers(spark):
    rows = fixed_point(frame(spark, [[1e12, -1e12]] * 5))
    assert centre(rows) == Centre(5, tuple(5 * (1024 * c + 100000) for c in (10**12, -(10**12))))


def test_components_are_orthonormal(spark):
    rows = fixed_point(frame(spark, np.random.default_rng(7).standard_normal((50, 12))))
    found = components(rows, centre(rows), 6)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(6)).max() < 1e-14 and (np.diff(found.values) < 0).all()
