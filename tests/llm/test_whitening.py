"""Components by contour integration against a dense solver, and exact sums against Python integers."""

import math

import numpy as np
import pytest

from quaestor.llm import whitening
from quaestor.llm.queries import QUERIES
from quaestor.llm.whitening import components_in, eigenvalues_above, intervals, principal


def usable_by_hand(spark, folder, dimension):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    return [
        (i, [math.floor(64 * c) + 1_000_000 for c in x])
        for i, x in rows
        if x is not None and len(x) == dimension and all(c is not None and math.isfinite(c) and abs(c) < 2.0**55 for c in x)
    ]


def check(spark, folder, dimension):
    rows = usable_by_hand(spark, folder, dimension)
    n, sums = len(rows), [sum(x[j] for _, x in rows) for j in range(dimension)]
    exact = [[n * v - s for v, s in zip(x, sums)] for _, x in rows]
    centred = np.array([[v / n for v in x] for x in exact])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    found = QUERIES["op13_whitening"](spark, folder).collect()
    assert len(found) == n * len(values) and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    by_component = {}
    for r in found:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        by_component.setdefault(r.component, []).append((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened))
    for c, told in by_component.items():
        expected = sorted((i is None, i or 0, sum(v * v for v in x), z) for (i, _), x, z in zip(rows, exact, centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])))
        told.sort()
        assert [x[:3] for x in told] == [x[:3] for x in expected]
        sign = np.sign(sum(a[3] * b[3] for a, b in zip(told, expected)))
        assert [sign * x[3] for x in told] == pytest.approx([x[3] for x in expected], abs=1e-6)


def test_odd_vectors(spark, odd_tables, empty_tables):
    check(spark, odd_tables, 6)
    assert QUERIES["op13_whitening"](spark, empty_tables).count() == 0


def test_given_vectors(spark):
    check(spark, "/root/testdata/sf0.001", 64)


def of_values(values, seed=1):
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (turn * values) @ turn.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0] * 12,
        [9.0, 3.0, 3.0, 3.0, 1.0, 1.0, 1e-3, 1e-3, 0.0, 0.0],
        list(np.geomspace(1e-9, 1e6, 40)),
        list(1 + 1e-9 * np.arange(30)),
        [0.0] * 5,
        [2.0],
        list(np.linspace(1, 1.2, 70)),
    ],
)
def test_spectra_with_ties_gaps_and_zeros(spark, values):
    matrix = of_values(np.array(values))
    exact = np.linalg.eigvalsh(matrix)[::-1]
    top = max(exact.max(), 1e-300)
    for shift in (top * 0.37, top * 0.9, top * 1.1):
        assert eigenvalues_above(matrix, shift) == int((exact > shift).sum())
    found, vectors = principal(spark, matrix, 32)
    real = exact[exact > top * 1e-12][:32]
    assert len(found) == len(real)
    assert found == pytest.approx(real, abs=1e-12 * top)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max(initial=0) < 1e-11 * top


def test_intervals_hold_what_is_counted():
    matrix = of_values(np.geomspace(0.01, 10, 25))
    exact = np.linalg.eigvalsh(matrix)
    parts = intervals(matrix, 10)
    assert sum(n for _, _, n in parts) >= 10
    for low, high, count in parts:
        assert ((exact > low) & (exact <= high)).sum() == count
        values, _ = components_in(matrix, low, high, count)
        assert sorted(values) == pytest.approx(exact[(exact > low) & (exact <= high)])


def test_equal_and_single_vectors_have_no_components(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_deviations_stay_exact_beyond_63_bits(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 0.0]), (3, [0.0, 5.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in found if r.component == 1} == {1: None, 2: None, 3: (3 * 320 - 384) ** 2}
