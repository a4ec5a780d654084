"""Spectrum slicing and whitening against numpy's own eigenvectors and exact integers."""

from __future__ import annotations

import numpy as np
import pytest

from meterwise.llm import whitening
from meterwise.llm.slicing import Factors, leading, slices


def symmetric(values, seed=1):
    axes, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    made = axes @ np.diag(np.array(values, dtype=float)) @ axes.T
    return (made + made.T) / 2


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_counts_and_solves_of_shifted_factors(size):
    draw = np.random.default_rng(size)
    matrix = symmetric(draw.standard_normal(size) * 10)
    values = np.linalg.eigvalsh(matrix)
    for shift in draw.uniform(values[0] - 1, values[-1] + 1, 20):
        factors, right = Factors(matrix, shift), draw.standard_normal((size, 2))
        assert factors.positive() == (values > shift).sum()
        assert np.allclose((matrix - shift * np.eye(size)) @ factors.solve(right), right, atol=1e-6)


def test_a_zero_diagonal_takes_pivots_of_two():
    assert Factors(np.array([[0.0, 3.0], [3.0, 0.0]]), 0.0).positive() == 1
    assert leading(np.zeros((3, 3)), 2, 0.0)[1].shape == (3, 0)


@pytest.mark.parametrize(
    "values",
    [range(1, 41), [5] * 10 + [1] * 10, [5, 5 - 1e-12, 5 - 1e-8] + [3] * 3 + [0] * 14, [1] * 20, [1e9, 1, 1, 1e-3], np.geomspace(1, 1e-6, 60)],
)
def test_leading_pairs_are_eigenpairs_in_order(values):
    matrix = symmetric(list(values))
    found, vectors = leading(matrix, 12, 1e-10 * np.trace(matrix))
    want = [v for v in sorted(values, reverse=True)[:12] if v > 1e-10 * np.trace(matrix)]
    norm = max(values)
    assert np.allclose(found, want, atol=1e-12 * norm, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-10
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * norm


def test_slices_hold_one_eigenvalue_each():
    matrix = symmetric(range(1, 21))
    for k, s in enumerate(slices(matrix, 5, 0.1)):
        assert (s.above, s.upto) == (k, k + 1) and s.low < 20 - k <= s.high


def brute(vectors, components=32):
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(d) for d in ((n * x - total) ** 2).sum(axis=1)]
    centred = np.array((n * x - total) / n, dtype=float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, values, centred @ axes / np.sqrt(values), np.trace(centred.T @ centred / n)


def test_whitened_rows_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    good = (draw.standard_normal((400, 6)) * [9, 5, 3, 2, 1, 0.5] + [3, 0, 0, 100, 0, -7]).astype(np.float32)
    rows = [(k, [float(c) for c in v], "x", 1) for k, v in enumerate(good)]
    rows += [(None, rows[0][1], "x", 1), (7, rows[7][1], None, 1)]
    bad = [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [], [1.0], [1e30] * 6, [0.0] * 7]
    table = spark.createDataFrame(rows + [(900, v, "y", 2) for v in bad], "vec_id bigint, embedding array<float>, id string, n int").repartition(5)
    n, deviation, values, z, trace = brute([r[1] for r in rows])
    got = whitening.whitened(table).toPandas().sort_values(["id", "deviation", "component"], na_position="last")
    assert len(got) == len(rows) * 6 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert np.allclose(sorted(got.explained.unique(), reverse=True), values / trace, rtol=1e-9)
    own = got[got.id.notna()].drop_duplicates(["id", "component"]).whitened.to_numpy().reshape(-1, 6)
    signs = np.sign((own * z[: len(own)]).sum(axis=0))
    assert np.allclose(own * signs, z[: len(own)], atol=1e-8)


def test_the_same_rows_in_other_partitions_give_the_same_model(spark):
    draw = np.random.default_rng(5)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(draw.standard_normal((300, 4)))]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    models = []
    for parts in (1, 7):
        valid, width = whitening.valid(table.repartition(parts, "vec_id"))
        models.append(whitening.fitted(valid, width))
    assert (models[0].vectors == models[1].vectors).all() and (models[0].values == models[1].values).all()


def test_deviations_beyond_a_long_are_null_and_large_products_exact(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 3.0]), (3, [0.0, 5.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert {r.id: r.deviation for r in got if r.id != 3} == {1: None, 2: None}
    assert sorted(r.component for r in got) == [1, 1, 1]


def test_nothing_to_whiten(spark):
    schema = "vec_id int, embedding array<float>"
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [2.0, 2.0]), (2, [2.0, 2.0])]):
        table = whitening.whitened(spark.createDataFrame(rows, schema))
        assert table.collect() == [] and table.columns[0] == "id" and len(table.columns) == 7
