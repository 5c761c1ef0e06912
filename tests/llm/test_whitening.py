"""Whitening of flow features against whole-matrix arithmetic."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from tapline.llm.whitening import fit_whitener, square_sums, whiten_flows

SCHEMA = "flow_id string, features array<double>, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(f"f{i}", v, "clash") for i, v in enumerate(vectors)], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + [0, 100, -7, 3, 0]).tolist()
    return made + [made[0]] * 30


def test_against_whole_matrix(spark, vectors):
    out = {r.flow_id: r for r in whiten_flows(frame(spark, vectors)).collect()}
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    assert len(out) == n
    exact = [[Fraction(int((n * x[:, i] - total[i]) @ (n * x[:, j] - total[j])), n**3) for j in range(5)] for i in range(5)]
    covariance = np.array(exact, dtype=float)
    values, axes = np.linalg.eigh(covariance)
    whitened = np.array([out[f"f{i}"].whitened for i in range(n)])
    expected = (x - total / n) @ axes[:, ::-1] / np.sqrt(values[::-1])
    assert np.allclose(np.abs(whitened), np.abs(expected), atol=1e-7)
    assert np.allclose(np.cov(whitened.T, bias=True), np.eye(5), atol=1e-9)
    first = out["f0"]
    assert first.deviation == int(((n * x[0] - total) ** 2).sum()) and first.n == n
    assert np.allclose(first.explained, values[::-1] / covariance.trace())
    assert first.identity_error < 1e-9


def test_covariances_are_exact_beside_large_means(spark):
    rows = [[1e6 + (i % 3) / 64, 1e6 + (i % 2) / 64] for i in range(600)]
    model = fit_whitener(frame(spark, rows))
    assert model.trace == pytest.approx(2 / 3 + 1 / 4, rel=1e-14)


def test_unusable_vectors(spark, vectors):
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1e300] + [0.0] * 4, [1.0, 2.0]]
    good = whiten_flows(frame(spark, vectors), components=2)
    mixed = whiten_flows(frame(spark, vectors + bad), components=2)
    assert good.count() == mixed.count() == len(vectors)
    assert good.first().n == mixed.first().n and len(mixed.first().whitened) == 2


def test_degenerate(spark):
    assert whiten_flows(frame(spark, [])).collect() == []
    assert whiten_flows(frame(spark, [None, [None]])).collect() == []
    same = whiten_flows(frame(spark, [[1.0, 2.0]] * 4)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in same] == [(4, 0, [], 0.0)] * 4
    flat = whiten_flows(frame(spark, [[float(i), 2.0 * i, 5.0] for i in range(9)])).collect()
    assert {len(r.whitened) for r in flat} == {1} and flat[0].explained == pytest.approx([1.0])
    tie = spark.createDataFrame([(None, [0.0, 1.0], ""), (None, [1.0, 0.0], ""), ("a", [0.5], ""), ("a", [1.5], "")], SCHEMA)
    assert [r.flow_id for r in whiten_flows(tie).collect()] == [None, None]


def test_large_entries_stay_exact(spark):
    big = [[2.0**33, 0.0], [-(2.0**33), 1.0], [0.0, 0.5]]
    rows = whiten_flows(frame(spark, big)).collect()
    x = [[int(64 * c) for c in v] for v in big]
    total = [sum(c) for c in zip(*x)]
    expected = [sum((3 * c - s) ** 2 for c, s in zip(v, total)) for v in x]
    assert [r.deviation for r in sorted(rows)] == list(map(Decimal, expected))
    values = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    assert {(i, j): v for i, j, v in square_sums(values)} == {(0, 0): (1 << 80) + 9, (0, 1): 49, (1, 1): (1 << 80) + 16}
