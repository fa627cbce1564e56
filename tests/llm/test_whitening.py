"""Whitening against a direct eigen-decomposition."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "x int, embedding array<float>, v string, vec_id long, n string, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(1, v, "v", i, "n", 0) for i, v in vectors], SCHEMA)


def run(spark, vectors):
    x = whitening.integers(frame(spark, vectors))
    model = whitening.fit(x)
    return model, whitening.whiten(x, model).collect()


def direct(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in vectors]
    own = np.array(x, float)
    centred = own - own.mean(axis=0)
    values, vecs = np.linalg.eigh(centred.T @ centred / len(x))
    sums = [sum(c) for c in zip(*x, strict=True)]
    return values[::-1], vecs[:, ::-1], centred, [sum((len(x) * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


@pytest.mark.parametrize("d, n", [(64, 300), (5, 40), (200, 700), (1, 9)])
def test_components(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = [(i // 2, (rng.standard_normal(d) * rng.uniform(0.1, 0.3, d)).tolist()) for i in range(n)]  # ids repeat
    spoiled = [(900, None), (901, [float("nan")] * d), (902, [None] * d), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1))]
    model, got = run(spark, vectors + spoiled)
    values, vecs, centred, deviation = direct(vectors)
    k = min(8, d)
    assert model.n == n and len(got) == n * k and model.identity_error < 1e-9
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-10) and np.allclose([r.explained for r in got[:k]], values[:k] / values.sum(), rtol=1e-10)
    assert np.allclose(np.abs((model.components * vecs[:, :k]).sum(axis=0)), 1, atol=1e-9)
    want = sorted((i, dev, *np.abs(c @ vecs[:, :k] / np.sqrt(values[:k])).round(6)) for (i, _), dev, c in zip(vectors, deviation, centred, strict=True))
    rows = [(got[j].vec_id, got[j].deviation, *(round(abs(r.whitened), 6) for r in got[j : j + k])) for j in range(0, len(got), k)]
    assert [r.component for r in got[:k]] == list(range(1, k + 1))
    assert np.allclose(np.array(sorted(rows), float), np.array(want, float), atol=2e-6)
    assert sorted(r[:2] for r in rows) == sorted(w[:2] for w in want)  # exact


def test_close_eigenvalues_restart_and_certify(spark, monkeypatch):
    monkeypatch.setattr(whitening, "KEPT", 4)  # fewer directions than dimensions: the base is restarted
    monkeypatch.setattr(whitening, "LEFT", 2)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(150).tolist()) for i in range(900)]
    model, _ = run(spark, vectors)
    values, vecs, *_ = direct(vectors)
    assert np.allclose(model.eigenvalues, values[:8], rtol=1e-9) and np.allclose(np.abs((model.components * vecs[:, :8]).sum(axis=0)), 1, atol=1e-7)


def test_without_variance(spark):
    model, got = run(spark, [(i, [0.5, 0.25, -1.0]) for i in range(6)])
    assert model.identity_error == 0 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in got) and len(got) == 18
    model, got = run(spark, [(i, [float(i), float(2 * i), 1.0]) for i in range(6)])
    assert [r.whitened is None for r in got[:3]] == [False, True, True] and model.identity_error < 1e-12
    model, got = run(spark, [(1, [float("nan")]), (2, None)])
    assert model is None and not got


def test_a_deviation_beyond_a_long_is_null(spark):
    _, got = run(spark, [(i, [1e9 * i, 1.0]) for i in range(40)])
    x = [[math.floor(1024 * float(np.float32(1e9 * i))) + 100000, 101024] for i in range(40)]
    x = [[min(v, 1 << 40) for v in row] for row in x]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((40 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in want.items()}
