import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import whitening as W


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


def holds(a, k):
    values, vectors = W.leading(a, k)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
    scale = max(1e-300, np.abs(a).sum(axis=1).max())
    assert np.allclose(values, want, rtol=0, atol=1e-13 * scale * len(a))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale * len(a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=6, max_size=6), min_size=6, max_size=6), st.floats(-12, 12))
def test_inertia_counts(rows, shift):
    a = np.array(rows, float)
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    if np.abs(values - shift).min() > 1e-8:
        assert W.positive_inertia(a - shift * np.eye(6)) == (values > shift).sum()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0 + 1e-11, 1.0 + 1e-7, 2.0, 2.001, 50.0]), min_size=1, max_size=12), st.integers(0, 5))
def test_leading_with_close_and_equal_values(values, seed):
    holds(symmetric(values, seed), 8)


@pytest.mark.parametrize("values", [[3.0] * 9, [0.0] * 4, [1e-200, 2e-200], [1e12, 1.0, 1e-6], np.linspace(1, 2, 70), [5.0]])
def test_leading(values):
    holds(symmetric(values), 8)


def expected(rows):
    """Plain numpy and Python integers: n, exact deviations, whitened up to sign, explained."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    return n, far, centred @ q / np.sqrt(e), e / np.trace(v)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {(r.vec_id, r.component): r for r in W.op12_spectrum_slicing(spark, sf_dir).collect()}
    n, far, whitened, explained = expected(rows)
    assert len(got) == 8 * n
    table = np.array([[got[i, c].whitened for c in range(1, 9)] for i, _ in rows])
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.allclose(table, whitened * sign, atol=1e-8)
    assert all(got[i, c].deviation == f and got[i, c].n == n for (i, _), f in zip(rows, far, strict=True) for c in (1, 8))
    assert np.allclose([got[rows[0][0], c].explained for c in range(1, 9)], explained, rtol=1e-9)
    assert {r.identity_error for r in got.values()} == {got[rows[0][0], 1].identity_error} and got[rows[0][0], 1].identity_error < 1e-9
    assert np.abs(table.T @ table / n - np.eye(8)).max() < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i), math.cos(3 * i), float(i % 3), 0.5]) for i in range(40)] + [(7, [math.sin(7), math.cos(21), 1.0, 0.5]), (None, [0.1, 0.2, 0.3, 0.5])]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0]), (52, [nan, 0.0, 0.0, 0.0]), (53, [inf, 0.0, 0.0, 0.0]), (None, None)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "'clash' id", "'clash' vector", "'clash' component", "1 n", "2 i", "3 j", "4 value", "'x' whitened")
    rows = W.whiten(df).collect()
    n, far, whitened, _ = expected(good)
    assert n == 42 and len(rows) == 42 * 3  # the fourth dimension is constant
    assert sorted(int(r.deviation) for r in rows if r.component == 1) == sorted(far) and sum(r.vec_id is None for r in rows) == 3
    assert np.allclose(sorted(abs(r.whitened) for r in rows if r.component == 1), np.sort(np.abs(whitened[:, 0])), atol=1e-8)
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id >= 50")).count() == 0
    alike = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert W.whiten(alike).count() == 0
    short = spark.createDataFrame([(1, [1.0]), (2, [2.0, 5.0]), (3, [])], "vec_id long, embedding array<double>")
    padded = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 5.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    key = lambda r: (r.vec_id, r.component)
    assert sorted(W.whiten(short).collect(), key=key) == sorted(W.whiten(padded).collect(), key=key)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 + i * 1e3, -2e9 + (i * i % 17) * 1e3]) for i in range(30)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    _, far, _, _ = expected(rows)
    assert sorted(int(r.deviation) for r in got) == sorted(far) and got[0].identity_error < 1e-9
