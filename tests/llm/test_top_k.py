import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import top_k as T


def brute(rows, asked, k, scale=1024):
    """rows: (id, vector). Rows of one id count once, by their best score."""
    x = {}
    for i, v in rows:
        x.setdefault(i, []).append([math.floor(scale * c) for c in v])
    out = {}
    for q in {i for i in x if asked(i)}:
        scores = {i: max(sum(a * b for a, b in zip(u, v, strict=False)) for u in x[q] for v in vs) for i, vs in x.items() if i != q}
        for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1):
            out[q, rank] = (i, scores[i])
    return out


def found(df):
    return {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}


def clustered(n, d=8, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d)) * np.linspace(0.3, 3, groups)[:, None]
    return centres[rng.integers(0, groups, n)] + rng.standard_normal((n, d)) * 0.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=60), st.integers(1, 5), st.integers(2, 6))
def test_tree_covers_parts_and_nests(points, leaf, fan):
    x = np.array(points)
    t = T.build(x, leaf, fan)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for node in range(len(t.lo)):
        own = x[t.order[t.lo[node] : t.hi[node]]]
        assert np.linalg.norm(own - t.centres[node], axis=1).max() <= t.radius[node] + 1e-9
        a, b = t.kids[node]
        if a == b:
            assert len(own) <= leaf or t.radius[node] == 0
            continue
        scale = t.radius[a:b].max()
        assert (t.centres[a] == t.centres[node]).all() and b - a <= fan
        assert [t.lo[a], *t.hi[a:b]] == [*t.lo[a:b], t.hi[node]]
        for i in range(a, b):
            assert all(np.linalg.norm(t.centres[i] - t.centres[j]) >= scale - 1e-9 for j in range(a, i))


@pytest.mark.parametrize("seed", range(4))
def test_block_search_is_exact_and_prunes(seed):
    x = np.floor(clustered(3000, seed=seed) * 1024).astype(np.int64)
    ids = np.random.default_rng(seed).permutation(3000)
    q, d = T.Block.of(ids[:200], x[:200], 16), T.Block.of(ids, x, 64)
    s = T.Search(q, d, np.full(200, T.NONE), 10).run()
    scores = q.x.astype(np.int64) @ d.x.astype(np.int64).T
    for r in range(200):
        order = sorted((-int(v), int(i)) for v, i in zip(scores[r], d.ids, strict=True) if i != q.ids[r])[:10]
        assert [(-int(v), int(i)) for v, i in zip(s.scores[r], s.ids[r], strict=True)] == order
    assert s.compared < 0.5 * 200 * 3000


def test_bounds_hold():
    x = np.floor(clustered(500, seed=5) * 1024).astype(np.int64)
    a, b = T.build(x[:100], 4), T.build(x, 8)
    limit = T.bounds(a, b)
    for i in range(len(a.lo)):
        for j in range(0, len(b.lo), 7):
            assert (x[:100][a.order[a.lo[i] : a.hi[i]]] @ x[b.order[b.lo[j] : b.hi[j]]].T).max() <= limit[i, j]


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in T.op11_dual_cover_tree(spark, sf_dir).collect()}
    assert got == brute(rows, lambda i: i % 100 == 0, 10) and len(got) == 50


def test_many_blocks_and_a_third_alike(spark, monkeypatch):
    monkeypatch.setattr(T, "DATA_ROWS", 100)
    monkeypatch.setattr(T, "QUERY_ROWS", 16)
    x = clustered(1800, seed=9).tolist()
    rows = [(i, v if i % 3 else [0.5] * 8) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert found(T.top_k(df, F.col("vec_id") % 20 == 0, 5)) == brute(rows, lambda i: i % 20 == 0, 5)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(T, "DATA_ROWS", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.sin(i), math.cos(i * i)]) for i in range(0, 30)] + [(0, [math.sin(0), 1.0])] * 3 + [(5, [2.0, 2.0]), (10, [-1.0, 0.5]), (40, [1.0]), (41, [])]
    bad = [(50, None), (60, [1.0, None]), (70, [nan, 1.0]), (80, [inf, 1.0]), (None, [9.0, 9.0]), (None, None)]
    names = ("id", "vector", "cell", "away", "block", "n", "score", "rank", "query_id", "least", "part", "nth")
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in names})
    padded = [(i, [*v, 0.0, 0.0][:2]) for i, v in rows]
    assert found(T.top_k(df, F.col("vec_id") % 10 == 0)) == brute(padded, lambda i: i % 10 == 0, 10)
    few = df.where("vec_id in (0, 7, 50)")
    assert found(T.top_k(few, F.col("vec_id") == 0)) == brute([r for r in padded if r[0] in (0, 7)], lambda i: i == 0, 10)
    assert T.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0 and T.top_k(df, F.lit(False)).count() == 0 and T.top_k(df, F.lit(None).cast("boolean")).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "vec_id long, embedding array<float>")
    assert [x[0] for _, x in sorted(found(T.top_k(ties, F.col("vec_id") == 5, 7)).items())] == [0, 1, 2, 3, 4, 6, 7]


def test_large_components(spark):
    rows = [(i, [1e4 * (i % 7 - 3) + i, 2e5 - i * 31.0, -1e4 * i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(T.top_k(df, F.col("vec_id") % 7 == 0, 4)) == brute(rows, lambda i: i % 7 == 0, 4)
