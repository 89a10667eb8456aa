import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows):
    sizes, taken, target = {}, {}, {}
    for x in rows:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
        assert x.taken <= 2 * x["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], max(x["size"] for x in rows if x.source == s))


def test_query(spark, sf_dir):
    mixed = M.op3_entropy_mix(spark, sf_dir)
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    check(mixed.join(sources, "doc_id").collect())
    again = M.op3_entropy_mix(spark, sf_dir)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_blocks_and_hot_source(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)
    r = random.Random(3)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "d", None]), " ".join("w" * r.randrange(1, 40))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix(docs, M.word_count(F.col("text")))
    check(mixed.join(docs.select("doc_id", "source"), "doc_id").collect())


def brute_rates(size, prior, target, cap=2.0):
    """The dual's root by bisection in numpy."""
    x = size / size[size > 0].mean()
    rates = lambda t: np.minimum(prior * np.exp(np.minimum(t * x, 700)), cap)
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (rates(mid) * size).sum() < target else (lo, mid)
    return rates((lo + hi) / 2)


def test_rates_against_a_brute_force_dual(spark):
    """Each document has a tilt of its own: prior * exp(tilt * size) up to the cap, and the targets are met."""
    rows = [(i, "abbbc"[i % 5], "w " * (i % 97), 0.2 + (i % 4)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, q double")
    for prior in (F.col("q"), None):
        got = M.mix(docs, M.word_count(F.col("text")), prior=prior).join(docs.select("doc_id", "source", "q"), "doc_id").collect()
        below = 0
        for s in "abc":
            mine = [x for x in got if x.source == s]
            size, q, rate = (np.array([float(x[c]) for x in mine]) for c in ("size", "q", "rate"))
            assert rate == pytest.approx(brute_rates(size, q if prior is not None else np.ones(len(q)), mine[0].target), abs=1e-6)
            assert (rate * size).sum() == pytest.approx(mine[0].target, rel=1e-8)
            below += len({round(r, 9) for r in rate if 0 < r < 2}) > 20
        assert below
        check(got)


def test_a_third_of_the_rows_alike(spark, monkeypatch):
    """Null and equal ids are counted, not gathered; rows alike share their copies; large ids stay as they are beside nulls."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)
    big = 2**53 + 1
    rows = [(None, "a", "the very same words")] * 9000 + [(big, "a", f"x {i}") for i in range(2000)] + [(big + i, "b", "w " * (i % 30)) for i in range(3000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), M.word_count(F.col("text")), tag=F.xxhash64("text")).collect()
    assert sorted((x.doc_id or 0 for x in got)) == sorted(r[0] or 0 for r in rows)
    null = [x.copies for x in got if x.doc_id is None]
    assert max(null) - min(null) <= 1
    target = {x.target for x in got if x.doc_id is None}.pop()
    assert abs(sum(x.taken for x in got if x.doc_id in (None, big) and x.target == target) - target) <= 0.01 * target


def test_edges(edges, nothing):
    got = M.mix(edges, M.word_count(F.col("text")), tag=F.xxhash64("text")).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(x.doc_id) for x in edges.collect())
    assert all(x.taken == 0 and x.copies == 1 for x in got if x["size"] == 0)
    assert M.mix(nothing, M.word_count(F.col("text"))).count() == 0
