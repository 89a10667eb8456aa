import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import runs as R


def brute_runs(tokens):
    """Every maximal stretch, period by period; the smallest period alone counts."""
    found = {}
    for p in range(1, len(tokens) // 4 + 1):
        i = 0
        while i + p < len(tokens):
            j = i
            while j + p < len(tokens) and tokens[j] == tokens[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    smallest = [(s, n, p) for (s, n), p in found.items() if not any(all(tokens[k] == tokens[k + q] for k in range(s, s + n - q)) for q in range(1, p))]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def brute_lyndon(codes):
    n, found = len(codes), []
    for i in range(n):
        j = i + 1
        while j < n and codes[j:] > codes[i:]:
            j += 1
        found.append(j - i)
    return found


def changed(doc_id, tokens):
    h, n = zlib.crc32(str(doc_id).encode()), len(tokens)
    if h % 10 or not n:
        return tokens
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    tokens = changed(doc_id, (text or "").encode().split())
    found = brute_runs(tokens)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    drop = {k for s, n, p in found for k in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = b" ".join(w for k, w in enumerate(tokens) if k not in drop)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_grouping_gives_the_lyndon_array_under_both_orders(codes):
    assert R.lyndon_array(codes) == brute_lyndon(codes)
    assert R.lyndon_array([-c for c in codes]) == brute_lyndon([-c for c in codes])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9)), max_size=6))
def test_runs_are_those_of_a_plain_search(parts):
    tokens = [w.encode() for part, times in parts for w in part * times]
    assert R.runs_in(tokens) == brute_runs(tokens)


def test_runs_inside_runs_and_long_ones():
    rng = random.Random(3)
    for _ in range(60):
        inner = [rng.choice("xy") for _ in range(rng.randint(1, 4))] * rng.randint(4, 7)
        outer = (inner + [rng.choice("xyz") for _ in range(rng.randint(0, 5))]) * rng.randint(3, 6)
        tokens = [w.encode() for w in [rng.choice("xyz") for _ in range(5)] + outer + ["q"] * rng.randint(0, 8)]
        assert R.runs_in(tokens) == brute_runs(tokens)
    assert R.runs_in([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert R.runs_in([str(i % 50_000).encode() for i in range(200_001)]) == [(0, 200_001, 50_000)]


def test_stretches_lose_no_run_and_leave_plain_text_unsorted():
    plain = np.random.default_rng(1).zipf(1.3, 5000)
    assert sum(b - a for a, b in R.stretches(plain)) < 500
    twice = np.concatenate([np.arange(3000), np.arange(3000)])
    assert not list(R.stretches(twice))


def test_query(spark, sf_dir):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {x.doc_id: tuple(x)[1:] for x in R.op13_lyndon_runs(spark, sf_dir).collect()}
    assert got == {i: expected(i, t) for i, t in texts.items()}
    assert sum(x[0] > 0 for x in got.values()) > 5


def test_edges(spark, edges, nothing):
    got = R.periodic_runs(edges)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == edges.count()
    by = {(x.doc_id, x.n_words): x for x in rows}
    assert by[1, 0].collapsed == "" and by[2, 0].runs == [] and by[3, 0].runs == [] and by[None, 0].collapsed == ""
    assert by[4, 90_000].runs == [(0, 90_000, 3)] and by[4, 90_000].collapsed == "lorem ipsum dolor"
    assert R.periodic_runs(nothing).count() == 0


@pytest.mark.parametrize("doc_id", [None, 3, 17, 2**53 + 1])
def test_looped(spark, doc_id):
    from pyspark.sql import functions as F

    ids = [doc_id] if doc_id is None else range(doc_id, doc_id + 40)
    rows = [(i, t) for i in ids for t in (None, "", " ", "one", "a b\tc  d e f g h i j k l m n o p")]
    for x in spark.createDataFrame(rows, "doc_id long, text string").withColumn("new", R.looped(F.col("doc_id"), F.col("text"))).collect():
        tokens = (x.text or "").split()
        want = tokens if x.doc_id is None else changed(x.doc_id, tokens)
        assert (x.new or "").split() == want
