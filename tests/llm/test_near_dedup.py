import random

import numpy as np

from docketry.llm import near_dedup as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets, best = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                best[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {d: (len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(docs)}


def test_against_brute_force(spark):
    """Chains and groups of near copies at all similarities about the threshold, exact copies, short texts."""
    r = random.Random(5)
    docs, n = [], 0
    for g in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 5, 30, 200]))]
        for c in range(r.choice([1, 2, 12])):
            words = list(base)
            for _ in range(r.randrange(0, max(1, len(words) // 12))):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.3:
                base = words
            docs.append((n * 7 % 1009, " ".join(words) if c % 3 else "\t".join(words).upper()))
            n += 1
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = N.op2_odd_sketch_dedup(spark, sf_dir).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == brute(docs)
    assert all(x.kept == (x.doc_id == x.component_id) for x in rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        words = list(base)
        words[r.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = {x.component_id for x in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {x.node: x.comp for x in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for s in (0.6, 0.75, 0.9):
        off = []
        for _ in range(60):
            both = r.integers(0, 2**63, 2000).astype(np.uint64)
            k = round(2000 * (1 - s) / (1 + s))
            a, b = both.copy(), both.copy()
            b[:k] = r.integers(0, 2**63, k).astype(np.uint64)
            x, y = (N.odd_sketch(N.signature(np.unique(v))) for v in (a, b))
            off.append(N.similarity(np.bitwise_count(x ^ y).sum()) - s)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_word_hashes():
    words = [b"a", b"ab", b"ba", b"\x00", b"\x00\x00", b"x" * 5000, b"x" * 5001]
    text = b" \n".join(words) + b" "
    h = N.word_hashes(text)
    assert len(set(h.tolist())) == len(words)
    assert all(N.word_hashes(b"\t" + w)[0] == x for w, x in zip(words, h, strict=True))
    assert len(N.word_hashes(b" \t")) == 0


def test_edges(edges, nothing):
    got = N.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)
    assert {(x.doc_id, x.kept) for x in got if x.component_id == 5 and x.n_shingles == 1} == {(5, True), (6, False)}
    assert all(x.component_id == x.doc_id and x.n_shingles == 0 for x in got if x.doc_id in (1, 2, 3))
    assert N.near_duplicates(nothing).count() == 0
