import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import quality as Q


def statistics(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    extra = ["a b c a b c a b", "a a a a", "x\ny\nx\n\n \nx", "a b c d a b c", "# <b> || a", "a\x0bb\x1cc"]
    docs = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(10_000 + i, t, "en", "s") for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string"))
    texts |= {10_000 + i: t for i, t in enumerate(extra)}
    for x in Q.judge(docs).collect():
        want = statistics(texts[x.doc_id])
        assert tuple(x[c] for c in COLUMNS) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_verdicts_follow_the_labels(spark):
    """At a size where groups are large enough: poor documents go, good ones stay."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op5_robust_outliers(spark, sf).where("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([x.kept for x in rows if x.quality == 1]) > 0.99
    assert np.mean([x.kept for x in rows if x.quality == 0]) < 0.1


def brute_distances(x, n, spread, whole=None):
    """The estimate in numpy: two starts, concentration, the smaller determinant, reweighting; `whole` is the language's."""
    least, noise = (np.array([s[i] for s in spread.values()]) for i in (0, 1))
    k = x.shape[1]
    rank = lambda v, share: np.sort(v)[int(np.ceil(share * len(v))) - 1]
    part = lambda share: share / Q._chi2_cdf(Q.chi2_quantile(share, k), k + 2)

    def distance(m, c):
        c = c + np.diag(least**2)
        y = (x - m) * np.sqrt(np.diag(c) / (np.diag(c) + noise**2 / n[:, None]))
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y)

    middle = np.array([rank(c, 0.5) for c in x.T])
    mad = np.array([rank(c, 0.5) for c in np.abs(x - middle).T])
    ends = []
    for m, c in ((middle, np.diag((1.4826 * mad) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(60):  # to the end
            d = distance(m, c)
            core = x[d <= rank(d, Q.COVERAGE)]
            m, c = core.mean(axis=0), part(Q.COVERAGE) * np.cov(core.T, bias=True)
        ends.append((np.linalg.det(c + np.diag(least**2)), m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    core = x[distance(m, c) <= Q.chi2_quantile(Q.REWEIGHTED, k)]
    m, c = core.mean(axis=0), part(Q.REWEIGHTED) * np.cov(core.T, bias=True)
    if whole is not None:
        share = len(core) / (len(core) + Q.SHRINK)
        m, c = share * m + (1 - share) * whole[0], share * c + (1 - share) * whole[1]
    return distance(m, c), (m, c)


def test_outliers_against_brute_force(spark):
    """Two sources of a language, one of them a third outliers that begin on one side, and a small one."""
    r = np.random.default_rng(4)
    spread = {"a": (0.05, 0.5), "b": (0.02, 1.0)}
    x = np.concatenate([r.multivariate_normal([0, 1], [[1, 0.6], [0.6, 0.5]], 900), r.multivariate_normal([1, 0], [[0.2, 0], [0, 0.3]], 300), r.normal(0.5, 0.1, (20, 2))])
    x[:300] = r.normal([9, -6], 0.3, (300, 2))
    source, n = np.repeat(["s", "t", "u"], [900, 300, 20]), r.integers(50, 2000, len(x))
    rows = [(i, "en", str(source[i]), True, int(n[i]), float(p), float(q)) for i, (p, q) in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, lang string, source string, fit boolean, n_words long, a double, b double")
    got = np.array([v.distance for v in Q.outliers(df, ["lang", "source"], spread).orderBy("i").collect()])
    whole = brute_distances(x, n, spread)[1]
    for s in "stu":
        mine = source == s
        assert got[mine] == pytest.approx(brute_distances(x[mine], n[mine], spread, whole)[0], rel=0.02)
    cut = Q.chi2_quantile(1 - Q.REJECT, 2)
    assert (got[:300] > cut).all() and (got[300:] < cut).mean() > 0.999


def test_the_estimate_decides_where_fixed_thresholds_cannot(spark):
    """A source of tables, where signs are the rule, and one of prose, in words of other lengths: what is sound in one is junk in the other."""
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(1, round(r.gauss(k, 1)))))
    text = lambda n, k, sign: " ".join(word(k) + (r.choice("|&#") if r.random() < sign else "") for _ in range(n))
    rows = [(i, text(r.randrange(60, 200), *((8, 0.5) if i % 2 else (4, 0.0))), "en", "tables" if i % 2 else "prose", "sound") for i in range(600)]
    rows += [(1000 + i, text(r.randrange(60, 200), 4, 0.5), "en", "prose", "junk") for i in range(40)] + [(2000 + i, text(r.randrange(60, 200), 4, 0.0), "en", "tables", "junk") for i in range(40)]
    rows += [(3000 + i, text(r.randrange(60, 200), 8, 0.0), "en", "prose", "junk") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label string")
    got = Q.judge(df).join(df.select("doc_id", "label"), "doc_id").collect()
    assert np.mean([x.kept for x in got if x.label == "sound"]) >= 0.99 and np.mean([x.kept for x in got if x.label == "junk"]) <= 0.02
    # No threshold on a statistic does it, in either direction: at best some two thirds are told rightly.
    for value in (lambda x: x.n_symbols / x.n_words, lambda x: x.word_chars / x.n_words):
        sound, junk = (np.array([value(x) for x in got if x.label == label]) for label in ("sound", "junk"))
        right = [((sound <= t).mean() + (junk > t).mean()) / 2 for t in {*sound, *junk, -1.0}]
        assert max(*right, 1 - min(right)) < 0.8


def test_chi2():
    assert Q.chi2_quantile(0.95, 4) == pytest.approx(9.487729, rel=1e-6)
    assert Q.chi2_quantile(0.5, 1) == pytest.approx(0.4549364, rel=1e-6)


def test_edges(edges, nothing):
    got = Q.judge(edges).collect()
    assert len(got) == edges.count()
    assert not any(x.kept for x in got)
    assert Q.judge(nothing).count() == 0
    fine = edges.withColumn("text", F.lit(" ".join(f"word{i}" for i in range(60))))
    assert all(x.kept for x in Q.judge(fine).collect())
