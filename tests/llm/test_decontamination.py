import random

import duckdb
import pytest

from docketry.llm import decontamination as D


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_sql(spark, sf_dir):
    df = D.op1_winnowing(spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows_of(df) == sorted(con.execute(D.OP1_SQL).fetchall(), key=repr)


@pytest.mark.parametrize(("seed", "broadcast"), [(1, True), (2, True), (3, False)])
def test_against_brute_force(spark, seed, broadcast, monkeypatch):
    """Few words, so that windows overlap, repeat and tie; items shorter than a window, and one without words."""
    if not broadcast:
        monkeypatch.setattr(D, "fits", lambda df: False)
    r = random.Random(seed)
    word = lambda: r.choice("aBc")
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 8, 12, 13, 14, 30])))) for i in range(12)] + [(99, None)]
    docs = [(i, "".join(word() + r.choice(" .,-!") for _ in range(r.randrange(60)))) for i in range(40)]
    docs += [(100 + i, f"x y {t} z" * 2) for i, t in items]
    split = lambda t: ["".join(c) for c in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    want = {}
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for i, item in items:
            b = split(item)
            n = min(13, len(b))
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    a, b = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in D.judged(D.overlap(a, b)).collect()}
    assert got == want


def test_shuffled_join_against_sql(spark, sf_dir, monkeypatch):
    """With nothing broadcast: the same rows, and no more words in a row than a hit can reach."""
    monkeypatch.setattr(D, "fits", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = D.op1_winnowing(spark, sf_dir)
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        assert rows_of(df) == sorted(con.execute(D.OP1_SQL).fetchall(), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("broadcast", [True, False])
def test_edges(spark, edges, nothing, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(D, "fits", lambda df: False)
    bench = spark.createDataFrame([(1, "same text here", "x"), (None, "one two", "y"), (2, None, None), (3, "", "")], "item_id long, text string, h string")
    got = D.judged(D.overlap(edges, bench)).collect()
    assert len(got) == edges.count()
    assert sorted(x.n_hit for x in got if x["items"] == ["1"]) == [3, 3, 3]
    assert [x.n_hit for x in got if x.doc_id is None and x.n_words] == [2]
    assert D.overlap(nothing, bench).count() == 0
    assert all(x.n_hit == 0 for x in D.judged(D.overlap(edges, bench.limit(0))).collect())
