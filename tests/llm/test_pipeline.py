import re
from collections import Counter

import corpus_pipeline as P
import duckdb
import pytest
import test_mixing
import test_near_dedup
from pyspark.sql import functions as F

from docketry.llm.decontamination import OP1_SQL
from docketry.llm.quality import judge


def contaminated(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return {d for (d,) in con.execute(f"SELECT doc_id FROM ({OP1_SQL}) WHERE contaminated").fetchall()}


@pytest.fixture(scope="module")
def outs(spark, sf_dir, tmp_path_factory):
    """What the stages give one after the other."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        path = f"{tmp_path_factory.mktemp('stages')}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_stages(spark, sf_dir, outs):
    """Every stage against what its operator or a brute force says of the stage's own input."""
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(docs.columns == columns for docs in outs[:4])
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(x.doc_id for x in df.collect())
    assert ids(outs[0]) == ids(judge(first).where("kept"))
    groups = test_near_dedup.brute([(x.doc_id, x.text) for x in outs[0].collect()])
    assert ids(outs[1]) == sorted(d for d, (_, c) in groups.items() if d == c)
    bad = contaminated(sf_dir)
    assert ids(outs[2]) == [d for d in ids(outs[1]) if d not in bad]
    copies = ids(outs[3])
    assert set(copies) <= set(ids(outs[2])) and max(map(copies.count, set(copies))) <= 2
    assert ids(outs[4]) == copies


def test_decontamination_against_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every, bad = {x.doc_id for x in docs.collect()}, contaminated(sf_dir)
    assert bad and every - bad
    assert sorted(x.doc_id for x in P.decontaminate(spark, docs, sf_dir).collect()) == sorted(every - bad)


def test_mixing_against_targets(spark, sf_dir):
    """Copies against targets worked out plainly: within a hundredth or the largest document of each source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {x.doc_id: (x.source, len([w for w in re.split(r"[\x20\x09-\x0D]+", x.text or "") if w])) for x in docs.collect()}
    sizes, taken = Counter(), Counter()
    for source, n in words.values():
        sizes[source] += n
    for x in P.mix_sources(spark, docs, sf_dir).collect():
        taken[x.source] += words[x.doc_id][1]
    for source, target in test_mixing.brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(0.01 * target, max(n for s, n in words.values() if s == source))


def test_run(spark, sf_dir, outs):
    """run() gives what the stages give one after the other."""
    got = sorted(map(tuple, P.run(spark, sf_dir).collect()))
    assert got == sorted(map(tuple, outs[-1].collect())) and got


def test_edges(spark, sf_dir, edges, nothing):
    for docs in (edges, nothing):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert {x.doc_id for x in out.collect()} <= {x.doc_id for x in docs.collect()}
        assert P.shard(spark, docs, sf_dir).count() == docs.count()
    assert P.near_dedup(spark, edges, sf_dir).count() == 10
    fine = edges.withColumn("text", F.concat(F.lit(" ".join(f"word{i}" for i in range(60))), F.coalesce("doc_id", F.lit(0))))
    got = P.quality_rules(spark, fine, sf_dir)
    assert got.columns == edges.columns and sorted(map(str, got.collect())) == sorted(map(str, fine.collect()))
