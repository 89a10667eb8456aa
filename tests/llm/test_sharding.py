import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import sharding as S


def jump_one(key, n):
    """The published loop, in Python integers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    for n in (1, 2, 24, 25, 1000):
        assert S.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_few_keys_move():
    keys = np.arange(20_000)
    one, more = S.jump(keys, 24), S.jump(keys, 25)
    assert set(more[one != more]) == {24} and 0.03 < (one != more).mean() < 0.05
    assert max(Counter(one.tolist()).values()) < 1.15 * 20_000 / 24


def test_query(spark, sf_dir):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    keys = {x.doc_id: x.key for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}
    rows = S.op8_jump_shards(spark, sf_dir).collect()
    slots = {}
    for x in rows:
        data = texts[x.doc_id].encode()
        assert (x["size"], x.text_crc32, x.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (x.shard, x.grown_shard) == (jump_one(keys[x.doc_id], 24), jump_one(keys[x.doc_id], 25))
        assert x.grown_shard in (x.shard, 24)
        slots.setdefault(x.shard, []).append(x.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_third_of_the_rows_alike(spark):
    rows = [(None, "same")] * 9000 + [(5, f"text {i}") for i in range(2000)] + [(i, "x") for i in range(3000)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3).collect()
    assert sorted(x.doc_id or 0 for x in got) == sorted(r[0] or 0 for r in rows) and len({x.shard for x in got if x.doc_id == 5}) == 1
    for s in range(3):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))


def test_edges(edges, nothing):
    got = S.assign_shards(edges, 3).collect()
    assert len(got) == edges.count()
    assert len({x.shard for x in got if x.doc_id == 5}) == 1
    for s in {x.shard for x in got}:
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    assert {x["size"] for x in got if x.doc_id == 1} == {8}
    assert S.assign_shards(nothing, 3).count() == 0
