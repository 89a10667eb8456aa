import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import token_counts as C
from docketry.llm import token_files as T
from docketry.llm.common import scratch

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
odd = st.text(st.sampled_from(list(" \n\r\t▁abAZ'ÀéÉßµªº²½×\x85\xa0\x00.,œŒİſ 你😀Σς\x1c<|>s")) | st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=400, deadline=None)
@given(odd)
def test_lengths_match_the_library(text):
    lengths = C.Lengths(MODEL, {}, 50)
    assert sum(map(lengths.__getitem__, C.pre_tokens(text))) == len(C.processor(MODEL).encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(odd | st.sampled_from(["<|endoftext|>", "'LL", "don't"]), max_size=5).map("".join))
def test_ids_match_the_library(text):
    assert T.Encoded(WORDS, 20).encode(text) == T.packed(T.tokenizer(WORDS).encode(text, add_special_tokens=False).ids)


def test_a_cache_serves_all_tasks_of_a_worker(spark, sf_dir, tmp_path):
    """The words that a task has encoded are known to later tasks in the same worker."""
    T.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{tmp_path}/t", WORDS, 1)

    def known(batches):
        for _ in batches:
            yield T.pa.RecordBatch.from_pydict({"n": [len(T.encoder(WORDS))]})

    assert max(r.n for r in spark.range(0, 4, 1, 4).mapInArrow(known, "n long").collect()) > 1000


def test_units_of_latin_1():
    """The table of units agrees with the library's byte level for every character, also in words."""
    units = T.Encoded(WORDS).units
    to_units = T.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    assert all(f"a{chr(c)}é".translate(units) == to_units(f"a{chr(c)}é")[0][0] for c in range(256))


def test_counts_query(spark, sf_dir):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for x in C.op4_token_counts(spark, sf_dir).collect():
        n = len(C.processor(MODEL).encode(texts[x.doc_id]))
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(texts[x.doc_id].encode()), n, n > 4096)


def test_counts_edges(edges, nothing):
    got = C.count_tokens(edges, MODEL).collect()
    assert len(got) == edges.count()
    assert all(x.n_tokens == 0 for x in got if x.n_bytes == 0)
    assert [x.over_limit for x in got if x.doc_id == 4] == [True]
    assert C.count_tokens(nothing, MODEL).count() == 0


def brute(rows):
    at, want = 0, []
    for d, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*T.tokenizer(WORDS).encode(text or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_files_query(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, T.op7_token_files(spark, sf_dir).collect())) == brute(rows)


@pytest.mark.parametrize("dictionary", [True, False])
def test_files_edges(spark, edges, nothing, dictionary):
    path = scratch(spark, "t")
    T.write_token_files(edges, path, WORDS, 1, dictionary=dictionary)
    got = [tuple(x) for x in T.digest(T.read_token_files(spark, path)).collect()]
    key = lambda x: x[1]
    want = brute([(x.doc_id, x.text) for x in edges.collect()])
    assert [x[1:] for x in sorted(got, key=key)] == [x[1:] for x in want]
    empty = scratch(spark, "t")
    T.write_token_files(nothing, empty, WORDS, 1)
    assert T.read_token_files(spark, empty).count() == 0


def test_many_rows_of_one_id(spark, monkeypatch):
    """Half of the rows have no id and a third of these one text: no task gets them all, and starts have no gaps."""
    monkeypatch.setattr(T, "EQUAL_ROWS", 100)
    rows = [(None, "the same text" if i % 3 else f"text {i} of its own") for i in range(3000)] + [(i, "x y") for i in range(3000)]
    path = scratch(spark, "t")
    T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, WORDS, 1)
    parts = spark.read.parquet(path).groupBy("part").count().collect()
    assert max(x["count"] for x in parts) < 3 * np.median([x["count"] for x in parts])
    got = sorted((x.start, x.n_tokens) for x in T.read_token_files(spark, path).collect())
    assert len(got) == 6000 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_file_format(spark, sf_dir, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = f"{tmp_path}/t"
    T.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, WORDS, 1)
    meta = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings
    assert any("DELTA" in e for e in columns["offset"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
