"""Token ids in Parquet list columns, and reading them back."""

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from docketry.llm.common import scratch, table

# The pre-tokens of the tokenizer inside Latin-1, where lower case and composition never change the
# length of a text: contractions, runs of letters, single digits, runs of anything else but white space.
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^ \t-\r\x85\xa0{_LETTER}{_DIGIT}]+")
#: Rows of one id from which on they are dealt out by their texts too.
EQUAL_ROWS = 4096
#: Longer words and pieces are encoded each time, so that entries bound a cache's bytes.
CACHED_BYTES = 64
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoded(dict):
    """A worker's cache: word -> bytes of its ids, words being what stands between ASCII white space.

    The tokenizer drops white space and never merges across it. A word that is not known is put together
    from its pre-tokens, which have a cache of their own; only what that lacks goes to the library.
    A full cache becomes the older generation, from which words in use come back. Nothing in it depends on the texts it has seen, so `encoder` keeps it for all tasks of a worker.
    """

    def __init__(self, path: str, room: int = 250_000):
        super().__init__()
        self.library, self.room, self.older, self.parts = tokenizer(path), room, {}, {}
        to_units = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.units = {c: to_units(chr(c))[0][0] for c in range(256)}  # a piece is Latin-1

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8")
            if word.isalpha():  # ASCII letters only
                found = self.parts.get(low := text.lower()) or self.part(low)
            elif _simple(text):
                found = b"".join([self.parts.get(p) or self.part(p) for p in PRE_TOKEN.findall(text.lower())])
            else:
                found = packed(self.library.encode(text, add_special_tokens=False).ids)
        if len(word) > CACHED_BYTES:
            return found
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def part(self, piece: str) -> bytes:
        units = piece if piece.isascii() and piece.isprintable() else piece.translate(self.units)
        found = packed([t.id for t in self.library.model.tokenize(units)])
        if len(piece) <= CACHED_BYTES:
            if len(self.parts) >= self.room:
                self.parts.clear()
            self.parts[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8").split()))


def _simple(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text or SPECIAL.search(text) is None


@lru_cache(1)
def encoder(path: str) -> Encoded:
    return Encoded(path)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 32, page_kb: int = 256, dictionary: bool = True
) -> None:
    """Write doc, ids, n_tokens, part and offset of every row as Parquet, in ascending id order.

    Texts are dealt out by ranges of the id and encoded where they land, so only text is shuffled. The
    ids of a row are one list, dictionary or else delta encoded; the other columns are delta encoded.
    Row groups and pages have bounded sizes and page indexes, so a reader may take some rows, or the
    metadata alone. `offset` is where a row starts within its part, parts ascending with the ids.
    A null id sorts first, equal ids by the first characters of their text, then a hash of it; equal rows are interchangeable, and
    dealt out to as many tasks as their number asks for. A null or empty text has the end id alone, one of any length all its ids; other
    columns are ignored; an empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, at = encoder(tokenizer_path), packed([end_id]), 0
        for batch in batches:
            encoded = [cache.encode(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in encoded], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at + ends[:-1]), pa.array(n), ids], ["doc", "part", "offset", "n_tokens", "ids"])
            at += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    keys = (F.substring("text", 1, 16).alias("head"), F.xxhash64("text").alias("hash"))
    # Ids alone say where most tables part; texts are read for it only where one id has many rows.
    most = rows.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > EQUAL_ROWS:
        dealt = rows.select("*", *keys, F.monotonically_increasing_id().alias("nth")).repartitionByRange("doc", "head", "hash", "nth")
    else:
        dealt = rows.repartitionByRange("doc").select("*", *keys)
    ranged = dealt.sortWithinPartitions("doc", "head", "hash").select("doc", "text")
    encoded = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(encode, f"doc {kind}, part int, offset long, n_tokens long, ids array<int>")
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.page.row.count.limit": 1000,
        "parquet.enable.dictionary": "true", "compression": "zstd", "parquet.enable.dictionary#ids.list.element": str(dictionary).lower(),
    }
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc", "part", "offset", "n_tokens")}
    encoded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_token_files with `start`, the number of ids in all rows before."""
    rows = spark.read.parquet(path)
    # One row for each file, from the metadata columns alone: as many as the job that wrote them had tasks.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").select("doc", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc, start, n_tokens and ids_crc32: the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(crc, f"doc {kind}, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return digest(read_token_files(spark, path)).withColumnRenamed("doc", "doc_id")
