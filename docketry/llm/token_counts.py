"""Token counts by a map-side two-tier lookup of pre-token lengths."""

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table

#: The model writes a space as this mark, puts one before the text, and has no piece in which the mark
#: follows another character, nor one with a line feed. So merges never cross these borders.
MARK = "▁"
#: Longer pieces (a text without spaces is one) are counted each time, so that entries bound a cache's bytes.
CACHED_LENGTH = 64
PRE_TOKEN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def pre_tokens(text: str) -> list[str]:
    """Pieces whose lengths add up to the text's: its words where single spaces part them, else marked pieces.

    A marked piece has two spaces before it, and gets no mark from the library.
    """
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return ["  " + p for p in PRE_TOKEN.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


@lru_cache(1)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


class Lengths(dict):
    """Tier two: a worker's cache of the lengths that the library gave, over tier one, the known lengths.

    A full cache becomes the older generation, from which pieces in use come back.
    """

    def __init__(self, model: str, known: dict[str, int], room: int):
        super().__init__(known)
        self.model, self.known, self.room, self.older = processor(model), known, len(known) + room, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            if piece.startswith("  "):  # behind a line feed, which gets the mark in its place
                n = len(self.model.encode("\n" + piece[2:])) - 2
            elif "\n" in piece:
                first, *rest = piece.split("\n")
                n = (self[first] if first else 1) + len(rest) + sum(self["  " + p] for p in rest if p)
            else:
                n = len(self.model.encode(piece))
        if len(piece) > CACHED_LENGTH:
            return n
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
            self.update(self.known)
        self[piece] = n
        return n


def frequent(docs: DataFrame, text_col: str, keep: int, per_task: int) -> list[str]:
    """The most frequent pre-tokens: each task sums up its own and passes on its `per_task` most frequent.

    A choice of what to hold in memory; it has no influence on any count. At most `keep` strings reach
    the driver.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(p for p in pre_tokens(text or "") if len(p) <= CACHED_LENGTH)
                if len(seen) > 10 * per_task:
                    seen = Counter(dict(seen.most_common(2 * per_task)))
        best = seen.most_common(per_task)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(top, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in summed.orderBy(F.desc("n"), "piece").limit(keep).collect()]


def count_tokens(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, keep: int = 30_000, per_task: int = 10_000, room: int = 200_000
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `model` is a path to a sentencepiece model that keeps text as it is (no normalization), with the
    borders described at MARK. A null or empty text has 0 bytes and 0 tokens, one of any length is counted whole; ids of any type may be null or repeat;
    other columns are ignored; an empty table gives an empty result. `keep` lengths are broadcast, up to `room` more are cached in a worker.
    """
    spark = docs.sparkSession
    lookup = Lengths(model, {}, keep)
    known = spark.sparkContext.broadcast({piece: lookup[piece] for piece in frequent(docs, text_col, keep, per_task)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model, known.value, room)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array([sum(map(lengths.__getitem__, pre_tokens(t))) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(2)], ["id", "n", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"))
    counted = rows.mapInArrow(count, f"id {kind}, n long, b long")
    return counted.select(F.col("id").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
