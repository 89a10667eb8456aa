"""Chat formatting that is proved by a round trip through its own grammar."""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table

# The template. A turn is: OPEN role, line feed, text, CLOSE. Nothing stands between turns.
OPEN, CLOSE, ESCAPE = "<turn>", "</turn>\n", "\\"
#: Strings that may not stand unescaped in a text: the template's own, and role headers of other templates.
CONTROL = ("<turn>", "</turn>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "### User:", "### Assistant:", "### System:")


def escape(text: str, strings: tuple[str, ...] = CONTROL) -> str:
    """The escape sign before each control string and before each sign already there."""
    return re.sub("|".join(map(re.escape, (ESCAPE, *strings))), lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], strings: tuple[str, ...]) -> str:
    return "".join(f"{OPEN}{escape(role, (*strings, chr(10)))}\n{escape(text, strings)}{CLOSE}" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, start and end of the escaped text; None outside the grammar.

    One pass from left to right, without a choice at any place: after OPEN the role runs to the first
    line feed that is not escaped, the text to the first CLOSE that is not escaped.
    """
    turns, at = [], 0
    end_of_role, end_of_text = (re.compile(rf"((?:\\.|[^\\{stop}])*?){re.escape(mark)}", re.S) for stop, mark in (("\n", "\n"), ("", CLOSE)))
    while at < len(formatted):
        if not formatted.startswith(OPEN, at) or not (role := end_of_role.match(formatted, at + len(OPEN))):
            return None
        if not (text := end_of_text.match(formatted, role.end())):
            return None
        turns.append((unescape(role[1]), unescape(text[1]), text.start(1), text.end(1)))
        at = text.end()
    return turns


def format_checked(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted conversation and its turns as parsed back, which are the turns given.

    The template's own marks are escaped first, with every control string; where the parser recovers
    anything else than the turns, more characters of the texts are escaped until it recovers them.
    """
    strings = CONTROL
    while True:
        formatted = render(turns, strings)
        parsed = parse(formatted)
        if parsed is not None and [(role, text) for role, text, _, _ in parsed] == turns:
            return formatted, parsed
        more = sorted({c for pair in turns for said in pair for c in said} - {*strings, ESCAPE})
        if not more:
            raise ValueError("a conversation does not survive the round trip")
        strings = (*strings, *more)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, formatted, n_turns, roles, texts, loss_spans, all but the first read back from it.

    loss_spans has start and end, in code points of `formatted`, of every text whose role is trained on.
    Turns are ordered by turn (null first), then role and text. A null role or text is empty, texts of any length are whole; rows with
    a null id belong to no known conversation, and each is one of its own; equal rows are turns of their own; ids of any type stay as they
    are; other columns are ignored; an empty table gives an empty result. A conversation is one row, so it has to fit in memory.
    """

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_checked([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            columns = [
                pa.array([formatted for formatted, _ in done], pa.string()), pa.array([len(turns) for _, turns in done], pa.int64()),
                pa.array([[t[0] for t in turns] for _, turns in done], pa.list_(pa.string())), pa.array([[t[1] for t in turns] for _, turns in done], pa.list_(pa.string())),
                pa.array([[{"start": t[2], "end": t[3]} for t in turns if t[0] in trained] for _, turns in done], spans),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "formatted", "n_turns", "roles", "texts", "loss_spans"])

    kind = rows.schema[id_col].dataType.simpleString()
    empty = F.lit("")
    turns = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t"))
    alone = turns.withColumn("one", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    gathered = alone.groupBy("id", "one").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("one")
    schema = f"id {kind}, formatted string, n_turns long, roles array<string>, texts array<string>, loss_spans array<struct<start:long,end:long>>"
    return gathered.mapInArrow(formed, schema).withColumnRenamed("id", id_col)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, and of a planted one with markup in its texts.

    Rows of the table that have the planted one's id are turns of the same conversation, in order of turn, role and text.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = format_conversations(rows.unionByName(planted))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                every = "".join(f"{role}\n{said}\n" for role, said, _, _ in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                found.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
