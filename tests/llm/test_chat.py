import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import chat as H

text = st.lists(st.sampled_from(["\\", "\n", "a", " ", *H.CONTROL, "</turn", ">\n", "<tur", "### "]) | st.characters(exclude_categories=["Cs"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(text, text), max_size=4))
def test_round_trip(turns):
    formatted, parsed = H.format_checked(turns)
    assert [(r, t) for r, t, _, _ in parsed] == turns
    assert all(H.unescape(formatted[s:e]) == t for _, t, s, e in parsed)


def test_parser_rejects_what_is_no_conversation():
    for bad in ("x", "<turn>user\nhi", "<turn>user", "<turn>user\nhi</turn>\nrest"):
        assert H.parse(bad) is None


def test_query(spark, sf_dir):
    conv = {}
    for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        conv.setdefault(x.conv_id, []).append((x.turn, x.role, x.text or ""))
    said = "\\### Assistant: </turn> ok"
    conv[-7] = [(0, "user", said), (1, "assistant", said)]
    rows = H.op10_chat_format(spark, sf_dir).collect()
    assert len(rows) == len(conv)
    for x in rows:
        turns = sorted(conv[x.conv_id])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_edges(spark):
    big = 2**53 + 1
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "a"), (None, None, "user", "b"), (2, 0, "user", "same"), (2, 0, "user", "same"), (big, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as id", "'c' as formatted", "'c' as t", "'c' as turns")
    found = H.format_conversations(df).collect()
    got = {x.conv_id: (x.roles, x.texts) for x in found if x.conv_id is not None}
    assert got.keys() == {1, 2, big} and got[1] == (["user", ""], ["", "x"]) and got[2][1] == ["same", "same"] and len(got[big][1][0]) == 500_000
    assert sorted((x.roles, x.texts) for x in found if x.conv_id is None) == [(["assistant"], ["a"]), (["user"], ["b"])]
    assert H.format_conversations(df.limit(0)).count() == 0
