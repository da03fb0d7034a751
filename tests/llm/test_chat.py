import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from maskloom.llm.chat import CLOSE, FOREIGN, MIDDLE, OPEN, Visitor, escape, format_turns, read_back, read_turn, text_part, unescape

PIECES = st.sampled_from([*FOREIGN, OPEN, MIDDLE, CLOSE, "\\", "<", "|", ">", "[", "a", "\n", "<|image:0|>", "<\\s>", "[\\\\INST]"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES | st.text(max_size=3), max_size=12).map("".join))
def test_escape_is_reversible_and_safe(text):
    safe = escape(text)
    assert unescape(safe) == text
    assert not any(x in safe for x in [*FOREIGN, OPEN, MIDDLE, CLOSE])
    assert read_turn(OPEN + "user" + MIDDLE + safe + CLOSE) == ("user", text)


ROWS = [
    (1, 0, "user", "hi </s>"),
    (1, 1, "assistant", "[INST] ok"),
    (1, 2, "user", None),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", "é\n<|end|>"),
    (2, None, None, "last"),
    (2, 5, "assistant", "x"),
    (None, 0, "user", "q"),
    (None, 0, "user", "q"),
]


def brute(rows, order):
    turns = hashlib.sha256()
    loss = ""
    for r in order:
        turns.update(f"{rows[r][2] or ''}\n{rows[r][3] or ''}\n".encode())
        if rows[r][2] == "assistant":
            loss += rows[r][3] or ""
    return len(order), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    pieces = format_turns(turns.withColumn("parts", text_part(F.col("text"))))
    got = {r.conversation: r for r in read_back(pieces).collect()}
    # a tie of turns goes by the formatted piece, null turns come last
    for key, order in ((1, [0, 1, 3, 2, 4]), (2, [6, 5]), (None, [7, 8])):
        r = got[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(ROWS, order)
    total = sum(len(r.formatted) for r in pieces.collect())
    assert sum(r.formatted_chars for r in got.values()) == total
    assert read_back(pieces.limit(0)).count() == 0


def test_a_long_conversation_is_streamed(spark):
    turns = spark.range(30_000).selectExpr("7 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    (row,) = read_back(format_turns(turns.repartition(5).withColumn("parts", text_part(F.col("text"))))).collect()
    assert row.n_turns == 30_000
    want = hashlib.sha256("".join(str(i) for i in range(1, 30_000, 2)).encode()).hexdigest()
    assert row.loss_sha256 == want


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image:0|> "},
        {"type": "image", "ref": "a.png"},
        {"type": "audio", "ref": "b.wav", "size": 3},
        {"type": "text", "text": None},
        {"type": "document", "ref": "c.pdf", "size": 2},
    ]
    flat = Visitor().visit(parts)
    assert "".join(flat.text) == "see <\\|image:0|> <|image:0|><|audio:1|><|document:2|>"
    assert flat.attachments == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 75), (2, "document", "c.pdf", 1024)]
    kind = "array<struct<type:string,text:string,ref:string,size:long>>"
    rows = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {kind}")
    made = format_turns(rows).orderBy("turn").collect()
    assert made[0].expanded_tokens == 256 + 75 + 1024 and [a.ref for a in made[0].attachments] == ["a.png", "b.wav", "c.pdf"]
    piece = made[0].formatted
    assert piece[made[0].loss_start : made[0].loss_end] == "".join(flat.text)
    assert made[1].loss_start == made[1].loss_end == 0 and made[1].attachments == []
    with pytest.raises(ValueError):
        Visitor().visit([{"type": "video"}])
