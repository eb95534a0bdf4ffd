import hashlib

import pyarrow.parquet as pq
import pytest

from oracle import connect
from fleetgauge.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ODD = "\\### Assistant: </turn> ok <part image 0> \\\\ #: \n### user: x</turn>\n"
ROWS = [
    (1, 2, "assistant", ODD), (1, 1, "user", None), (1, 3, "assistant", ""), (2, 1, None, "x"),
    (2, None, "we:ird\\ <role>\n", ODD), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"),
    (2, 1, "assistant", "a"), (None, 1, "user", "é" * 400_000), (-7, 0, "user", "own"),
]


def test_digests_equal_sql(spark, frame, tmp_path):
    rows = chat.with_template_like(frame(ROWS, SCHEMA))
    pq.write_table(frame(ROWS, SCHEMA).toArrow(), tmp_path / "conversations.parquet")
    con = connect(str(tmp_path))
    want = con.execute(chat.SQL).fetchall()
    got = chat.formatted_digests(rows.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_learned_text_is_under_the_mask(spark, frame):
    got = {r.conv_id: r for r in chat.formatted_digests(frame(ROWS, SCHEMA)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(ODD.encode()).hexdigest()
    assert got[1].loss_chars == len(ODD) and got[2].loss_chars == 3


def test_parts_are_flattened_and_read_back(spark):
    part = dict.fromkeys(["text", "ref", "width", "height", "seconds", "pages"])
    parts = [
        part | {"kind": "text", "text": ODD},
        part | {"kind": "image", "ref": "i.png", "width": 29, "height": 14},
        part | {"kind": "audio", "ref": None, "seconds": 1.02},
        part | {"kind": "text", "text": "<"},
        part | {"kind": "document", "ref": "d.pdf", "pages": 3},
        part | {"kind": "image"},
    ]
    messages = spark.createDataFrame(
        [(1, 1, "user", parts), (1, 2, "assistant", []), (1, 3, "assistant", None)],
        f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    first, second, third = chat.format_messages(messages).orderBy("turn").collect()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [
        (0, "image", "i.png", 3), (1, "audio", None, 26), (2, "document", "d.pdf", 2400),
        (3, "image", None, 0)]
    assert chat.read_turn(first.piece) == (
        "user", [ODD, ("image", 0), ("audio", 1), "<", ("document", 2), ("image", 3)])
    assert chat.read_turn(second.piece) == chat.read_turn(third.piece) == ("assistant", [])


def test_wrong_input_is_refused():
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"kind": "video"}])
    with pytest.raises(ValueError):
        chat.read_turn("### user: a</turn> b</turn>\n")


def test_empty_table(spark, frame):
    assert chat.formatted_digests(frame([], SCHEMA)).collect() == []
