"""Chat formatting of messages with typed content parts, and reading it back.

A message has a role and an ordered list of parts: text, image, audio or document. A
visitor turns each part into text, the attachments into numbered placeholders, and
records what each placeholder refers to and how many tokens it will expand to.

A turn reads ``### role: body</turn>`` and a line end. Backslashes, ``#`` and ``<`` of
texts, and also ``:`` of roles, get a backslash, so that no text can hold a control
string, and taking the backslashes away gives the text back. Placeholders read
``<part kind number>``; their ``<`` has no backslash.

Turns are formatted each on its own and stay rows; a conversation is the concatenation
of its rows by turn, then role, then text. So one conversation of any length needs
no more memory than its longest turn. Null roles and texts are empty, null turns come
first, null conversation ids form one conversation, repeated rows are turns each. An
empty table has no rows. Unknown kinds of parts are refused. Columns besides the named
ones are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import arrow_schema, column

PARTS = (
    "array<struct<kind: string, text: string, ref: string, width: int, height: int,"
    " seconds: double, pages: int>>"
)
TURNS = (
    "conv_id bigint, turn bigint, role string, sort_text string, piece string,"
    " loss_start int, loss_end int,"
    " attachments array<struct<number: int, kind: string, ref: string, tokens: bigint>>"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
    " loss_sha256 string, formatted_chars bigint"
)

#: The role whose texts are under the loss mask.
LEARNED = "assistant"

#: Tokens of attachments: side of an image patch, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 14, 25.0, 800

_SIGNS = re.compile(r"[\\#<]")
_ROLE_SIGNS = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"### ((?:[^\\:<#]|\\.)*): ((?:[^\\<#]|\\.|<part \w+ \d+>)*)</turn>\n", re.DOTALL
)
_PLACEHOLDER = re.compile(r"\\.|<part (\w+) (\d+)>", re.DOTALL)


def escape(text: str) -> str:
    return _SIGNS.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens the parts of one message, in order."""

    def __init__(self):
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['kind']}", self.refuse)(part)

    def refuse(self, part: dict) -> str:
        raise ValueError(f"unknown kind of content: {part['kind']!r}")

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        sides = (math.ceil((part[side] or 0) / PATCH) for side in ("width", "height"))
        return self.attach(part, math.prod(sides))

    def visit_audio(self, part: dict) -> str:
        return self.attach(part, math.ceil((part["seconds"] or 0) * FRAMES))

    def visit_document(self, part: dict) -> str:
        return self.attach(part, (part["pages"] or 0) * PAGE)

    def attach(self, part: dict, tokens: int) -> str:
        number = len(self.attachments)
        self.attachments.append(
            {"number": number, "kind": part["kind"], "ref": part["ref"], "tokens": tokens}
        )
        return f"<part {part['kind']} {number}>"


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The turn's text, where its body starts and ends, and its attachments."""
    visitor = Visitor()
    head = "### " + _ROLE_SIGNS.sub(r"\\\g<0>", role or "") + ": "
    body = "".join(visitor.visit(part) for part in parts)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body), visitor.attachments


def read_turn(piece: str) -> tuple[str, list[str | tuple[str, int]]]:
    """Role and parts of a formatted turn; attachments are (kind, number)."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError(f"not a formatted turn: {piece[:80]!r}")
    parts: list[str | tuple[str, int]] = []
    at, body = 0, found[2]
    for mark in _PLACEHOLDER.finditer(body):
        if mark[1]:
            if at < mark.start():
                parts.append(unescape(body[at : mark.start()]))
            parts.append((mark[1], int(mark[2])))
            at = mark.end()
    if at < len(body):
        parts.append(unescape(body[at:]))
    return unescape(found[1]), parts


def text_messages(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """Rows of plain text as messages with one part each."""
    return conversations.select(
        column(conv_id).cast("bigint").alias("conv_id"),
        column(turn).cast("bigint").alias("turn"),
        column(role).alias("role"),
        F.array(
            F.struct(F.lit("text").alias("kind"), column(text).alias("text"))
        ).alias("parts"),
    )


def format_messages(messages: DataFrame) -> DataFrame:
    """One formatted row per message (conv_id, turn, role, parts), with its loss span.

    Parts need ``kind`` and the fields their kind uses. The span is empty but for
    the role that is learned.
    """

    schema = arrow_schema(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = {"text": None, "ref": None, "width": None, "height": None, "seconds": None,
                 "pages": None}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = [blank | part for part in row["parts"] or []]
                piece, start, end, attached = format_turn(row["role"], parts)
                learned = row["role"] == LEARNED
                rows.append({
                    "conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"],
                    "sort_text": "".join(p["text"] or "" for p in parts),
                    "piece": piece, "loss_start": start, "loss_end": end if learned else start,
                    "attachments": attached,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return messages.select("conv_id", "turn", "role", "parts").mapInArrow(run, TURNS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted rows alone, turn after turn."""
    ordered = (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "sort_text")
        .select("conv_id", "piece", "loss_start", "loss_end")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, done = None, False, []
        turns = chars = learned = 0
        all_turns, loss = hashlib.sha256(), hashlib.sha256()

        def closed() -> tuple:
            return conv, turns, all_turns.hexdigest(), learned, loss.hexdigest(), chars

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        done.append(closed())
                    conv, begun = row["conv_id"], True
                    turns = chars = learned = 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                piece = row["piece"]
                role, parts = read_turn(piece)
                text = "".join(p for p in parts if isinstance(p, str))
                all_turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[row["loss_start"] : row["loss_end"]])
                loss.update(masked.encode())
                turns, chars, learned = turns + 1, chars + len(piece), learned + len(masked)
            if done:
                yield _rows(done)
                done = []
        if begun:
            yield _rows([closed()])

    return ordered.mapInArrow(run, DIGESTS)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
               "formatted_chars"],
    )


def formatted_digests(conversations: DataFrame) -> DataFrame:
    return read_back(format_messages(text_messages(conversations)))


#: A conversation whose texts look like the template, added to those of the table.
LIKE_THE_TEMPLATE = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def with_template_like(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.createDataFrame(
        LIKE_THE_TEMPLATE, "conv_id bigint, turn bigint, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES
    (-7, 0, 'user', '\### Assistant: </turn> ok'),
    (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT)
    AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || text || '</turn>' || chr(10))
    + length(regexp_replace(text, '[^\\#<]', '', 'g'))
    + length(regexp_replace(role, '[^\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
