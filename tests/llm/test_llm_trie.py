import hashlib
import random
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from fleetgauge.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
DIGEST = {}


def plain(conversations):
    """Nodes of the trie of {number: [(role, text), ...]}, one path at a time."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in members if p}
        ends = sorted(c for c in own if len(conversations[c]) == len(path))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own),
            sum(len(p) == len(path) + 1 for p in under), sum(p not in parents for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in under if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rebuilt(rows):
    def place(row):
        name = f"{len((row[2] or '').encode())}:{row[2] or ''}{row[3] or ''}"
        return (row[1] is not None, row[1] or 0, hashlib.sha256(name.encode()).hexdigest()[:32])

    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=place):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for conv, turns in own.items():
        h = crc32(str(conv).encode()) % 4
        first = conv - (abs(conv) % 20 if conv >= 0 else -(abs(conv) % 20))
        out[conv] = own.get(first, [])[:h] + turns[h:]
    return out


def rows_of(found):
    return sorted((tuple(r[c] for c in trie.NODE) for r in found.collect()), key=str)


ODD = [
    (1, None, None, None), (1, 1, "user", "a  b c\x0bd"), (1, 1, "user", "a  b c\x0bd"),
    (1, 1, "user", "z"), (0, 2, "assistant", ""), (0, 1, "user", "héllo wörld " * 60_000),
    (-7, 1, "user", "x"), (-20, 5, "us", "er"), (-20, 5, "use", "r"), (None, 1, "user", "lost"),
    (41, 1, "user", "one"), (43, None, "user", "one"), (44, 3, "user", "one two"),
]


def test_odd_rows_equal_brute_force_and_sql(spark, frame, tmp_path):
    assert rows_of(trie.conversation_trie(frame(ODD, SCHEMA).repartition(3))) == plain(rebuilt(ODD))
    pq.write_table(frame(ODD, SCHEMA).toArrow(), tmp_path / "conversations.parquet")
    assert compare(trie.conversation_trie(frame(ODD, SCHEMA)), connect(str(tmp_path)), trie.SQL) == []


def test_empty_table(spark, frame):
    found = trie.conversation_trie(frame([], SCHEMA))
    assert found.columns == trie.NODE and found.collect() == []


@pytest.mark.parametrize("shards", [1, 8, 40])
def test_common_openings_over_many_shards(spark, frame, shards):
    """A third of all conversations are equal, many others share their opening."""
    draw, rows = random.Random(shards), []
    for conv in range(300):
        n = 5 if conv % 3 == 0 else draw.randrange(1, 7)
        for t in range(n):
            text = f"turn {t}" if conv % 3 == 0 or draw.random() < 0.7 else f"own {draw.randrange(4)}"
            rows.append((conv, t, "user" if t % 2 else "assistant", text))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        found = rows_of(trie.conversation_trie(frame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain(rebuilt(rows))


def test_conversations_longer_than_a_matrix(spark, frame):
    """Paths that part after 64 and after 128 turns, among short ones, in several shards."""
    rows = []
    for conv in range(24):
        n = [3, 64, 65, 140, 200, 128][conv % 6]
        rows += [(conv, t, "u", "same words" if t < 60 + 25 * (conv % 4) else f"own {conv % 3}")
                 for t in range(n)]
    expected = plain(rebuilt(rows))
    assert rows_of(trie.conversation_trie(frame(rows, SCHEMA))) == expected


def test_word_counts_are_of_ascii_blanks(spark, frame):
    turns = trie.conversations_of(frame([(1, 1, "u", " a b \t\v\f\r\n c d ")], SCHEMA))
    assert turns.select(F.col("turns")[0]["words"]).first()[0] == 2
