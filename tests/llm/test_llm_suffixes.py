import hashlib
import random

import pytest

from brute import covered, left
from fleetgauge.llm import suffixes
from fleetgauge.sources.tables import table

SCHEMA = "doc_id bigint, text string"


def passage(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choices("abcdé ", k=n))


def rows_of(docs):
    found = suffixes.digests(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str)


def plain(docs):
    out = []
    for (doc, text), flags in zip(docs, covered(docs)):
        spans = sum(f and not b for f, b in zip(flags, b"\0" + flags))
        kept = hashlib.sha256(left(text, flags)).hexdigest()
        out.append((doc, len(flags), sum(flags), spans, kept))
    return sorted(out, key=str)


SHARED, OTHER = passage(0, 230), passage(1, 99)
EDGES = [
    (5, SHARED), (1, passage(2, 50) + SHARED + passage(3, 70) + SHARED), (2, None), (3, ""),
    (4, OTHER), (6, OTHER), (7, "z" * 500), (None, SHARED[10:160]), (8, SHARED[:100]),
    (9, SHARED[1:101] + "q" + SHARED[50:151]), (10, "z" * 100), (-3, passage(4, 3000)),
    (11, passage(4, 3000)[700:900] + SHARED[::-1]), (12, SHARED[::-1]),
]


@pytest.mark.parametrize("group, piece, rows", [(256, 1 << 21, 20_000), (1, 150, 3), (3, 400, 50)])
def test_edges_equal_brute_force(spark, frame, monkeypatch, group, piece, rows):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "ROWS", rows)
    assert rows_of(frame(EDGES, SCHEMA).repartition(4)) == plain(EDGES)


def test_passage_in_very_many_documents(spark, frame, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 4)
    docs = [(i, passage(100 + i, 60 + i % 50) + SHARED + passage(500 + i, i % 90)) for i in range(150)]
    assert rows_of(frame(docs, SCHEMA)) == plain(docs)


def test_documents_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert rows_of(docs) == plain([tuple(r) for r in docs.collect()])


def test_repeated_rows_stay_or_go_together(spark, frame):
    docs = [(2, SHARED), (2, SHARED), (3, SHARED), (2, "other " + SHARED)]
    found = {(r[1], r[2]) for r in rows_of(frame(docs, SCHEMA))}
    size = len(SHARED.encode())
    assert (size, 0) in found and (size, size) in found and (size + 6, size) in found


def test_rows_keep_their_columns(spark, frame):
    docs = frame(EDGES, SCHEMA)
    cut = suffixes.cut_rows(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    found = {r.doc_id: r for r in cut.collect()}
    flags = dict(zip([d for d, _ in EDGES], covered(EDGES)))
    for doc, text in EDGES:
        want = None if text is None else left(text, flags[doc]).decode("utf-8", "ignore")
        assert found[doc].text == want and found[doc].row == "own row"


def test_empty_table(spark, frame):
    assert suffixes.digests(frame([], SCHEMA)).collect() == []
