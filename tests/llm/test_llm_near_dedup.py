import random

import numpy as np
import pytest

from brute import classes as plain
from fleetgauge.llm import near_dedup
from fleetgauge.llm.text import shingle_hashes, word_hashes
from fleetgauge.sources.tables import table

SCHEMA = "doc_id bigint, text string"


def signature(texts):
    hashes, of, count = near_dedup.counted(*shingle_hashes(*word_hashes(texts), short=True))
    return near_dedup.signatures(hashes, of, count, len(texts))


def words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefg", k=6)) for _ in range(n)]


def test_registers_agree_as_often_as_multisets_overlap():
    left, right = [], []
    for i in range(80):
        draw = random.Random(i)
        a = draw.choices(words(i, 30), k=150) * draw.choice([1, 2, 5])
        b = list(a)
        for _ in range(i // 4):
            b[draw.randrange(len(b))] = "other"
        left.append(" ".join(a))
        right.append(" ".join(b + b[: draw.choice([0, 40])]))
    agree = (signature(left) == signature(right)).mean(axis=1)
    like = near_dedup.overlaps(left, right)
    assert abs((agree - like).mean()) < 0.01
    assert np.abs(agree - like).max() < 0.17


def test_signatures_do_not_depend_on_the_batch():
    texts = [" ".join(words(i, n)) for i, n in enumerate([1, 3, 5, 40, 400])]
    together = signature(texts)
    for i, text in enumerate(texts):
        assert (signature([text])[0] == together[i]).all()


def test_classes_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert found == {doc: c for (doc, _), c in zip(rows, plain(rows))}


def test_chains_and_groups_of_near_copies(spark, frame):
    rows, base = [], words(0, 60)
    for i in range(120):  # each differs from the base and from its neighbours in places
        own = list(base)
        own[random.Random(i).randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    drift = words(1, 100)
    for i in range(20):  # the ends of the chain have little in common
        drift = [*drift[2:], f"new{i}", f"more{i}"]
        rows.append((500 + i, " ".join(drift)))
    found = {r.doc_id: r.class_id for r in near_dedup.classes(frame(rows, SCHEMA)).collect()}
    assert found == {doc: c for (doc, _), c in zip(rows, plain(rows))}
    assert len(set(found.values())) < 40


EDGES = [
    (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "one  two"), (6, "one"),
    (7, "ONE TWO"), (None, "one two"), (8, "a b c d e f"), (8, "a b c d e f"),
    (9, "word " * 300_000), (10, "word " * 300_000),
]


def test_edges(spark, frame):
    found = near_dedup.classes(frame(EDGES, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == sorted(
        [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 4), (None, None), (8, 8), (8, 8),
         (9, 9), (10, 9)], key=str)
    docs = frame(EDGES, SCHEMA)
    kept = near_dedup.first_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "2", "3", "4", "6", "None", "8", "9"])


@pytest.mark.parametrize("of", [near_dedup.classes, near_dedup.first_rows])
def test_empty_table(spark, frame, of):
    assert of(frame([], SCHEMA)).collect() == []


def test_group_with_ever_more_edits(spark, frame):
    """Many texts around a base, few alike enough, and pairs that only others link."""
    base, rows = words(3, 80), []
    for i in range(150):
        draw, own = random.Random(i), list(base)
        for _ in range(i % 9):
            own[draw.randrange(80)] = f"edit{i}x{draw.random()}"
        rows.append((i, " ".join(own)))
    for i in range(12):  # a side group far from the base, alike among themselves
        own = base[:60] + words(50, 30)
        own[i] = f"side{i}"
        rows.append((200 + i, " ".join(own)))
    found = {r.doc_id: r.class_id for r in near_dedup.classes(frame(rows, SCHEMA)).collect()}
    assert found == {doc: c for (doc, _), c in zip(rows, plain(rows))}
