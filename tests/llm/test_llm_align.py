import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetgauge.llm import align
from fleetgauge.llm.tokens import vocabulary
from fleetgauge.sources.tables import table

SCHEMA = "doc_id bigint, text string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """The same by sets of offsets and lists of all pairs."""
    whole = Tokenizer.from_file(vocabulary(align.BYTES))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(align.PIECES))
    signs = {chr(s): b for b, s in align._byte_signs().items()}
    found, docs = [], Counter()
    for text in texts:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        parts = [
            [bytes(signs[c] for c in whole.id_to_token(i)) for i in a],
            [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
             else model.id_to_piece(i).replace("▁", " ").encode() for i in b],
        ]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append((0, 0, None, []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        both = set(ends[0]) & set(ends[1])
        sides = []
        for ids, own in zip((a, b), ends):
            sides.append([[]])
            for i, end in zip(ids, own):
                sides[-1][-1].append(i)
                if end in both:
                    sides[-1].append([])
            sides[-1].pop()
        groups = list(zip(*sides, strict=True))
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        docs.update(set(pairs))
        found.append((len(a), len(b), groups, pairs))
    top = Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return [
        (n_a, n_b, len(groups or []), len(pairs), sum(docs[p] == top[p[0]] for p in pairs),
         sum(docs[p] for p in pairs), "" if groups is None else hashlib.sha256(";".join(
            ",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest())
        for n_a, n_b, groups, pairs in found
    ]


def sums(rows, most):
    rows = align.stored(rows, "aligned")
    return align.summed(rows, align.stored(align.link_counts(rows), "link-counts"), most)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, " 　é 漢字 😀\x00\t\r\n x\r\n;\r"), (7, "word " * 60_000), (8, "é" * 90_000),
    (9, " " * 30_000 + "x"), (10, "\n" * 30_000), (None, "same text"), (11, "same text"),
    (11, "same text"), (12, "other text, other words"), (13, "ﬁ ½ ́a​﻿"),
]


@pytest.mark.parametrize("most", [0, 3, 100, align.COMMON])
def test_odd_rows_equal_brute_force(spark, frame, most):
    """However many links are broadcast, the result is the same."""
    got = [tuple(r) for r in sums(align.aligned(frame(ODD, SCHEMA).repartition(3)), most).collect()]
    want = [(doc, *row) for (doc, _), row in zip(ODD, plain([t for _, t in ODD]))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = align.document_links(docs)
    assert found.columns == NAMES
    want = [(doc, *row) for (doc, _), row in zip(rows, plain([t for _, t in rows]))]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_empty_table(spark, frame):
    assert align.document_links(frame([], SCHEMA)).collect() == []


def test_long_groups_are_folded():
    """Both ways to list the links of a group give the same counts."""
    draw = random.Random(1)
    a, b = (np.array(draw.choices(range(5), k=400)) for _ in range(2))
    used_a, used_b = np.array([3, 203, 400]), np.array([1, 301, 400])
    found, counts = align.links(a, b, used_a, used_b)
    want = Counter()
    for x, y in [((0, 3), (0, 1)), ((3, 203), (1, 301)), ((203, 400), (301, 400))]:
        want.update((int(i), int(j)) for i in a[slice(*x)] for j in b[slice(*y)])
    assert dict(zip(found.tolist(), counts.tolist())) == {(i << 32) | j: n for (i, j), n in want.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.booleans(), max_size=60))
def test_groups_end_where_both_sides_end(left, right):
    n = max(len(left), len(right)) + 1
    ends = [sorted({i + 1 for i, on in enumerate(side) if on} | {n}) for side in (left, right)]
    used = align.groups(*ends)
    both = sorted(set(ends[0]) & set(ends[1]))
    assert [u.tolist() for u in used] == [[own.index(x) + 1 for x in both] for own in ends]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_faster_encoder_gives_equal_ids(text):
    side = align._sides(vocabulary(align.BYTES), vocabulary(align.PIECES)).sides[0]
    assert side.encode([text])[0] == side._whole.encode(" " + text, add_special_tokens=False).ids
