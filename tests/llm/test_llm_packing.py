import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetgauge.llm import packing
from fleetgauge.llm.tokens import encoder, vocabulary
from fleetgauge.sources.tables import table

SIGNS = "".join(map(chr, range(1, 0x250)))
ODD = ["", " a\n\n b\t c ", "ΑΣ ς ßİ ǅ", "a<|endoftext|>b <|start", "e\u0301 x it's 12a²", "\x1c\x85\xa0 u",
       SIGNS, " ".join(SIGNS), "DON'T I'LL it'S ÀÉÞ×÷ßÿ µªº", "가 각 ﬁ"]


def test_ids_equal_the_tokenizer(spark):
    texts = ODD + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    whole = Tokenizer.from_file(vocabulary())
    want = [np.array(c.ids, "<u4").tobytes() for c in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder(vocabulary()).encode(texts) == want


def checked(docs, rows, window=4096):
    """Every id in one piece, sequences without gaps; returns their fill."""
    whole = Tokenizer.from_file(vocabulary())
    want = Counter(
        tuple([*whole.encode(text or "", add_special_tokens=False).ids, 2]) + (doc,)
        for doc, text in docs)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and 1 <= r["length"] <= window
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["doc_tokens"], ids))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, pieces in by_doc.items():
        held = Counter()
        for start, total, ids in pieces:
            held[start] += len(ids)
        texts = [w for w in want.elements() if w[-1] == doc]
        assert sum(held.values()) == sum(len(w) - 1 for w in texts)
        if len(texts) == 1:
            joined = np.concatenate([ids for _, _, ids in sorted(pieces, key=lambda p: p[0])])
            assert tuple(joined.tolist()) == texts[0][:-1]
            assert {total for _, total, _ in pieces} == {len(joined)}
    return sum(n for p in sequences.values() for _, n in p) / (window * len(sequences))


def test_packs_everything_tightly(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = packing.pack(docs.repartition(5)).collect()
    assert checked([tuple(r) for r in docs.collect()], rows) > 0.97
    digests = packing.packed_digests(docs).collect()
    whole = {(r.doc_id, r.start, r.length): r for r in rows}
    for r in digests:
        assert r.ids_crc32 == zlib.crc32(bytes(whole[r.doc_id, r.start, r.length]["ids"]))


@pytest.mark.parametrize("window", [1, 3, 64])
def test_edges(spark, frame, window):
    docs = [(1, None), (2, ""), (3, "ab cd ef gh"), (3, "ab cd ef gh"), (None, "x"), (4, "word " * 5000)]
    rows = packing.pack(frame(docs, "doc_id bigint, text string"), window=window).collect()
    checked(docs, rows, window)


def test_empty_table(spark, frame):
    assert packing.pack(frame([], "doc_id bigint, text string")).collect() == []


def test_plan_fills_windows_from_the_histogram():
    draw = np.random.default_rng(0)
    lengths = Counter(np.minimum(4095, draw.lognormal(6, 1, 50_000).astype(int) + 1).tolist())
    rows = packing.plan(lengths)
    used = Counter()
    for length, first, count, _, _ in rows.tolist():
        assert first == used[length]
        used[length] += count
    assert used == lengths
    sequences = rows[:, 3].max() + rows[rows[:, 3].argmax(), 2]
    assert sum(k * n for k, n in lengths.items()) / (4096 * sequences) > 0.998
