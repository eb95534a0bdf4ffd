import pytest

from brute import contained as plain
from fleetgauge.llm import decontaminate
from fleetgauge.sources.tables import table

ITEM = "the quick brown fox jumps over the lazy dog near one river bank today"
LONG = " ".join(f"w{i}" for i in range(150_000))
DOCS = [
    (1, f"{LONG} {ITEM.upper()}\n {LONG}"), (2, ITEM.replace("today", "now")),
    (3, ITEM.replace("jumps", "x")), (4, None), (5, ""), (6, "too few words"),
    (None, ITEM), (7, ITEM), (7, ITEM), (8, "five words make one item"),
]
ITEMS = [(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, "too few words"),
         (15, "five words make one item"), (None, "five words make one item")]


def hits(df):
    return sorted(
        ((r.doc_id, r.item_id, r.matched, r.item_shingles) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
def test_planted_items(spark, frame, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = frame(DOCS, "doc_id bigint, text string"), frame(ITEMS, "item_id bigint, text string")
    want = []
    for doc in DOCS:
        want += plain([doc], ITEMS)
    assert hits(decontaminate.contained(docs, items)) == sorted(want, key=str)
    kept = decontaminate.clean_rows(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_every_size_partition_misses_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    items = [(i * 100 + n, " ".join(text.split()[7 : 7 + n])) for i, (_, text) in
             enumerate(rows[:20]) for n in (5, 6, 8, 9, 13, 20, 36, 70)]
    made = spark.createDataFrame(items, "item_id bigint, text string")
    assert set(hits(decontaminate.contained(docs, made))) == plain(rows, items)


def test_empty_tables(spark, frame):
    docs, items = frame(DOCS, "doc_id bigint, text string"), frame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contained(docs, items.limit(0)).collect() == []
    assert decontaminate.contained(docs.limit(0), items).collect() == []
    assert decontaminate.clean_rows(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.clean_rows(docs.limit(0), items).collect() == []
