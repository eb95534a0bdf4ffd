import zlib

import numpy as np

from fleetgauge.llm import quality
from fleetgauge.sources.tables import table

SF = "/root/testdata/sf0.01"


def area(labels, scores):
    good, bad = scores[labels == 1], scores[labels == 0]
    above = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    return above


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    told = [(l.quality, rows[l.doc_id].score) for l in labels.collect() if rows[l.doc_id].held_out]
    assert area(np.array([q for q, _ in told]), np.array([s for _, s in told])) > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, SF, "documents").limit(300), table(spark, SF, "labels")
    from pyspark.sql import functions as F

    other = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
        .otherwise(F.col("quality")))
    first, second = (
        {r.doc_id: r.score for r in quality.scored(docs, x).collect()} for x in (labels, other))
    assert first == second


TEXTS = [(1, None), (2, ""), (3, "plain prose of some words"), (None, "plain prose"),
         (3, "plain prose of some words"), (4, "junk!!! " * 200_000), (5, "é"), (9, "prose again")]


def test_edges(spark, frame):
    docs = frame(TEXTS, "doc_id bigint, text string")
    labels = frame(
        [(3, 1), (4, 0), (9, 1), (9, None), (None, 1), (5, 7)], "doc_id bigint, quality int")
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(found) == len(TEXTS)
    by = {r.doc_id: r for r in found}
    used = [q for d, q in ((3, 1), (3, 1), (4, 0), (9, 1)) if zlib.crc32(str(d).encode()) % 4 != 2]
    assert by[1].score == by[2].score == np.mean(used)
    kept = quality.good_rows(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns


def test_without_labels_or_documents(spark, frame):
    docs = frame(TEXTS, "doc_id bigint, text string")
    none = frame([], "doc_id bigint, quality int")
    voters = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, voters).collect()} == {0.5}
    assert quality.score(docs.limit(0), voters).collect() == []
