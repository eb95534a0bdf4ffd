"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n distinct five-word shingles is contained in a document if at least the
threshold's share of them stand there. Items are partitioned by size, in powers of two.
For the largest size u of a partition, u - ceil(t * u) + 1 of an item's shingles cannot
all be missing from a document that contains the item, so each item is indexed by that
many of its smallest hashes, and one lookup per shingle of a document, however long,
finds every candidate. Candidates are then held against all shingles of the item.

The items' shingles are broadcast in blocks of a bounded number; further blocks take
further passes over the documents. Documents are read whole and never shuffled.

Items of fewer than five words have no shingles and contain nothing that could be
found; null and empty texts likewise. Repeated items and documents count each: every
pair of rows has its row, and null ids stay null. An empty table gives no rows. Columns
besides the named ones are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import column, kept_rows, sliced
from fleetgauge.llm.text import shingle_hashes, word_hashes
from fleetgauge.session import stored

THRESHOLD = 0.8

#: Shingles of items in a broadcast block.
BLOCK = 2_000_000


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id`` and the distinct shingle hashes of every item that has any."""
    read = items.select(
        column(item_id).cast("bigint").alias("item_id"), column(text).alias("text")
    )

    def work(part: pa.RecordBatch) -> dict:
        hashes, of = shingle_hashes(*word_hashes(part.column("text").to_pylist()))
        split = np.split(hashes, np.searchsorted(of, np.arange(1, part.num_rows)))
        return {
            "item_id": part.column("item_id"),
            "shingles": [np.unique(h).view(np.int64) for h in split],
        }

    made = sliced(read, "text", work, "item_id bigint, shingles array<bigint>")
    return made.filter(F.size("shingles") > 0)


class Index:
    """The sketches of a block of items, by hash."""

    def __init__(self, shingles: list[np.ndarray], threshold: float):
        self.items, self.threshold = shingles, threshold
        keys, owners = [], []
        for item, hashes in enumerate(shingles):
            largest = (1 << len(hashes).bit_length()) - 1
            size = largest - math.ceil(threshold * largest - 1e-9) + 1
            own = len(hashes) - math.ceil(threshold * len(hashes) - 1e-9) + 1
            sketch = np.sort(hashes)[: max(size, own)]
            keys.append(sketch)
            owners.append(np.full(len(sketch), item))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], owner[order]
        self.marked = np.zeros(1 << 22, bool)
        self.marked[self.keys >> np.uint64(42)] = True

    def candidates(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Distinct (document, item) rows that share a sketched shingle."""
        maybe = np.flatnonzero(self.marked[hashes >> np.uint64(42)])
        low = np.searchsorted(self.keys, hashes[maybe], "left")
        count = np.searchsorted(self.keys, hashes[maybe], "right") - low
        doc = np.repeat(docs[maybe], count)
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.unique(np.column_stack([doc, self.owners[at]]), axis=0)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Rows of texts, the items they contain, and how many shingles of each."""
        hashes, of = shingle_hashes(*word_hashes(texts))
        hits = []
        for doc, item in self.candidates(hashes, of):
            start, end = np.searchsorted(of, [doc, doc + 1])
            wanted = self.items[item]
            matched = int(np.isin(wanted, hashes[start:end]).sum())
            if matched >= self.threshold * len(wanted) - 1e-9:
                hits.append((int(doc), int(item), matched))
        return hits


def _blocks(
    items: DataFrame, item_id: str, text: str, threshold: float
) -> Iterator[Broadcast]:
    """Broadcast item ids and indexes, a bounded number of shingles at a time."""
    spark = items.sparkSession
    known = stored(item_shingles(items, item_id, text), "items")
    total = known.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK))
    for number in range(blocks):
        own = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == number
        rows = known.filter(own).toArrow()
        if rows.num_rows:
            hashes = [
                np.asarray(x, np.int64).view(np.uint64)
                for x in rows.column("shingles").to_pylist()
            ]
            ids = rows.column("item_id").to_pylist()
            yield spark.sparkContext.broadcast((ids, Index(hashes, threshold)))


def contained(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of documents and items they contain.

    ``doc_id, item_id, matched`` (the item's shingles found), ``item_shingles`` and
    ``containment``.
    """
    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )
    schema = "doc_id bigint, item_id bigint, matched bigint, item_shingles bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(items, item_id, item_text, threshold):

        def work(part: pa.RecordBatch, shared=shared) -> dict:
            ids, index = shared.value
            hits = index.search(part.column("text").to_pylist())
            doc_ids = part.column("doc_id").to_pylist()
            return {
                "doc_id": [doc_ids[doc] for doc, _, _ in hits],
                "item_id": [ids[item] for _, item, _ in hits],
                "matched": [matched for _, _, matched in hits],
                "item_shingles": [len(index.items[item]) for _, item, _ in hits],
            }

        found = found.unionAll(sliced(read, "text", work, schema))
    return found.withColumn("containment", F.col("matched") / F.col("item_shingles"))


def clean_rows(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows that contain no item, with all their columns; nothing is shuffled."""
    for shared in _blocks(items, item_id, item_text, threshold):

        def clean(texts: list[str | None], shared=shared) -> list[bool]:
            hit = {doc for doc, _, _ in shared.value[1].search(texts)}
            return [row not in hit for row in range(len(texts))]

        docs = kept_rows(docs, text, clean)
    return docs


SQL = r"""
WITH w AS (
  SELECT doc_id AS id, 0 AS kind, string_split_regex(trim(lower(text)), '\s+') AS w
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT item_id, 1, string_split_regex(trim(lower(text)), '\s+')
  FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT id, kind, unnest(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
  FROM w
), n AS (SELECT id, count(*) AS item_shingles FROM s WHERE kind = 1 GROUP BY id),
m AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS matched
  FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.shingle = i.shingle
  GROUP BY d.id, i.id
)
SELECT doc_id, item_id, matched, item_shingles, matched / item_shingles AS containment
FROM m JOIN n ON m.item_id = n.id WHERE matched >= 0.8 * item_shingles
"""
