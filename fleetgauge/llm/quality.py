"""Quality scores by nearest labelled documents in a latent-semantic space.

A text is its counts of hashed byte trigrams, and of words that repeat one just before
them, damped by square roots. The space comes
from a truncated singular value decomposition of a bounded sample of labelled rows
(``FIT_ROWS``, the smallest by a hash of doc_id, so the labels keep their shares). The
sample's vectors are broadcast; each document takes exact cosine products with all of
them, in blocks, and the labels of its nearest vote, weighted by similarity.

Documents are scored where they are read: no shuffle, and memory bounded by a slice of
texts. Texts count whole. Labels of held-out documents, those whose crc32(doc_id as
text) mod 4 is 2, are never used.

A null or empty text, or one like no labelled one, gets the share of label 1 in the
sample; without labels every score is 0.5. Rows with a null doc_id are not held out.
Labels that are null or not 0 or 1 are ignored; repeated labels vote each. Repeated
documents are scored each. An empty table gives no rows. Columns besides the named
ones are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import column, kept_rows, sliced
from fleetgauge.llm.text import word_hashes

#: Labelled rows the classifier is fitted on, at most: the bound of what is broadcast.
FIT_ROWS = 6000

#: Hashed trigrams, dimensions of the latent space, and neighbours that vote.
TRIGRAMS, RANK, NEIGHBOURS = 4096, 64, 31

#: How far back a word may repeat, and how much such a word weighs against a trigram.
LAGS, REPEATED = 4, 4.0

FEATURES = TRIGRAMS + LAGS

#: A document is good from this score on.
GOOD = 0.7

#: Texts whose products with all labelled vectors are held at once.
ROWS = 256


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the counts, a row of length one per text; empty texts are zero."""
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    counts = np.zeros((len(texts), FEATURES), np.float32)
    if len(data) > 2:
        of = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
        whole = of[:-2] == of[2:]
        code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        at = of[:-2][whole] * TRIGRAMS + slot[whole]
        found = np.bincount(at, minlength=len(texts) * TRIGRAMS)
        counts[:, :TRIGRAMS] = found.reshape(-1, TRIGRAMS)
    words, of = word_hashes(texts)
    for lag in range(1, LAGS + 1):
        again = (words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])
        counts[:, TRIGRAMS + lag - 1] = np.bincount(of[lag:][again], minlength=len(texts))
    rows = np.sqrt(counts)
    rows[:, TRIGRAMS:] *= REPEATED
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def latent_space(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration."""
    width = min(rank + 16, *rows.shape)
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


class Voters:
    """Labelled vectors in the latent space."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.space = latent_space(rows, RANK) if len(labels) else None
        self.vectors = self.project(rows) if len(labels) else None

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = rows @ self.space
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.space is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for start in range(0, len(texts), ROWS):
            vectors = self.project(features(texts[start : start + ROWS]))
            alike = vectors @ self.vectors.T
            k = min(NEIGHBOURS, alike.shape[1])
            near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(alike, near, axis=1), 0) ** 2
            total = weight.sum(axis=1, dtype=np.float64)
            voted = (weight * self.labels[near]).sum(axis=1, dtype=np.float64)
            out[start : start + ROWS] = np.where(
                total > 0, voted / np.maximum(total, 1e-12), self.prior
            )
        return np.clip(out, 0, 1)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", rows: int = FIT_ROWS,
) -> Voters:
    """Voters from at most ``rows`` labelled documents that are not held out."""
    wanted = (
        labels.select(
            column(doc_id).cast("bigint").alias("id"), column(label).cast("int").alias("label")
        )
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    )
    sample = docs.select(
        column(doc_id).cast("bigint").alias("id"), column(text).alias("text")
    ).join(F.broadcast(wanted), "id")  # at most ``rows`` rows

    def work(part: pa.RecordBatch) -> dict:
        counts = features(part.column("text").to_pylist()).astype(np.float16)
        return {
            "id": part.column("id"), "label": part.column("label"),
            "counts": [row.tobytes() for row in counts],
        }

    found = sliced(
        sample.select("id", "label", "text"), "text", work, "id bigint, label int, counts binary"
    ).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.float16)
    return Voters(
        counts.reshape(-1, FEATURES).astype(np.float32), found.column("label").to_numpy()
    )


def score(
    docs: DataFrame, voters: Voters, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )

    def work(part: pa.RecordBatch) -> dict:
        scores = shared.value.scores(part.column("text").to_pylist())
        return {
            "doc_id": part.column("doc_id"), "score": scores,
            "predicted": (scores >= GOOD).astype(np.int32),
        }

    return sliced(read, "text", work, "doc_id bigint, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    result = score(docs, fit(docs, labels))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_rows(docs: DataFrame, voters: Voters, text: str = "text") -> DataFrame:
    """The rows that score as good, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    return kept_rows(docs, text, lambda texts: (shared.value.scores(texts) >= GOOD).tolist())
