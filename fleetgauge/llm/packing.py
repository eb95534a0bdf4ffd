"""Packing of token ids into fixed windows by non-negative least squares.

Every document is encoded whole, closed by an end id, and cut into pieces of at most a
window. Pieces that fill a window are sequences by themselves. For the rest:

1. Spark counts the pieces by length; the histogram has at most one row per length.
2. The driver enumerates combinations of one or two lengths, each repeated a few times,
   that fill a window exactly, and solves for their repeat counts by non-negative least
   squares (multiplicative updates) against the histogram.
3. Counts are rounded down. What is left of the histogram is packed greedily, the
   longest length first, the same combination as often as the counts allow.
4. A piece takes its place by its rank among the pieces of its length. Ranks come from
   counts per written partition, so no task gathers all pieces of a length.

The plan depends on the window's size, not on the number of documents.

A null text is empty: its document is the end id alone. Documents with equal or null ids
are documents of their own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetgauge.llm.common import column, slices
from fleetgauge.llm.tokens import encoder, vocabulary
from fleetgauge.session import stored

WINDOW = 4096
END_ID = 2

#: How often a combination may repeat one length, and rounds of the solver.
REPEATS, ROUNDS = 16, 300

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " part int, local_rank bigint"
)


def cut_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    path: str | None = None, end_id: int = END_ID, window: int = WINDOW,
) -> DataFrame:
    """Pieces of every document; ``ids`` are little-endian unsigned 32-bit numbers.

    ``part`` and ``local_rank`` number the pieces of a length in each task; they hold
    once the result is written.
    """
    path, end = path or vocabulary(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seen = TaskContext.get().partitionId(), Counter()
        for part in slices(batches, "text"):
            coded = encoder(path).encode([t or "" for t in part.column("text").to_pylist()])
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    size = len(piece) // 4
                    rows.append((doc, start, size, piece, total, part_id, seen[size]))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values, kind)
                    for values, kind in zip(
                        zip(*rows, strict=True),
                        [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                         pa.int32(), pa.int64()],
                        strict=True,
                    )
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "local_rank"],
            )

    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )
    return read.mapInArrow(run, PIECES)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, l, b, m) with a * l + b * m = window over the given lengths; b may be 0."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found = []
    for a in range(1, REPEATS + 1):
        base = lengths[a * lengths <= window]
        rest = window - a * base
        whole = base[rest == 0]
        found.append(np.column_stack([np.full(len(whole), a), whole, whole * 0, whole]))
        for b in range(1, REPEATS + 1):
            other = rest // b
            fits = (rest % b == 0) & (other > 0) & (other < base)
            fits[fits] = present[other[fits]]
            l, m = base[fits], other[fits]
            found.append(np.column_stack([np.full(len(l), a), l, np.full(len(l), b), m]))
    return np.concatenate(found).astype(np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often to use each combination."""
    a, l, b, m = combos.T
    wanted = a * histogram[l] + b * histogram[m]
    x = np.minimum(histogram[l] / a, np.where(b > 0, histogram[m] / np.maximum(b, 1), np.inf))
    shared = np.bincount(l, minlength=len(histogram)) + np.bincount(
        m[b > 0], minlength=len(histogram)
    )
    x /= np.maximum(1, np.maximum(shared[l], shared[m] * (b > 0)))
    for _ in range(ROUNDS):
        used = np.bincount(l, a * x, len(histogram)) + np.bincount(m, b * x, len(histogram))
        x *= wanted / np.maximum(a * used[l] + b * used[m], 1e-12)
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset) that place every piece."""
    left = np.zeros(window + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    ranks = np.zeros(window + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def use(parts: list[int], count: int) -> None:
        nonlocal sequences
        offset = 0
        for length in parts:
            rows.append((length, ranks[length], count, sequences, offset))
            ranks[length] += count
            left[length] -= count
            offset += length
        sequences += count

    if left[window]:
        use([window], int(left[window]))
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = repeat_counts(combos, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            a, l, b, m = (int(v) for v in combos[i])
            count = min(int(x[i]), int(left[l]) // a, int(left[m]) // b if b else int(x[i]))
            if x[i] < 1:
                break
            if count:
                use([l] * a + [m] * b, count)
    while (lengths := np.flatnonzero(left)).size:
        taken: Counter = Counter()
        parts, space = [], window
        while True:
            at = int(np.searchsorted(lengths, space, "right")) - 1
            while at >= 0 and left[lengths[at]] <= taken[int(lengths[at])]:
                at -= 1
            if at < 0:
                break
            length = int(lengths[at])
            parts.append(length)
            taken[length] += 1
            space -= length
        use(parts, min(int(left[n]) // k for n, k in taken.items()))
    return np.array(rows, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces; all other columns stay.

    The histogram and the plan go through the driver; both are bounded by the window.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    rows = plan({r.length: r.n for r in histogram}, window)
    order = np.lexsort([rows[:, 1], rows[:, 0]])
    shared = spark.sparkContext.broadcast(rows[order])
    before = (
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = counts.select(
        F.col("part").alias("part_"), F.col("length").alias("length_"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    ranked = pieces.join(
        bases, (F.col("part") == F.col("part_")) & (F.col("length") == F.col("length_"))
    ).withColumn("rank_", F.col("local_rank") + F.col("base"))
    ranked = ranked.drop("part_", "length_", "base", "part", "local_rank")
    kept = [(name, kind) for name, kind in ranked.dtypes if name != "rank_"]
    names = [name for name, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank_"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{c} {t}" for c, t in kept)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    path: str | None = None, end_id: int = END_ID, window: int = WINDOW,
) -> DataFrame:
    """Every piece with its ids, its sequence and its offset there."""
    pieces = stored(cut_pieces(docs, doc_id, text, path, end_id, window), "pieces")
    return place(pieces, window)


def packed_digests(docs: DataFrame) -> DataFrame:
    """What :func:`pack` places, with a checksum in the place of the ids."""
    pieces = stored(cut_pieces(docs), "pieces")
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
