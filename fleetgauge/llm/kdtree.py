"""Exact top-k search by inner product over KD-trees of shards.

Each task builds KD-trees over its share of the vectors: median splits along the widest
side down to small leaves, each with its tight bounding box. A block of queries is
broadcast; its size is a parameter, and further blocks take further passes. A query
visits leaves best first, by the largest inner product that the box allows, and stops
where that falls below its k-th score so far, which passes from tree to tree. Every task
returns at most k rows per query; a window keeps the best.

Vectors that are null or hold null or non-finite components take no part, as queries or
as candidates. Shorter vectors count as filled up with zeros. A candidate with the
query's id is the query's own and left out. Repeated candidate rows count each; every
query row gets its own answer. Ties go to the smaller id. No queries or no candidates:
no rows. Numbers so large that a score might pass 63 bits end the query with an error.
Columns besides the named two are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetgauge.llm.common import column

#: Vectors in a leaf, in a tree, and queries in a broadcast block.
LEAF, TREE, BLOCK = 256, 1 << 16, 8192

#: Sums below this are exact in double precision.
EXACT = 2.0**53

#: Numbers and scores stay below this.
LIMIT = 2.0**62


def integer_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64
) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of every vector that takes part."""
    vector = column(embedding)
    usable = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )

    def scaled(x: Column) -> Column:
        number = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(number) < LIMIT, F.floor(number)).otherwise(
            F.raise_error(F.lit("a vector's number is too large for exact scores")).cast("bigint")
        )

    return df.filter(vector.isNotNull() & F.coalesce(usable, F.lit(False))).select(
        column(vec_id).cast("bigint").alias("id"), F.transform(vector, scaled).alias("v")
    )


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    rows = np.zeros((len(sizes), max(width, sizes.max(initial=0))), np.int64)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return rows


class Tree:
    """Leaves of a KD-tree: the order of the points, and where each leaf and its box are."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        leaves: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            rows = waiting.pop()
            sides = np.ptp(points[rows], axis=0) if points.shape[1] else np.zeros(1)
            if len(rows) <= LEAF or not sides.max():
                leaves += np.array_split(rows, -(-len(rows) // LEAF))
                continue
            half = len(rows) // 2
            by_side = np.argpartition(points[rows, sides.argmax()], half)
            waiting += [rows[by_side[:half]], rows[by_side[half:]]]
        self.ids = [ids[rows] for rows in leaves]
        self.points = [points[rows] for rows in leaves]
        self.low = np.array([p.min(axis=0) for p in self.points])
        self.high = np.array([p.max(axis=0) for p in self.points])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of a leaf has a larger inner product with the query."""
        high, low = self.high.astype(float), self.low.astype(float)
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        return bound + np.abs(bound) * 1e-9


class Best:
    """The best k so far of every query, as sorted triples (query, score, id)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.kth = np.full(queries, -np.inf)
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query = np.append(self.query, query)
        score = np.append(self.score, score)
        ids = np.append(self.id, ids)
        order = np.lexsort([ids, -score, query])
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        full = rank == self.k - 1
        self.kth[query[full]] = score[full]
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Lower nothing, miss nothing: visit every leaf that can still hold a best one."""
    bound = tree.bounds(queries.astype(float))
    order = np.argsort(-bound, axis=1, kind="stable")
    every = np.arange(len(queries))
    largest = max(np.abs(queries).max(initial=0), 1) * float(queries.shape[1])
    reach = max(np.abs(tree.low).max(initial=0), np.abs(tree.high).max(initial=0))
    if largest * float(reach) >= LIMIT:
        raise OverflowError("scores of these vectors may pass 63 bits")
    number = float if largest * float(reach) < EXACT else np.int64
    as_numbers = queries.astype(number)
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        going = np.flatnonzero(bound[every, leaf] >= best.kth)
        if not len(going):
            return
        found = []
        for at in np.unique(leaf[going]):
            own = going[leaf[going] == at]
            score = as_numbers[own] @ tree.points[at].astype(number).T
            fits = (score >= best.kth[own, None]) & (tree.ids[at] != ids[own, None])
            row, col = np.nonzero(fits)
            found.append((own[row], score[row, col].astype(np.int64), tree.ids[at][col]))
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The ``k`` best candidates of every query: query_id, rank, vec_id, score.

    Both inputs are :func:`integer_vectors`.
    """
    spark, parts = candidates.sparkSession, []
    blocks = max(1, -(-queries.count() // block))
    split = F.pmod(F.xxhash64("id", "v"), F.lit(blocks))
    for number in range(blocks):
        some = queries.filter(split == number) if blocks > 1 else queries
        table = some.toArrow()
        shared = spark.sparkContext.broadcast(
            (table.column("id").to_numpy(), matrix(table.column("v")))
        )

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, queries = shared.value
            best = Best(len(ids), k)
            held, rows = [], 0
            for batch in _with_end(batches):
                if batch is not None:
                    held.append(batch)
                    rows += batch.num_rows
                if rows and (batch is None or rows >= TREE):
                    table = pa.Table.from_batches(held)
                    points = matrix(table.column("v"), queries.shape[1])
                    wide = np.pad(queries, ((0, 0), (0, points.shape[1] - queries.shape[1])))
                    search(Tree(table.column("id").to_numpy(), points), ids, wide, best)
                    held, rows = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (best.query, ids[best.query], best.id, best.score)],
                names=["row", "query_id", "vec_id", "score"],
            )

        schema = "row bigint, query_id bigint, vec_id bigint, score bigint"
        # Nullable ids would reach numpy as floats; rows without an id take no part.
        numbered = candidates.filter(F.col("id").isNotNull())
        parts.append(numbered.mapInArrow(run, schema).withColumn("block", F.lit(number)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The search with every ``every``-th id as a query against all rows."""
    vectors = integer_vectors(embeddings)
    return top_k(vectors, vectors.filter(F.col("id") % every == 0), k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x:
    CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
