"""Token counts by an exact histogram of encoded lengths.

Documents are encoded whole and counted by length; suffix sums over the histogram
answer every context limit. The histogram has at most as many rows as the longest
document has tokens, however many documents there are. Its sums run in blocks of
lengths, so no task reads the whole of it.

Null texts count as empty, with no tokens. Repeated rows count each. An empty table
has a row of zeros for each wanted limit. Other columns are never read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetgauge.llm.common import column, sliced
from fleetgauge.llm.tokens import encoder, vocabulary

#: Context limits that get a row even if no document has that length.
LIMITS = [2**k for k in range(7, 18)]

#: Lengths summed by one task.
BLOCK = 128


def encoded_lengths(
    docs: DataFrame, text: str = "text", path: str | None = None, id_column: str | None = None
) -> DataFrame:
    """Tokens of each document, as ``tokens``, with ``doc_id`` if a column is named."""
    path = path or vocabulary()
    kept = [column(id_column).cast("bigint").alias("doc_id")] if id_column else []

    def work(part: pa.RecordBatch) -> dict:
        texts = [t or "" for t in part.column("text").to_pylist()]
        sizes = [len(ids) // 4 for ids in encoder(path).encode(texts)]
        return {n: part.column(n) for n in part.schema.names if n != "text"} | {"tokens": sizes}

    schema = "doc_id bigint, tokens bigint" if id_column else "tokens bigint"
    return sliced(docs.select(column(text).alias("text"), *kept), "text", work, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents of each encoded length: ``length``, ``docs``."""
    return lengths.groupBy(F.col("tokens").alias("length")).agg(F.count("*").alias("docs"))


def context_limits(histogram: DataFrame, limits: list[int] = LIMITS) -> DataFrame:
    """What every context limit keeps.

    A row for each length that occurs and each of ``limits``: documents that fit and
    that are cut, tokens of all documents, tokens kept if each document is truncated
    to the limit, tokens lost, and ``share``, the part of the documents that fits
    (the limit is the quantile of that share; null without documents).
    """
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(n,) for n in limits], "length bigint")
    counts = (
        histogram.unionByName(wanted.withColumn("docs", F.lit(0).cast("bigint")))
        .groupBy("length").agg(F.sum("docs").alias("docs"))
        .withColumn("block", F.floor(F.col("length") / BLOCK))
        .withColumn("tokens", F.col("docs") * F.col("length"))
    )
    # One row per block of lengths.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = (
        counts.groupBy("block")
        .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        .select(
            "block",
            F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
            F.sum("docs").over(every).alias("all_docs"),
            F.sum("tokens").over(every).alias("all_tokens"),
        )
    )
    inside = (
        Window.partitionBy("block").orderBy(F.desc("length"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = (
        counts.join(after, "block")
        .withColumn(
            "docs_cut", F.col("docs_after") + F.coalesce(F.sum("docs").over(inside), F.lit(0))
        )
        .withColumn(
            "tokens_cut",
            F.col("tokens_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
        )
    )
    kept = F.col("all_tokens") - F.col("tokens_cut") + F.col("docs_cut") * F.col("length")
    return cut.select(
        F.col("length").alias("context_limit"),
        F.col("docs").alias("docs_of_length"),
        (F.col("all_docs") - F.col("docs_cut")).alias("docs_that_fit"),
        "docs_cut",
        F.col("all_tokens").alias("tokens"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        (
            (F.col("all_docs") - F.col("docs_cut"))
            / F.nullif(F.col("all_docs"), F.lit(0)).cast("double")
        ).alias("share"),
    )


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents does not exceed."""
    return limits.filter(
        (F.col("docs_of_length") > 0) & (F.col("share") >= share)
    ).agg(F.min("context_limit").alias("length"))
