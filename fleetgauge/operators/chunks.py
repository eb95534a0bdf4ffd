"""Windows over series too long for one task.

A running window needs its whole series in one task. Where a window only looks a
bounded number of rows back, the series can be cut in consecutive chunks instead,
each with copies of the few rows that precede it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import stored


def with_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pieces: int | None = None,
    name: str = "chunk",
) -> DataFrame:
    """Rows in consecutive chunks of about equal size, along the keys and the order.

    Spark samples the bounds from the rows themselves, so a burst, or many rows with one
    time, are cut as evenly as the rest, and a long series has as many chunks as its rows
    ask for. Rows without a place in the order stand before all others. The result is
    written, because the bounds must not be sampled twice.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(pieces, *keys, *order)
    return stored(ranged.withColumn(name, F.spark_partition_id()), "chunks")


def with_carry_in(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    rows: int,
) -> DataFrame:
    """All rows, plus copies of the last ``rows`` rows before each chunk.

    Copies have ``carried`` set and the chunk they are carried into. ``chunk`` must
    not decrease along ``order``. Chunks may hold fewer than ``rows`` rows; then a
    row is carried over several of them, which keeps the result exact. A series
    without chunks is whole and needs no copies.
    """
    cut = df.filter(F.col(chunk).isNotNull())
    newest = Window.partitionBy(*keys, chunk).orderBy(*[F.desc(name) for name in order])
    tails = cut.withColumn("_after", F.row_number().over(newest)).filter(F.col("_after") <= rows)

    # Tails hold every row that can be carried, so their places stand in for the
    # places in the whole series: a row is carried into each chunk that starts
    # within the next `rows` places.
    along = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(chunk).over(along)
    starts = F.when(before.isNull() | (before != F.col(chunk)), F.col(chunk))
    ahead = F.collect_list("_starts").over(along.rowsBetween(1, rows))
    others = [name for name in df.columns if name != chunk]
    carried = (
        tails.withColumn("_starts", starts)
        .withColumn("_ahead", ahead)
        .select(*others, F.explode_outer("_ahead").alias(chunk), F.lit(True).alias("carried"))
        .filter(F.col(chunk).isNotNull())
    )
    return df.withColumn("carried", F.lit(False)).unionByName(carried)
