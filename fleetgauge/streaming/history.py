"""Bounded histories kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetgauge.constants import HISTORY_SIZE
from fleetgauge.operators.history import last_n
from fleetgauge.streaming.merged import MergedFolder

ORDER = ["ts_us", "sample_id"]
FIELDS = [*ORDER, "value"]


class Ring(StatefulProcessor):
    """Newest ``n`` samples of one key, in state; emits them after every batch."""

    def __init__(self, keys: Sequence[str], n: int) -> None:
        self.keys, self.n = list(keys), n

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "ts_us array<bigint>, sample_id array<bigint>, value array<double>"
        self.state = handle.getValueState("ring", schema)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        ring = [np.array(kept) for kept in self.state.get()] if self.state.exists() else None
        # One Arrow batch at a time, so a hot key needs no more memory than others.
        for frame in rows:
            new = [frame[name].to_numpy() for name in FIELDS]
            both = new if ring is None else [np.concatenate(c) for c in zip(ring, new)]
            newest = np.lexsort((both[1], both[0]))[-self.n:]
            ring = [column[newest] for column in both]
        self.state.update(tuple(column.tolist() for column in ring))
        columns = {name: [part] * len(ring[0]) for name, part in zip(self.keys, key)}
        yield pd.DataFrame(columns | dict(zip(FIELDS, ring)))

    def close(self) -> None:
        pass


def ring_samples(samples: DataFrame) -> DataFrame:
    """Samples with the columns a ring keeps."""
    return samples.withColumns({
        "ts_us": F.unix_micros("ts"),
        "value": F.col("value").cast("double"),
    })


def _cut_batches(
    keys: Sequence[str], n: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cut every Arrow batch to the newest ``n`` samples per key."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(ORDER).groupby(list(keys), sort=False).tail(n)

    return cut


def stream_last_n(
    samples: DataFrame, keys: Sequence[str], n: int = HISTORY_SIZE, parts: int = 1
) -> DataFrame:
    """The newest ``n`` samples of every changed key, after every batch.

    Samples are cut before the shuffle, so a busy key reaches its state as a few
    rows per input batch. Where that is still too much for one task, ``parts``
    gives each key several rings; ``merge_rings`` joins them.
    """
    ring_keys = [*keys, "part"]
    schema = ", ".join(
        [f"{name} string" for name in keys]
        + ["part int", "ts_us bigint", "sample_id bigint", "value double"]
    )
    spread = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
    return (
        ring_samples(samples)
        .select(*keys, spread.alias("part"), *FIELDS)
        .mapInPandas(_cut_batches(ring_keys, n), schema)
        .groupBy(*ring_keys)
        .transformWithStateInPandas(
            statefulProcessor=Ring(ring_keys, n),
            outputStructType=schema,
            outputMode="Update",
            timeMode="None",
        )
    )


def merge_rings(rings: DataFrame, keys: Sequence[str], n: int = HISTORY_SIZE) -> DataFrame:
    """Newest samples per key from rings that may have been emitted repeatedly."""
    return last_n(rings.dropDuplicates([*keys, *ORDER]), keys, ORDER, n)


def merged_history(
    spark: SparkSession, folder: str, keys: Sequence[str], n: int = HISTORY_SIZE
) -> MergedFolder:
    """A folder that keeps the newest samples per key small; it takes ``newest_samples``."""
    return MergedFolder(
        spark, folder, lambda rows: merge_rings(rows, keys, n).select(*keys, *FIELDS)
    )


def newest_samples(batch: DataFrame, keys: Sequence[str], n: int = HISTORY_SIZE) -> DataFrame:
    """The newest ``n`` samples per key of one micro-batch."""
    return last_n(ring_samples(batch), keys, ORDER, n).select(*keys, *FIELDS)


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to a folder of its own; a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def history_sink(
    folder: str, keys: Sequence[str], n: int = HISTORY_SIZE
) -> Callable[[DataFrame, int], None]:
    """Upsert of the newest samples per key, without state in the stream.

    A micro-batch is cut to the newest ``n`` samples per key and added to the
    folder; ``read_history`` folds the batches, ``compact_history`` shortens that.
    """
    write = batch_sink(folder)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write(newest_samples(batch, keys, n), batch_id)

    return upsert


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """What the last batch wrote, for streams that write their whole result."""
    batches = read_batches(spark, folder)
    last = batches.agg(F.max("batch_id")).first()[0]
    return batches.filter(F.col("batch_id") == last).drop("batch_id")


def _windows(
    spark: SparkSession,
    folder: str,
    keys: Sequence[str],
    n: int,
    base: str | None,
    after: int,
    through: int | None,
) -> DataFrame:
    batches = read_batches(spark, folder).filter(F.col("batch_id") > after)
    if through is not None:
        batches = batches.filter(F.col("batch_id") <= through)
    samples = batches.drop("batch_id")
    if base is not None:
        samples = samples.unionByName(spark.read.parquet(base))
    return last_n(samples, keys, ORDER, n)


def read_history(
    spark: SparkSession,
    folder: str,
    keys: Sequence[str],
    n: int = HISTORY_SIZE,
    base: str | None = None,
    after: int = -1,
) -> DataFrame:
    """The current window of every key: a compacted ``base`` and the batches ``after``."""
    return _windows(spark, folder, keys, n, base, after, None)


def compact_history(
    spark: SparkSession,
    folder: str,
    target: str,
    keys: Sequence[str],
    through: int,
    n: int = HISTORY_SIZE,
    base: str | None = None,
    after: int = -1,
) -> None:
    """Write the windows as of batch ``through`` to a new folder.

    Pass that folder as ``base`` and ``through`` as ``after`` from then on; the
    batches up to it are no longer read.
    """
    windows = _windows(spark, folder, keys, n, base, after, through)
    windows.drop("age").write.parquet(target)
