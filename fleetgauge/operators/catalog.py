"""Metric selection and labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.constants import LABELS


def metric_catalog(spark: SparkSession) -> DataFrame:
    """All known metrics as rows of ``source``, ``metric`` and ``label``."""
    rows = [(s, key, label) for s, labels in LABELS.items() for key, label in labels.items()]
    return spark.createDataFrame(rows, "source STRING, metric STRING, label STRING")


def enabled_metrics(
    snapshots: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    enabled: Sequence[str],
) -> DataFrame:
    """Wide snapshots to long samples of the enabled metrics, in field order.

    The time of a snapshot and private fields are never metrics.
    """
    chosen = [
        name
        for name in fields
        if name in enabled and name != "timestamp" and not name.startswith("_")
    ]
    typed = snapshots.select(*keys, *[F.col(name).cast("double") for name in chosen])
    if not chosen:
        return typed.select(
            *keys,
            F.lit("").alias("metric"),
            F.lit(0.0).alias("value"),
            F.lit(0).alias("position"),
        ).filter(F.lit(False))
    place = F.create_map(*chain(*[(F.lit(n), F.lit(i)) for i, n in enumerate(chosen)]))
    return typed.unpivot([*keys], chosen, "metric", "value").withColumn(
        "position", place[F.col("metric")]
    )


def with_labels(
    samples: DataFrame, source: str, catalog: DataFrame | None = None
) -> DataFrame:
    """Add the label of each metric; an unknown metric labels itself.

    The built-in catalog has a fixed, small number of rows and is broadcast. Spark
    chooses how to join a catalog of the caller's from its size.
    """
    if catalog is None:
        known = F.broadcast(metric_catalog(samples.sparkSession))
    else:
        known = catalog
    known = known.filter(F.col("source") == source).select(
        "metric", F.col("label").alias("_label")
    )
    return (
        samples.join(known, "metric", "left")
        .withColumn("label", F.coalesce("_label", "metric"))
        .drop("_label")
    )


def search_metrics(
    samples: DataFrame, source: str, text: str, catalog: DataFrame | None = None
) -> DataFrame:
    """Labelled samples whose metric or label contains the text, in any case."""
    wanted = text.lower()
    labelled = with_labels(samples, source, catalog)
    return labelled.filter(
        F.lower("metric").contains(wanted) | F.lower("label").contains(wanted)
    )
