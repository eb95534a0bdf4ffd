"""From raw documents to packed sequences: five operators of ``fleetgauge.llm`` in a row.

Each stage takes all rows that the one before kept. All but the last return the columns
of the documents, extra ones included:

- ``quality`` drops rows whose text scores below 0.7; null and empty texts get the share
  of good labels as their score.
- ``near_dedup`` keeps the row with the smallest doc_id of each class of near copies; rows
  without words or without a doc_id stay, and of rows equal in doc_id and text one stays.
- ``suffix_dedup`` takes repeated strings of 100 bytes out of the texts and sets
  ``n_chars``; characters cut in half go, null texts stay null, emptied ones empty.
- ``decontaminate`` drops rows that contain a benchmark item.
- ``pack`` returns the pieces of all remaining documents with their places.

Empty tables pass through all stages. Columns may have any names: only ``doc_id``, ``text``
and ``n_chars`` are looked at, found by their exact names first, then in any capitals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontaminate as containment
from fleetgauge.llm import near_dedup as copies
from fleetgauge.llm import packing, suffixes
from fleetgauge.llm import quality as voting
from fleetgauge.llm.common import by_place, shipped
from fleetgauge.session import stored
from fleetgauge.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage that sees plain column names, whatever those of its documents are."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, back = by_place(docs, "doc_id", "text", "n_chars")
        return back(work(shipped(spark), plain, sf_dir))

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return voting.good_rows(docs, voting.fit(docs, table(spark, sf_dir, "labels")))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.first_rows(docs)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_rows(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    plain, _ = by_place(docs, "doc_id", "text")
    return packing.packed_digests(plain)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: The stages are no SQL; a test holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(shipped(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
