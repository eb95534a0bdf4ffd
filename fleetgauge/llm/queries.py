"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import (
    align,
    chat,
    decontaminate,
    jaccard,
    kdtree,
    lengths,
    near_dedup,
    packing,
    quality,
    suffixes,
    trie,
    urls,
    warc,
)
from fleetgauge.llm.common import shipped
from fleetgauge.session import stored
from fleetgauge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(shipped(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_warc", warc.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op3_decontamination", decontaminate.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


@query("op6_url_filters", urls.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lengths.encoded_lengths(table(spark, sf_dir, "documents"))
    # Written, because the limits read the histogram twice.
    return lengths.context_limits(stored(lengths.length_histogram(counted), "histogram"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


@query("op9_chat", chat.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_template_like(table(spark, sf_dir, "conversations"))
    return chat.formatted_digests(rows)


@query("op10_top_k", kdtree.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_conversation_trie", trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_ngram_join", jaccard.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.document_links(table(spark, sf_dir, "documents"))
