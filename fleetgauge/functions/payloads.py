"""Parts of landed JSON documents whose keys are not known beforehand.

Documents are parsed one level at a time into maps and arrays of strings. That
keeps the order of the keys in the document, which decides ties between blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "MAP<STRING, STRING>"
LIST = "ARRAY<STRING>"
BLOCK_META = "STRUCT<mean: STRING, best_node: STRING, lowest_node: STRING>"


def is_list(text: Column) -> Column:
    return text.startswith("[")


def is_object(text: Column) -> Column:
    return text.startswith("{")


def record_list(payload: Column, record: str) -> Column:
    """The records of a listing; null for anything that is no whole JSON list."""
    listing = F.from_json(payload, f"ARRAY<{record}>")
    # Spark reads a lone object as a list of one.
    return F.when(is_list(F.ltrim(payload)), listing)


def page_object(payload: Column, schema: str) -> Column:
    """A landed object, with its text in ``_bad`` where that is no whole JSON object."""
    with_text = schema[: -len(">")] + ", _bad: STRING>"
    return F.from_json(payload, with_text, {"columnNameOfCorruptRecord": "_bad"})


def readable(page: Column) -> Column:
    return page.isNotNull() & page["_bad"].isNull()


def members(document: Column) -> Column:
    """Top-level members of a JSON object, null for anything else."""
    return F.from_json(document, OBJECT)


def items(text: Column) -> Column:
    return F.from_json(text, LIST)


def known(values: Column) -> Column:
    """How many values are not null."""
    return F.size(F.filter(values, lambda value: value.isNotNull()))


def blocks(top: Column) -> Column:
    """Data blocks of a timeline document, in document order.

    A block is a member other than ``unit`` and ``timestamps`` whose value is a
    list starting with a list. None count unless ``timestamps`` is a list.
    """
    candidates = F.filter(
        F.map_entries(top),
        lambda e: ~e["key"].isin("unit", "timestamps") & is_list(e["value"]),
    )

    def parsed(entry: Column, position: Column) -> Column:
        return F.struct(
            position.alias("position"),
            entry["key"].alias("key"),
            items(entry["value"]).alias("parts"),
        )

    def shaped(block: Column) -> Column:
        meta = F.get(block["parts"], F.lit(1))
        values = items(F.get(block["parts"], F.lit(0)))
        return F.struct(
            block["position"].alias("position"),
            block["key"].alias("key"),
            values.alias("values"),
            F.when(is_object(meta), meta).otherwise(F.lit("{}")).alias("meta"),
        )

    found = F.filter(
        F.transform(candidates, parsed),
        lambda b: is_list(F.get(b["parts"], F.lit(0))),
    )
    return F.when(is_list(top["timestamps"]), F.transform(found, shaped))


def densest(found: Column) -> Column:
    """The block with most known values, the first one where several tie."""
    ranked = F.transform(
        found,
        lambda b: F.struct(
            known(b["values"]).alias("known"),
            (-b["position"]).alias("earliest"),
            b["key"].alias("key"),
            b["values"].alias("values"),
            b["meta"].alias("meta"),
        ),
    )
    return F.array_max(ranked)


def job_detail(document: Column) -> Column:
    """An object, or the object a list starts with; anything else is empty."""
    first = F.get(items(document), F.lit(0))
    return F.coalesce(
        members(document),
        members(first),
        F.create_map().cast("map<string,string>"),
    )
