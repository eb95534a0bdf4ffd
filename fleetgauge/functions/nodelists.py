"""Node lists in their three landed shapes, normalised to an array of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES_OBJECT = "STRUCT<allocation: ARRAY<STRUCT<name: STRING>>, list: STRING>"

#: Names that one group is expanded to, at most.
MOST_NAMES = 1_000_000


def no_nodes() -> Column:
    return F.array().cast("array<string>")


def _ends(part: Column) -> Column:
    """One or two numbers of a group: where a range starts and ends."""
    return F.split(part, "-")


def _is_range(part: Column) -> Column:
    ends = _ends(part)
    return (F.size(ends) <= 2) & F.forall(ends, lambda end: end.rlike("^[0-9]+$"))


def _numbered(prefix: Column, part: Column) -> Column:
    """Names of one range, padded to the width its start is written with."""
    first, last = F.element_at(_ends(part), 1), F.element_at(_ends(part), -1)
    low, high = first.try_cast("bigint"), last.try_cast("bigint")
    # sequence() would count down for a range that ends before it starts.
    few = F.least(F.greatest(low, high), low + MOST_NAMES)  # a longer range is never used
    numbers = F.filter(F.sequence(low, few), lambda i: i <= high)

    def name(i: Column) -> Column:
        digits = i.cast("string")
        width = F.greatest(F.length(first), F.length(digits))
        return F.concat(prefix, F.lpad(digits, width, F.lit("0")))

    return F.transform(numbers, name)


def expand(text: Column) -> Column:
    """A prefix and a group in brackets to names; any other text is one name.

    The group lies between the first opening bracket and a closing one at the very
    end. One that holds anything but numbers and ranges gives null, and so does one of
    more than ``MOST_NAMES`` names, which no row should hold: see :func:`ranges`.
    """
    trimmed = F.trim(text)
    opening = F.instr(trimmed, "[")
    prefix = F.substring(trimmed, F.lit(1), opening - 1)
    group = F.substring(trimmed, opening + 1, F.length(trimmed) - opening - 1)
    parts = F.split(group, ",")
    names = F.flatten(F.transform(parts, lambda part: _numbered(prefix, part)))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", no_nodes())
        .when((opening == 0) | ~trimmed.endswith("]"), F.array(text))
        .when(F.forall(parts, _is_range) & (_width(parts) <= MOST_NAMES), names)
    )


def _width(parts: Column) -> Column:
    """How many names a group has."""

    def of(part: Column) -> Column:
        first, last = F.element_at(_ends(part), 1), F.element_at(_ends(part), -1)
        return F.greatest(
            last.try_cast("decimal(38,0)") - first.try_cast("decimal(38,0)") + 1, F.lit(0)
        ).cast("double")

    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + F.coalesce(of(part), F.lit(0.0)))


def _listed(text: Column) -> Column:
    """A JSON list of names, or a compact text."""
    return F.when(
        text.startswith("["), F.from_json(text, "ARRAY<STRING>")
    ).otherwise(expand(text))


def normalise(nodes: Column) -> Column:
    """Any landed shape of a node list to an array of names."""

    def of(parsed: Column) -> Column:
        names = F.filter(
            F.transform(parsed["allocation"], lambda node: node["name"]),
            lambda name: name != "",
        )
        return F.when(F.size(names) > 0, names).otherwise(_listed(parsed["list"]))

    # Bound in an array of one, so that the document is parsed once.
    from_object = F.get(F.transform(F.array(F.from_json(nodes, NODES_OBJECT)), of), F.lit(0))
    return F.when(nodes.startswith("{"), from_object).otherwise(_listed(nodes))


def sorted_distinct(nodes: Column) -> Column:
    return F.array_sort(F.array_distinct(nodes))


# ------------------------------------------------------------ ranges instead of names

#: Digits of a name's number at most; further ones belong to its prefix.
DIGITS = 18

RANGE = "struct<prefix:string,width:int,low:bigint,high:bigint>"


def _power_of_ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")  # exact up to 10**22


def name_range(name: Column) -> Column:
    """A name as a range of one: what stands before its last digits, and their number.

    ``width`` is how many digits are written, so equal ranges mean equal names.
    """
    digits = F.regexp_extract(name, f"([0-9]{{1,{DIGITS}}})$", 1)
    number = F.coalesce(digits.try_cast("bigint"), F.lit(0))
    prefix = F.substring(name, F.lit(1), F.length(name) - F.length(digits))
    return F.struct(
        prefix.alias("prefix"), F.length(digits).alias("width"),
        number.alias("low"), number.alias("high"),
    )


def _part_ranges(prefix: Column, part: Column) -> Column:
    """Ranges of one part of a group, one for each number of digits that is written.

    Digits at the end of the prefix count to the number, as in a written-out name.
    """
    first, last = F.element_at(_ends(part), 1), F.element_at(_ends(part), -1)
    low, high = first.try_cast("bigint"), last.try_cast("bigint")
    longest = F.greatest(F.length(first), F.length(high.cast("string")))

    def written(width: Column) -> Column:
        least = F.when(width > F.length(first), _power_of_ten(width - 1)).otherwise(F.lit(0))
        ahead = F.least(
            F.length(F.regexp_extract(prefix, "([0-9]*)$", 1)), F.lit(DIGITS) - width
        )
        shift = F.when(
            ahead > 0, F.right(prefix, ahead).try_cast("bigint") * _power_of_ten(width)
        ).otherwise(F.lit(0))
        return F.struct(
            F.substring(prefix, F.lit(1), F.length(prefix) - ahead).alias("prefix"),
            (width + ahead).cast("int").alias("width"),
            (F.greatest(low, least) + shift).alias("low"),
            (F.least(high, _power_of_ten(width) - 1) + shift).alias("high"),
        )

    ranges = F.transform(F.sequence(F.length(first), longest), written)
    return F.when(
        low.isNotNull() & high.isNotNull() & (longest <= DIGITS), F.filter(ranges, lambda r: r["low"] <= r["high"])
    )


def _text_ranges(text: Column) -> Column:
    """As :func:`expand`, without expanding anything."""
    trimmed = F.trim(text)
    opening = F.instr(trimmed, "[")
    prefix = F.substring(trimmed, F.lit(1), opening - 1)
    group = F.substring(trimmed, opening + 1, F.length(trimmed) - opening - 1)
    parts = F.split(group, ",")
    ranges = F.flatten(F.transform(parts, lambda part: _part_ranges(prefix, part)))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<{RANGE}>"))
        .when((opening == 0) | ~trimmed.endswith("]"), F.array(name_range(text)))
        .when(F.forall(parts, _is_range), ranges)
    )


def ranges(nodes: Column) -> Column:
    """Any landed shape of a node list to ranges of numbered names, however wide.

    A name listed twice is in two ranges. Null where ``normalise`` is null, or where a
    number has more than ``DIGITS`` digits.
    """

    def of_names(names: Column) -> Column:
        return F.transform(names, name_range)

    def listed(text: Column) -> Column:
        return F.when(
            text.startswith("["), of_names(F.from_json(text, "ARRAY<STRING>"))
        ).otherwise(_text_ranges(text))

    def of(parsed: Column) -> Column:
        names = F.filter(
            F.transform(parsed["allocation"], lambda node: node["name"]), lambda name: name != ""
        )
        return F.when(F.size(names) > 0, of_names(names)).otherwise(listed(parsed["list"]))

    from_object = F.get(F.transform(F.array(F.from_json(nodes, NODES_OBJECT)), of), F.lit(0))
    return F.when(nodes.startswith("{"), from_object).otherwise(listed(nodes))


def count_nodes(node_ranges: Column) -> Column:
    """How many names a list has, repeated ones included."""
    return F.aggregate(
        node_ranges, F.lit(0).cast("bigint"), lambda total, r: total + (r["high"] - r["low"] + 1)
    )
