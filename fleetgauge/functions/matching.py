"""Which process pattern a command line matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Pattern = str | dict[str, str]

GONE = ("zombie", "dead")


def normalise(pattern: Pattern) -> dict[str, str]:
    """A plain text names itself."""
    if isinstance(pattern, str):
        return {"title": pattern, "pattern": pattern}
    return pattern


def pattern_label(title: Column, pattern: Column) -> Column:
    return F.coalesce(title, pattern, F.lit("unknown"))


def command_text(cmdline: Column) -> Column:
    return F.array_join(cmdline, " ")


def first_title(command: Column, patterns: Sequence[Pattern]) -> Column:
    """Label of the first pattern, in list order, contained in the command."""
    label = None
    for item in map(normalise, patterns):
        text = item.get("pattern")
        if not text:
            continue
        title = item.get("title")
        hit, title = command.contains(text), F.lit(text if title is None else title)
        label = F.when(hit, title) if label is None else label.when(hit, title)
    return F.lit(None).cast("string") if label is None else label


def contains_any(command: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for text in patterns:
        if text:
            hit = hit | command.contains(text)
    return hit


def is_monitored(status: Column, username: Column, owner: Column) -> Column:
    """Alive and owned by the given user; a status that was not reported is alive."""
    return F.coalesce(~status.isin(*GONE), F.lit(True)) & (username == owner)
