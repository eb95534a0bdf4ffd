"""Which entity each poll reports on, while polls come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.streaming.ordered import InOrder, run_in_order


class Sticky(InOrder):
    """Keeps the first candidate offered until a poll fails; then the next poll chooses."""

    fields = "candidate string, ok boolean"
    own = "choice string"
    start = (None,)
    gives = ("place", "entity_id", "late")

    def __init__(self, keys: Sequence[str], fallback: str | None = None) -> None:
        super().__init__(keys)
        self.fallback = fallback

    def step(self, own: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        _, place, candidate, ok = row
        choice = own[0] if own[0] is not None else candidate
        if not ok:
            return (None,), []
        told = choice if choice is not None else self.fallback
        return (choice,), [] if told is None else [(place, told, False)]

    def late(self, row: tuple) -> tuple:
        return row[1], None, True


def stream_sticky_entity(
    polls: DataFrame,
    keys: Sequence[str],
    order: str,
    ts: str,
    delay: str,
    candidate: str = "candidate",
    ok: str = "ok",
    fallback: str | None = None,
) -> DataFrame:
    """``sticky_entity`` of a stream whose polls come shuffled: keys, order, entity, ``late``.

    A poll is told on once the watermark has passed it, ``delay`` behind the latest time
    seen. Polls that come later than that are told as ``late``, without an entity; they
    neither offer an application nor end a choice. A poll whose outcome is unknown failed.
    """
    kinds = ", ".join(f"`{k}` {polls.schema[k].dataType.simpleString()}" for k in keys)
    taken = polls.select(
        *keys, order, ts, F.col(candidate).cast("string").alias("candidate"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok"),
    )
    return run_in_order(
        taken, Sticky(keys, fallback), ts, order, ["candidate", "ok"], delay,
        f"{kinds}, place bigint, entity_id string, late boolean",
    ).withColumnRenamed("place", order)
