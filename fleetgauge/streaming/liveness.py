"""Whether clusters are up, while their reports come in, or fail to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.streaming.ordered import InOrder, run_in_order

REPORTED, SILENT, LATE = "reported", "silent", "late"


class Liveness(InOrder):
    """Tells every report, and once per silence that none has come for ``interval``.

    A silent cluster is forgotten ``forget`` after its last report.
    """

    fields = "up boolean"
    own = "last bigint, silent boolean"
    start = (None, False)
    gives = ("ts", "place", "up", "reason")

    def __init__(self, keys: Sequence[str], interval: int, forget: int) -> None:
        super().__init__(keys)
        self.interval, self.forget = interval, forget

    def _silence(self, own: tuple) -> list[tuple]:
        return [(own[0] + self.interval, None, False, SILENT)]

    def step(self, own: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        ts, place, up = row
        last, silent = own
        given = []
        if last is not None and not silent and ts - last > self.interval:
            given = self._silence(own)
        return (ts, False), [*given, (ts, place, up, REPORTED)]

    def late(self, row: tuple) -> tuple:
        return row[0], row[1], None, LATE

    def wait(self, own: tuple) -> int | None:
        if own[0] is None:
            return None
        return own[0] + (self.forget if own[1] else self.interval)

    def pass_by(self, own: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        return (None, []) if own[1] else ((own[0], True), self._silence(own))


def stream_cluster_up(
    reports: DataFrame,
    keys: Sequence[str],
    order: str,
    ts: str,
    delay: str,
    interval: float,
    forget: float,
    up: str = "up",
) -> DataFrame:
    """Keys, ``ts``, order, ``up`` and ``reason`` for every report and every silence.

    A report is told once the watermark has passed it. A cluster without a report for
    more than ``interval`` seconds is down from then on, told by a row of its own; it is
    up again with its next report. ``forget`` seconds after the last report its state goes
    (``forget`` is at least ``interval``). Reports behind the watermark are told as late.
    """
    if forget < interval:
        raise ValueError("a cluster can't be forgotten before it is silent")
    kinds = ", ".join(f"`{k}` {reports.schema[k].dataType.simpleString()}" for k in keys)
    taken = reports.select(*keys, order, ts, F.coalesce(F.col(up), F.lit(False)).alias("up"))
    machine = Liveness(keys, round(interval * 1000), round(forget * 1000))
    told = run_in_order(
        taken, machine, ts, order, ["up"], delay,
        f"{kinds}, ts bigint, place bigint, up boolean, reason string",
    )
    return told.select(
        *keys, F.timestamp_millis("ts").alias(ts), F.col("place").alias(order), "up", "reason"
    )
