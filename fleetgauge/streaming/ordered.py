"""Keyed state machines that take rows in the order of their event time.

Rows of a stream land late and shuffled. A key holds its rows in state until the
watermark has passed them, then hands them on in order: an event-time timer of each key
stands at its earliest held row, or at the next moment the machine has something to say
by itself. A row that the watermark has passed already is not lost: it comes out at once,
marked as late. The state of a key is its held rows, which the watermark's delay bounds,
and the machine's own few values.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Rows of a piece of state or of output.
PIECE = 10_000


def _pieces(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[at : at + PIECE]),) for at in range(0, len(rows), PIECE)]


class InOrder(StatefulProcessor):
    """Base of a machine; a subclass says what rows in order, and time alone, give.

    Rows are tuples of ``ts`` in milliseconds, ``place`` that orders rows of one time,
    and ``fields``. Outputs are tuples too, without the key.
    """

    #: Columns of a row besides ``ts`` and ``place``, and the machine's own values, as DDL.
    fields: str
    own: str
    #: The machine's values before its first row.
    start: tuple
    #: Names of the outputs.
    gives: Sequence[str]

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def step(self, own: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The values after a row that has its turn, and what it gives."""
        raise NotImplementedError

    def late(self, row: tuple) -> tuple:
        """What a row gives that the watermark has passed before it came."""
        raise NotImplementedError

    def wait(self, own: tuple) -> int | None:
        """When the machine has something to say without any row."""
        return None

    def pass_by(self, own: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        """The values after that moment, none if they can be forgotten, and what it gives."""
        return own, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows are held by the piece, not one by one: each item of state is a call to Spark.
        self.held = handle.getListState("held", "piece binary")
        self.values = handle.getValueState("own", self.own)
        self.timer = handle.getValueState("timer", "at bigint")

    def _set_timer(self, before: int | None, after: int | None) -> None:
        if before == after:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if after is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(after)
            self.timer.update((after,))

    def _frame(self, key: Any, given: list[tuple]) -> pd.DataFrame:
        columns = {name: [part] * len(given) for name, part in zip(self.keys, key, strict=True)}
        columns |= zip(self.gives, zip(*given, strict=True), strict=True)
        return pd.DataFrame(columns, dtype=object)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:  # one Arrow batch at a time
            columns = [frame[name] for name in ("ts", "place", *frame.columns[len(self.keys) + 2 :])]
            values = [
                [None if gone else x for x, gone in zip(c.tolist(), c.isna(), strict=True)]
                if c.hasnans else c.tolist() for c in columns
            ]
            every = list(zip(*values, strict=True))
            timely = [row for row in every if row[0] > now]
            if timely:
                self.held.appendList(_pieces(timely))
                first.append(min(row[0] for row in timely))
            if len(timely) < len(every):
                yield self._frame(key, [self.late(row) for row in every if row[0] <= now])
        if first:
            at = self.timer.get()
            before = None if at is None else at[0]
            self._set_timer(before, min(first) if before is None else min(*first, before))

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        now, turn, rest = timerValues.getCurrentWatermarkInMs(), [], []
        for (piece,) in self.held.get():
            for row in pickle.loads(piece):
                (turn if row[0] <= now else rest).append(row)
        turn.sort(key=lambda row: row[:2])
        if turn:
            self.held.put(_pieces(rest)) if rest else self.held.clear()
        values = self.values.get()
        own: tuple | None = self.start if values is None else tuple(values)
        given: list[tuple] = []
        for row in turn:
            own, some = self.step(own, row)
            given += some
            if len(given) >= PIECE:
                yield self._frame(key, given)
                given = []
        while own is not None and (moment := self.wait(own)) is not None and moment <= now:
            own, some = self.pass_by(own, moment)
            given += some
        self.values.clear() if own is None else self.values.update(own)
        moments = [row[0] for row in rest]
        if own is not None and (moment := self.wait(own)) is not None:
            moments.append(moment)
        if moments:
            self._set_timer(None, min(moments))  # the one before has just gone off
        else:
            self.timer.clear()
        if given:
            yield self._frame(key, given)

    def close(self) -> None:
        pass


def run_in_order(
    rows: DataFrame, machine: InOrder, ts: str, place: str, fields: Sequence[str], delay: str,
    output: str,
) -> DataFrame:
    """Let the machine of each key take ``rows`` in order; ``delay`` is how late they may come.

    Rows without a time have no place in the order and are left out; times are after 1970,
    where the watermark of a new stream stands.
    """
    # Only the number of milliseconds goes on: Spark would drop late rows of a column
    # that it knows as the watermarked one.
    timed = (
        rows.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
        .select(
            *machine.keys, F.unix_millis(ts).alias("ts"), F.col(place).cast("bigint").alias("place"),
            *fields,
        )
    )
    return timed.groupBy(*machine.keys).transformWithStateInPandas(
        statefulProcessor=machine, outputStructType=output, outputMode="Append",
        timeMode="EventTime",
    )
