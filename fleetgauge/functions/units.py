"""Column expressions for units, defaults and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.constants import MESSAGE_KEEP, MESSAGE_LIMIT

# A hexadecimal mark, or a final d or f that does not end "inf".
NO_NUMBER = r"[xX]|[dD]\s*$|(?<![iI][nN])[fF]\s*$"

# A double, so that the quotient is a double and not a scaled decimal.
MIB = 1048576.0


def bytes_to_mib(size: Column) -> Column:
    return size / F.lit(MIB)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit("UNKNOWN"))


def to_number(text: Column) -> Column:
    """Text to double, null where it is no number.

    Spark's cast also takes a type suffix such as ``1d`` and hexadecimal floats,
    which are no numbers in JSON or CSV.
    """
    return F.when(~text.rlike(NO_NUMBER), text.try_cast("double"))


def epoch_to_hms(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def clip_message(message: Column) -> Column:
    return F.when(
        F.length(message) > MESSAGE_LIMIT,
        F.concat(F.left(message, F.lit(MESSAGE_KEEP)), F.lit("...")),
    ).otherwise(message)


def heap_bytes(peak: Column, memory: Column) -> Column:
    """Peak JVM heap if any peak was reported, else on-heap storage memory."""
    return F.when(F.size(peak) > 0, or_zero(peak["JVMHeapMemory"])).otherwise(
        or_zero(memory["usedOnHeapStorageMemory"])
    )


def free_slots(total: Column, used: Column) -> Column:
    return total - used
