"""Bounded histories: the last N samples of a series and their statistics.

Samples are long rows. ``keys`` name the series and ``order`` names the columns
that order its samples from oldest to newest; together they must be unique. A null
value has a place in the history, but statistics neither count nor add it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from fleetgauge.constants import HISTORY_SIZE
from fleetgauge.operators.chunks import with_carry_in

Names = Sequence[str]


def _newest_first(order: Names) -> list[Column]:
    return [F.desc(name) for name in order]


def _keep_newest(df: DataFrame, keys: Names, order: Names, n: int, age: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(*_newest_first(order))
    return df.withColumn(age, F.row_number().over(newest)).filter(F.col(age) <= n)


def last_n(
    df: DataFrame,
    keys: Names,
    order: Names,
    n: int = HISTORY_SIZE,
    age: str = "age",
    spread: int = 1,
) -> DataFrame:
    """The newest ``n`` rows of every series; ``age`` is 1 for the newest.

    Spark cuts every input partition to ``n`` rows per series before it shuffles,
    so a hot series arrives as ``n`` rows per map task. Where even that is too
    much for one task, ``spread`` cuts each series in that many parts first; the
    newest rows of the parts contain the newest rows of the whole.
    """
    if spread > 1:
        part = F.pmod(F.xxhash64(*order), F.lit(spread))
        df = _keep_newest(
            df.withColumn("_part", part), [*keys, "_part"], order, n, "_age"
        ).drop("_part", "_age")
    return _keep_newest(df, keys, order, n, age)


def history_arrays(
    df: DataFrame,
    keys: Names,
    order: Names,
    value: str = "value",
    n: int = HISTORY_SIZE,
    padded: bool = True,
) -> DataFrame:
    """One array per series, oldest first; ``padded`` fills the old end with zeros."""
    aged = F.struct((-F.col("age")).alias("age"), F.col(value).cast("double").alias("value"))
    values = F.transform(F.array_sort(F.collect_list(aged)), lambda s: s["value"])
    arrays = last_n(df, keys, order, n).groupBy(*keys).agg(values.alias("values"))
    if not padded:
        return arrays
    zeros = F.array_repeat(F.lit(0.0), n - F.size("values"))
    return arrays.withColumn("values", F.concat(zeros, "values"))


def _mean(total: Column, count: Column) -> Column:
    return total.cast("double") / count


def series_stats(recent: DataFrame, keys: Names, value: str = "value") -> DataFrame:
    """Mean, maximum and minimum of each series of ``last_n`` rows."""
    samples = F.count(value)
    return recent.groupBy(*keys).agg(
        samples.alias("samples"),
        _mean(F.sum(value), samples).alias("mean"),
        F.max(value).cast("double").alias("max"),
        F.min(value).cast("double").alias("min"),
    )


def padded_stats(
    recent: DataFrame, keys: Names, value: str = "value", n: int = HISTORY_SIZE
) -> DataFrame:
    """Statistics of the zero-padded history, without building the padding."""
    samples = F.count(value)
    high, low = F.max(value).cast("double"), F.min(value).cast("double")
    short = samples < n
    return recent.groupBy(*keys).agg(
        samples.alias("samples"),
        _mean(F.sum(value), F.lit(n)).alias("mean"),
        F.when(short, F.greatest(high, F.lit(0.0))).otherwise(high).alias("max"),
        F.when(short, F.least(low, F.lit(0.0))).otherwise(low).alias("min"),
    )


def overlay(recent: DataFrame, keys: Names, value: str = "value") -> DataFrame:
    """Mean, maximum and minimum of the series next to each of its points."""
    series = Window.partitionBy(*keys)
    return (
        recent.withColumn("mean", _mean(F.sum(value).over(series), F.count(value).over(series)))
        .withColumn("max", F.max(value).over(series).cast("double"))
        .withColumn("min", F.min(value).over(series).cast("double"))
    )


def rolling_stats(
    df: DataFrame,
    keys: Names,
    order: Names,
    chunk: Column,
    value: str = "value",
    n: int = HISTORY_SIZE,
    padded: bool = False,
) -> DataFrame:
    """The statistics a bounded history shows right after each of its samples.

    ``chunk`` cuts a series in consecutive pieces (see ``with_carry_in``), so a
    series of any length is spread over many tasks.
    """
    pieces = with_carry_in(df.withColumn("_chunk", chunk), keys, "_chunk", order, n - 1)
    by_chunk = [*keys, "_chunk"]
    place = F.row_number().over(Window.partitionBy(*by_chunk).orderBy(*order)) - 1
    blocks = pieces.withColumn("_place", place).withColumn(
        "_block", F.floor(F.col("_place") / n)
    )
    # A window of n rows is the end of one block and the start of the next, so two running
    # scans and a look n - 1 rows back give what n rows hold, whatever n is.
    in_block = Window.partitionBy(*by_chunk, "_block")
    here = in_block.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rest = in_block.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)

    def parts(window: WindowSpec) -> Column:
        return F.struct(
            F.count(value).over(window).alias("count"), F.sum(value).over(window).alias("sum"),
            F.max(value).over(window).alias("max"), F.min(value).over(window).alias("min"),
        )

    back = F.lag("_rest", n - 1).over(Window.partitionBy(*by_chunk).orderBy("_place"))
    whole = F.col("_place") % n == n - 1  # a window that is one block
    scanned = (
        blocks.withColumn("_rest", parts(rest)).withColumn("_here", parts(here))
        .withColumn("_back", F.when(~whole, back))
    )
    # Rows without a full window yet have nothing behind their block's start.
    samples = F.col("_here.count") + F.coalesce("_back.count", F.lit(0))
    total = _either("sum", lambda a, b: a + b)
    high = _either("max", F.greatest).cast("double")
    low = _either("min", F.least).cast("double")
    size = samples
    if padded:
        size = F.lit(n)
        high = F.when(samples < n, F.greatest(high, F.lit(0.0))).otherwise(high)
        low = F.when(samples < n, F.least(low, F.lit(0.0))).otherwise(low)
    return (
        scanned.withColumns({"samples": samples, "mean": _mean(total, size), "max": high, "min": low})
        .filter(~F.col("carried"))
        .select(*[name for name in df.columns], "samples", "mean", "max", "min")
    )


def _either(name: str, both: Callable[[Column, Column], Column]) -> Column:
    """What the two halves of a window have together; one of them may hold nothing."""
    here, back = F.col(f"_here.{name}"), F.col(f"_back.{name}")
    return F.when(back.isNull(), here).when(here.isNull(), back).otherwise(both(here, back))
