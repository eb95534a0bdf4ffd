"""Sets of nodes as ranges: members, differences and counts without writing names out.

Frames of ranges have key columns and ``prefix``, ``width``, ``low``, ``high`` (see
``functions.nodelists.ranges``); prefix, width and a number make up one name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import nodelists

Names = Sequence[str]
SPACE = ["prefix", "width"]
RANGE = [*SPACE, "low", "high"]

#: Names that one row is expanded to before the next step.
PIECE = 10_000


def exploded(lists: DataFrame, keys: Names, nodes: str = "nodes") -> DataFrame:
    """The ranges of every node list; lists that cannot be read or are empty have none."""
    return (
        lists.select(*keys, F.explode_outer(nodelists.ranges(F.col(nodes))).alias("_r"))
        .filter(F.col("_r").isNotNull()).select(*keys, "_r.*")
    )


def covered(ranges: DataFrame, keys: Names) -> DataFrame:
    """Disjoint ranges of the same names, as few as there can be."""
    return difference(ranges, ranges.limit(0), keys)


def difference(left: DataFrame, right: DataFrame, keys: Names) -> DataFrame:
    """Names of ``left`` that ``right`` does not have, per key, as disjoint ranges.

    A sweep over the ends of all ranges; a key's ends in one space of names are in one
    task, so many equal ends are folded to one row before they meet.
    """
    group = [*keys, *SPACE]

    def ends(ranges: DataFrame, ours: int) -> DataFrame:
        opened = ranges.select(*group, F.col("low").alias("at"), F.lit(1).alias("step"))
        closed = ranges.select(*group, (F.col("high") + 1).alias("at"), F.lit(-1).alias("step"))
        return opened.unionByName(closed).withColumn("ours", F.lit(ours))

    steps = ends(left, 1).unionByName(ends(right, 0)).groupBy(*group, "at").agg(
        F.sum(F.col("step") * F.col("ours")).alias("ours"),
        F.sum(F.col("step") * (1 - F.col("ours"))).alias("theirs"),
    )
    along = Window.partitionBy(*group).orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.sum("ours").over(so_far) > 0) & (F.sum("theirs").over(so_far) == 0)
    marked = steps.select(*group, "at", inside.alias("inside"))
    edges = marked.withColumn("before", F.coalesce(F.lag("inside").over(along), F.lit(False))).filter(
        F.col("inside") != F.col("before")
    )
    return (
        edges.withColumn("next", F.lead("at").over(along)).filter("inside")
        .select(*group, F.col("at").alias("low"), (F.col("next") - 1).alias("high"))
    )


def sizes(ranges: DataFrame, keys: Names) -> DataFrame:
    """``nodes``, the number of names per key, repeated ones included."""
    return ranges.groupBy(*keys).agg(F.sum(F.col("high") - F.col("low") + 1).alias("nodes"))


def members(names: DataFrame, ranges: DataFrame, name: str = "name") -> DataFrame:
    """Rows of ``names`` next to the keys of each range that holds them.

    A join on equal keys: a range stands in the one or two blocks that cover it, of the
    least power of two that is no shorter than it; a name is looked up in its block of
    each power that occurs, of which there are at most 60. Names are compared by number
    after that. Columns of the two sides must differ.
    """
    level = F.ceil(F.log2(F.col("high") - F.col("low") + 1)).cast("int")
    blocks = ranges.withColumn("_level", level).select(
        "*", F.explode(F.array_distinct(F.array(
            F.expr("shiftright(low, _level)"), F.expr("shiftright(high, _level)")
        ))).alias("_block"),
    )
    levels = sorted(row[0] for row in blocks.select("_level").distinct().collect())
    if not levels:
        return names.join(ranges.drop(*RANGE), F.lit(False))
    placed = names.withColumn("_name", nodelists.name_range(F.col(name))).select(
        *names.columns, F.col("_name.prefix"), F.col("_name.width"), F.col("_name.low").alias("_number"),
        F.explode(F.array(*map(F.lit, levels))).alias("_level"),
    ).withColumn("_block", F.expr("shiftright(_number, _level)"))
    return (
        placed.join(blocks, [*SPACE, "_level", "_block"])
        .filter(F.col("_number").between(F.col("low"), F.col("high")))
        .drop(*RANGE, "_level", "_block", "_number")
    )


def written_out(ranges: DataFrame, keys: Names, piece: int = PIECE) -> DataFrame:
    """Every name of the ranges as a row, in pieces of bounded size."""
    starts = ranges.select(
        *keys, *RANGE, F.explode(F.sequence("low", "high", F.lit(piece).cast("bigint"))).alias("_from")
    )
    numbers = starts.select(
        *keys, *SPACE, F.explode(F.sequence("_from", F.least(F.col("_from") + piece - 1, "high"))).alias("_n")
    )
    digits = F.when(F.col("width") == 0, F.lit("")).otherwise(
        F.lpad(F.col("_n").cast("string"), F.col("width"), F.lit("0"))
    )
    return numbers.select(*keys, F.concat("prefix", digits).alias("name"))
