"""Process samples: which processes are monitored, and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import matching, units
from fleetgauge.session import stored

# Characters in a run of the pattern index.
GRAM = 3


def match_processes(
    processes: DataFrame, owner: Column, patterns: Sequence[matching.Pattern]
) -> DataFrame:
    """Live processes of ``owner`` that match a pattern, titled by the first match."""
    command = matching.command_text(F.col("cmdline"))
    return (
        processes.filter(matching.is_monitored(F.col("status"), F.col("username"), owner))
        .withColumn("title", matching.first_title(command, patterns))
        .filter(F.col("title").isNotNull())
    )


def any_pattern(
    processes: DataFrame, owner: Column, patterns: Sequence[str]
) -> DataFrame:
    """Processes of ``owner`` whose command line holds any of the texts."""
    command = matching.command_text(F.col("cmdline"))
    return processes.filter(
        (F.col("username") == owner)
        & (F.size("cmdline") > 0)
        & matching.contains_any(command, patterns)
    )


def normalise_patterns(patterns: DataFrame) -> DataFrame:
    """Rows of ``title``, ``pattern`` and ``plain`` to label and pattern."""
    plain = F.col("plain")
    pattern = F.coalesce(plain, "pattern")
    return patterns.withColumns({
        "label": matching.pattern_label(F.coalesce(plain, "title"), pattern),
        "pattern": pattern,
    })


def match_processes_table(
    processes: DataFrame, owner: Column, patterns: DataFrame, gram: int = GRAM
) -> DataFrame:
    """``match_processes`` with the patterns in a table of ``priority``, ``title``, ``pattern``.

    The pattern of lowest priority counts; missing priorities come last, and ties go to
    the smaller pattern, then title. An empty title is a title, a missing one is the
    pattern.

    An inverted index of runs of ``gram`` characters finds the pairs to test. Each
    distinct command emits such a run for every place, shorter ones at its end, so it has
    as many rows as characters at most. A pattern is looked up under its rarest run, or
    nowhere if a run of it stands in no command; a pattern shorter than ``gram`` under all
    runs that begin with it. Pairs are then tested whole, so the result is exact.
    """
    live = processes.filter(
        matching.is_monitored(F.col("status"), F.col("username"), owner)
    ).withColumn("_command", matching.command_text(F.col("cmdline")))
    commands = stored(
        live.select("_command").distinct().withColumn("_hash", F.xxhash64("_command")), "commands"
    )
    usable = patterns.filter(F.coalesce("pattern", F.lit("")) != "").withColumn(
        "title", matching.pattern_label(F.col("title"), F.col("pattern"))
    )
    rank = F.struct(
        F.col("priority").isNull().alias("none"), "priority", F.col("pattern").alias("text"), "title"
    )
    first = usable.groupBy("pattern").agg(F.min(rank).alias("rank"))

    index = stored(_grams(commands, "_command", ["_hash"], gram, ends=True).distinct(), "grams")
    counts = stored(index.groupBy("gram").agg(F.count("*").alias("commands")), "gram-counts")
    short = F.length("pattern") < gram
    wanted = _grams(first.filter(~short), "pattern", ["pattern"], gram, ends=False).distinct()
    rarest = (
        wanted.join(counts, "gram", "left")
        .groupBy("pattern").agg(
            F.min_by("gram", F.struct("commands", "gram")).alias("gram"),
            F.bool_and(F.col("commands").isNotNull()).alias("met"),
        )
        .filter("met").select("pattern", "gram")
    )
    # A run begins with one text of each length.
    begins = counts.select(
        "gram", F.explode(F.sequence(F.lit(1), F.least(F.length("gram"), F.lit(max(gram - 1, 1))))).alias("_n")
    ).select("gram", F.substring("gram", F.lit(1), F.col("_n")).alias("pattern"))
    keyed = rarest.unionByName(first.filter(short).select("pattern").join(begins, "pattern"))
    titles = (
        index.join(keyed, "gram").select("_hash", "pattern").distinct()
        .join(commands, "_hash")
        .filter(F.col("_command").contains(F.col("pattern")))
        .join(first, "pattern")
        .groupBy("_command").agg(F.min("rank")["title"].alias("title"))
    )
    return live.join(titles, "_command").drop("_command")


def _grams(texts: DataFrame, text: str, keep: Sequence[str], gram: int, ends: bool) -> DataFrame:
    """Runs of ``gram`` characters of a text, from every place or from those that have a whole one."""
    last = F.length(text) if ends else F.length(text) - gram + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last))
    return texts.select(*keep, text, F.explode(places).alias("_place")).select(
        *keep, F.substring(text, F.col("_place"), F.lit(gram)).alias("gram")
    )


def process_snapshot(processes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seven process metrics, sizes in MiB."""

    def mib(name: str) -> Column:
        return units.bytes_to_mib(F.col(name))

    return processes.select(
        *keys,
        F.col("cpu_percent").alias("cpu"),
        F.col("memory_percent").alias("mem_pct"),
        mib("rss").alias("mem_rss"),
        mib("vms").alias("mem_vms"),
        F.col("num_threads").alias("threads"),
        mib("read_bytes").alias("io_read"),
        mib("write_bytes").alias("io_write"),
    )
