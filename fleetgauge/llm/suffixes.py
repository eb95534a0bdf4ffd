"""Removal of repeated byte strings over range-partitioned suffixes.

A byte is removed if a string of 100 bytes that covers it also starts earlier: in a
document with a smaller doc_id, or before in the same one. All strings are judged on the
input. Suffixes of every byte would be a hundred times the text, so the suffix array is
a sparse one that still decides every string:

1. Each string is represented by one suffix inside it, the leftmost with the smallest
   hash of its first 24 bytes among the string's 77. Equal strings have equal
   representatives at equal places, and one suffix in about 38 represents any.
2. The suffixes are range-partitioned by their leading bytes and the hash of all 24,
   with splitters that Spark samples; the document and place break ties, so a passage
   that very many documents share is spread over buckets. Buckets sort by those keys, and
   neighbours are compared: a lead that stands alone holds no repeat; where the whole
   surroundings equal those of the neighbour before, all strings are repeats. Leads at
   the edges of a bucket may go on in the next one and stay open.
3. What is open are the ends of matches. Their surroundings, at most 176 bytes, are read
   from the texts, and all their strings sorted within a lead. Leads with very many
   different surroundings are split by document first; the first string of each part
   then meets those of the other parts.

Strings count as equal if their leads and their 64-bit hashes are equal.

A null text is empty. A null doc_id is smaller than any other. Rows with one doc_id are
one document for the order: equal strings at equal places of such rows are not earlier
than each other, so repeated rows stay or go together. Texts of fewer than 100 bytes stay
whole. Long texts are cut into overlapping pieces for memory only. An empty table gives
no rows. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import column, sliced, slices
from fleetgauge.llm.text import mix, powers, prefix_hash
from fleetgauge.session import stored

#: Bytes of a string, and of the lead of a suffix.
LENGTH, LEAD = 100, 24
WINDOW = LENGTH - LEAD + 1

#: Bytes of a text worked on at once, and surroundings of one lead in one group.
PIECE, GROUP = 1 << 21, 1 << 13

#: Surroundings whose strings are sorted at once.
ROWS = 20_000

_POSITION = np.uint64((1 << 24) - 1)

SUFFIXES = "key bigint, whole bigint, d bigint, t bigint, start bigint, n int"
RUNS = "d bigint, t bigint, start bigint, n int, key bigint"
FOUND = "d bigint, t bigint, start bigint, n int, string bigint"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def representatives(data: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes that represent the strings of each text in ``data``.

    Returns for each the first string it stands for, how many follow one another, its
    leading bytes with their hash, and a hash of all bytes of these strings.
    """
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    n = len(data) - LEAD + 1
    hashes = mix((sums[LEAD:] - sums[:n]) * inverse[:n])
    least = sliding_minimum((hashes & ~_POSITION) | np.arange(n, dtype=np.uint64), WINDOW)
    at = (least & _POSITION).astype(np.int64)
    text = of[: len(at)]
    inside = text == of[LENGTH - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    first, count = first[inside[first]], count[inside[first]]
    anchor = at[first]
    end = first + count - 1 + LENGTH
    shape = mix((((anchor - first) << 8) | count).astype(np.uint64))
    whole = mix((sums[end] - sums[first]) * inverse[first] + shape)
    lead = np.zeros(len(anchor), np.uint64)
    for i in range(3):
        lead = (lead << np.uint64(8)) | data[anchor + i]
    return first, count, (lead << np.uint64(40)) | (hashes[anchor] >> np.uint64(24)), whole


def pieces(coded: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts in bounded amounts: data, piece, and per piece its text and start."""
    held: list[bytes] = []
    of: list[int] = []
    starts: list[int] = []

    def packed():
        data = np.frombuffer(b"".join(held), np.uint8)
        piece = np.repeat(np.arange(len(held)), [len(h) for h in held])
        return data, piece, np.array(of), np.array(starts)

    size = 0
    for text, code in enumerate(coded):
        for start in range(0, max(1, len(code) - LENGTH + 1), PIECE):
            part = code[start : start + PIECE + LENGTH - 1]
            held.append(part)
            of.append(text)
            starts.append(start)
            size += len(part)
            if size >= PIECE:
                yield packed()
                held, of, starts, size = [], [], [], 0
    if held:
        yield packed()


def _coded(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def suffixes(texts: DataFrame) -> DataFrame:
    """The representing suffixes of all texts (d, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            d, t = (part.column(c).to_numpy() for c in ("d", "t"))
            for data, piece, of, starts in pieces(_coded(part)):
                first, count, key, whole = representatives(data, piece)
                own = piece[first] if len(first) else first
                begin = np.searchsorted(piece, np.arange(len(of)))
                row = of[own] if len(own) else own
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array(d[row]), pa.array(t[row]),
                        pa.array(first - begin[own] + starts[own] if len(own) else first),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["key", "whole", "d", "t", "start", "n"],
                )

    return texts.mapInArrow(run, SUFFIXES)


def compared(found: DataFrame) -> DataFrame:
    """Runs of strings that are repeats, and those that stay open (with a ``key``)."""
    spark = found.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "whole", "d", "start"]
    ranged = found.repartitionByRange(buckets, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, whole, d, t, start, n = (c.to_numpy() for c in table.columns)
        new_key = np.append(True, key[1:] != key[:-1])
        new_whole = new_key | np.append(True, whole[1:] != whole[:-1])
        first = np.flatnonzero(new_key)
        kinds = np.add.reduceat(new_whole.astype(np.int64), first)
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        size = np.diff(np.append(first, len(key)))
        earliest = np.maximum.accumulate(np.where(new_whole, np.arange(len(key)), 0))
        later = (d != d[earliest]) | (start != start[earliest])
        open_ = np.repeat((kinds > 1) | edge, size) & ~later
        for rows, is_open in ((np.flatnonzero(later), False), (np.flatnonzero(open_), True)):
            for i in range(0, len(rows), 100_000):
                own = rows[i : i + 100_000]
                lead = pa.array(key[own]) if is_open else pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[own]) for x in (d, t, start, n)), lead],
                    names=["d", "t", "start", "n", "key"],
                )

    return ranged.mapInArrow(run, RUNS)


def dealt(open_: DataFrame) -> DataFrame:
    """Open runs with the part of their lead they are compared in.

    Only leads with more runs than a group should hold have several parts.
    """
    large = stored(
        open_.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("runs"))
        .filter(F.col("runs") > GROUP),
        "large-leads",
    )
    parts = F.ceil(F.col("runs") / GROUP)
    return open_.join(large, F.col("key") == F.col("key_"), "left").select(
        *open_.columns,
        F.coalesce(F.pmod(F.xxhash64("d"), parts), F.lit(0)).cast("bigint").alias("part"),
        F.col("runs").isNotNull().alias("split"),
    )


def surroundings(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Open runs with the bytes that their strings cover."""
    lists = runs.groupBy("d", "t").agg(
        F.collect_list(F.struct("start", "n", "key", "part", "split")).alias("runs")
    )
    joined = texts.join(lists, ["d", "t"]).select("d", "t", "text", "runs")

    def work(part: pa.RecordBatch) -> dict:
        coded, made = _coded(part), []
        for row, code in enumerate(coded):
            made += [
                (row, *run.values(), code[run["start"] : run["start"] + run["n"] + LENGTH - 1])
                for run in part.column("runs")[row].as_py()
            ]
        rows = [x[0] for x in made]
        named = ("start", "n", "key", "part", "split", "bytes")
        return {"d": part.column("d").take(pa.array(rows, pa.int64())),
                "t": part.column("t").take(pa.array(rows, pa.int64()))} | {
            name: [x[i + 1] for x in made] for i, name in enumerate(named)
        }

    return sliced(joined, "text", work, RUNS + ", part bigint, split boolean, bytes binary")


def decided(open_: DataFrame) -> DataFrame:
    """Repeats among open strings, group by group; ``string`` marks those still open."""
    grouped = open_.repartition("key", "part").sortWithinPartitions("key", "part")

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        d, t, start, key = (rows.column(c).to_numpy() for c in ("d", "t", "start", "key"))
        n = rows.column("n").to_numpy().astype(np.int64)
        part = rows.column("part").to_numpy().astype(np.uint64)
        split = rows.column("split").to_numpy(zero_copy_only=False)
        code = rows.column("bytes").to_pylist()
        sums = prefix_hash(np.frombuffer(b"".join(code), np.uint8))
        _, inverse = powers(len(sums))
        at = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at += turn
        row = np.repeat(np.arange(len(n)), n)
        string = mix((sums[at + LENGTH] - sums[at]) * inverse[at])
        string = mix(string + mix(key.view(np.uint64))[row])
        begin = start[row] + turn
        grouped = string + part[row] * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort([begin, d[row], grouped])
        same = np.zeros(len(order), bool)
        same[1:] = grouped[order][1:] == grouped[order][:-1]
        same[1:] &= (d[row][order][1:] != d[row][order][:-1]) | (
            begin[order][1:] != begin[order][:-1]
        )
        repeat = _after_first(same, grouped[order])
        flagged = np.zeros(len(order), bool)
        flagged[order] = repeat
        new = flagged & ~(np.append(False, flagged[:-1]) & (turn > 0))
        first = np.flatnonzero(new)
        goes_on = np.append(flagged[1:], False) & np.append(turn[1:] > 0, False)
        last = np.flatnonzero(flagged & ~goes_on)
        yield _found(d[row[first]], t[row[first]], begin[first], last - first + 1, None)
        rest = np.flatnonzero(~flagged & split[row])
        yield _found(
            d[row[rest]], t[row[rest]], begin[rest], np.ones(len(rest)), string[rest].view(np.int64)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                table = pa.Table.from_batches(held)
                key, part = (table.column(c).to_numpy() for c in ("key", "part"))
                last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
                if len(last):
                    yield from work(table.slice(0, last[-1] + 1))
                    table = table.slice(last[-1] + 1)
                held, count = table.to_batches(), table.num_rows
        if count:
            yield from work(pa.Table.from_batches(held))

    return grouped.mapInArrow(run, FOUND)


def _after_first(same: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether any place before, in sorted order of the group, is an earlier one."""
    if not len(group):
        return same
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    total = np.cumsum(same)
    before = np.repeat(total[first] - same[first], np.diff(np.append(first, len(group))))
    return total - before > 0


def _found(d, t, start, n, string) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(d), pa.array(t), pa.array(start), pa.array(n.astype(np.int32)),
            pa.nulls(len(d), pa.int64()) if string is None else pa.array(string),
        ],
        names=["d", "t", "start", "n", "string"],
    )


def met(rest: DataFrame) -> DataFrame:
    """Repeats among the strings that are first in the parts of a split lead.

    A string has at most one row per part here, however often it occurs.
    """
    least = rest.groupBy("string").agg(
        F.min(F.struct("d", "start")).alias("least"), F.count("*").alias("times")
    ).filter(F.col("times") > 1).select(F.col("string").alias("string_"), "least")
    later = (F.col("string") == F.col("string_")) & (
        F.struct("d", "start") > F.col("least")
    )
    return rest.join(least, later, "left_semi").select("d", "t", "start", "n")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``d, t, text``: the order of documents, and what tells rows of one id apart."""
    ids = column(doc_id).cast("bigint")
    repeated = docs.groupBy(ids.alias("id")).count().filter("count > 1")
    own = F.lit(0).cast("bigint") if repeated.isEmpty() else F.xxhash64(column(text))
    others = [column(name) for name in docs.columns if name != text]
    return docs.select(
        F.coalesce(ids, F.lit(-(1 << 63))).alias("d"), own.alias("t"),
        column(text).alias("text"),
        F.struct(*others).alias("row"),
    )


def repeats(texts: DataFrame) -> DataFrame:
    """Runs (d, t, start, n) of repeated strings of the keyed texts."""
    plain = texts.select("d", "t", "text")
    runs = stored(compared(suffixes(plain)), "runs")
    open_ = surroundings(plain, dealt(runs.filter(F.col("key").isNotNull())))
    found = stored(decided(open_), "decided")
    return (
        runs.filter(F.col("key").isNull()).select("d", "t", "start", "n")
        .unionAll(found.filter(F.col("string").isNull()).select("d", "t", "start", "n"))
        .unionAll(met(found.filter(F.col("string").isNotNull())))
    )


def removed(size: int, runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans of bytes covered by repeated strings."""
    if not runs:
        return []
    start = np.array([r["start"] for r in runs])
    end = np.array([r["start"] + r["n"] - 1 + LENGTH for r in runs])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > end[:-1])
    last = np.append(first[1:], True)
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False
) -> DataFrame:
    """Every row with what is left of its text.

    ``row`` (all other columns of the input), ``kept`` (bytes, or with ``as_text`` what
    whole characters they hold; null for null), ``n_bytes`` and ``spans`` (removed bytes
    from ``start`` up to ``end``).
    """
    texts = keyed(docs, doc_id, text)
    lists = repeats(texts).groupBy("d", "t").agg(
        F.collect_list(F.struct("start", "n")).alias("runs")
    )
    joined = texts.join(lists, ["d", "t"], "left").select("row", "text", "runs")
    span = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    schema = (
        T.StructType([joined.schema["row"]]).add(
            "kept", T.StringType() if as_text else T.BinaryType()
        ).add("n_bytes", T.LongType()).add("spans", T.ArrayType(span))
    )

    def work(part: pa.RecordBatch) -> dict:
        kept, spans, sizes = [], [], []
        for code, runs in zip(_coded(part), part.column("runs").to_pylist(), strict=True):
            out = removed(len(code), runs or [])
            at, left = 0, []
            for start, end in out:
                left.append(code[at:start])
                at = end
            rest = b"".join([*left, code[at:]])
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            spans.append([{"start": s, "end": e} for s, e in out])
            sizes.append(len(code))
        nulls = part.column("text").is_null().to_pylist()
        kept = [None if null else k for null, k in zip(nulls, kept, strict=True)]
        return {"row": part.column("row"), "kept": kept, "n_bytes": sizes, "spans": spans}

    return sliced(joined, "text", work, schema)


def digests(docs: DataFrame) -> DataFrame:
    result = deduplicated(docs.select("doc_id", "text"))
    size = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
    )
    return result.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", size.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )


def cut_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, with what is left as their texts."""
    result = deduplicated(docs, doc_id, text, as_text=True)
    return result.select(*(
        F.col("kept").alias(name) if name == text
        else F.col("row").getField(name).alias(name)
        for name in docs.columns
    ))
