"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its five-word shingles (a shorter text is one shingle).
Similarity is the weighted Jaccard coefficient: the sum of the smaller counts over the
sum of the larger ones. Two texts are linked at 0.8 or more; a class is a connected set
of links and is named by its smallest doc_id.

1. Signature. Each distinct shingle owns Poisson processes over its weight axis, one for
   each of the intervals [0,1), [1,2), [2,4), [4,8)... that its count reaches. Points
   come in order of time, each with a register and a place in the interval; those beyond
   the count are passed over. A register keeps the earliest point of all shingles, and a
   process ends at the latest time that any register holds. Equal registers then have
   the weighted Jaccard coefficient as their probability, without bias.
2. Texts with equal multisets become one, by a count per multiset before anything else.
3. Bands of registers are buckets. Pairs of a bucket are made in waves (``waves``), first
   one for each member, then, with the chance to link growing, between members of
   different components only, and checked exactly, from whole texts.
4. A pair is left out only where a bound proves it too different: each text has 2,048 bits,
   the parities of its shingles by hash; two texts differ in at least as many shingles as
   bits. Pairs inside a component can add nothing and are never made, so a large group of
   near copies costs a few pairs for each member.

Bands of six of 144 registers miss a pair at 0.8 with probability 7e-4, at 0.85 with 1e-5.

A text without words is like nothing, and a class by itself. A row without a doc_id
has no class. A text goes by its smallest doc_id, and texts that go by one are one class.
An empty table gives no rows. Columns besides the named two are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import waves
from fleetgauge.llm.common import column, sliced, unused
from fleetgauge.llm.text import mix, shingle_hashes, word_hashes
from fleetgauge.session import stored

THRESHOLD = 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS

#: Words of parity bits of each text.
WORDS = 32

#: Points drawn at once where few processes are left.
POINTS = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def counted(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, sorted by text, then hash."""
    order = np.lexsort([hashes, of])
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return hashes[first], of[first], np.diff(np.append(first, len(of)))


def signatures(hashes: np.ndarray, of: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """BagMinHash registers (texts x registers); rows of texts without shingles are infinite."""
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64) if len(count) else count
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, width, 0.0)
    weight, text = np.repeat(count, levels), np.repeat(of, levels)
    seed = mix(np.repeat(hashes, levels) + mix(level.astype(np.uint64)))
    registers = np.full(texts * REGISTERS, np.inf)
    time, going, drawn = np.zeros(len(seed)), np.arange(len(seed)), 0
    while len(going):
        some = max(1, min(64, POINTS // len(going)))
        turn = (np.uint64(drawn) + np.arange(1, some + 1, dtype=np.uint64)) * _STEP
        draw = mix(seed[going, None] + turn)
        wait = -np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
        wait /= width[going, None]
        wait[:, 0] += time[going]
        at = np.cumsum(wait, axis=1)  # one after the other, so equal whatever ``some`` is
        where = mix(draw ^ _STEP)
        slot = ((where >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        place = (where & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width[going, None]
        own = text[going]
        inside = place + low[going, None] < weight[going, None]
        index = own[:, None] * REGISTERS + slot.astype(np.int64)
        np.minimum.at(registers, index[inside], at[inside])
        time[going] = at[:, -1]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        latest = registers.reshape(texts, REGISTERS)[own[first]].max(axis=1)
        latest = np.repeat(latest, np.diff(np.append(first, len(own))))
        going = going[at[:, -1] < latest]
        drawn += some
    return registers.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A bucket for each band of a signature."""
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(-1, BANDS, ROWS)
    total = np.zeros(bits.shape[:2], np.uint64)
    for row in range(ROWS):
        total = mix(total + bits[:, :, row])
    return mix(total + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def parities(
    hashes: np.ndarray, of: np.ndarray, count: np.ndarray, texts: int, words: int = WORDS
) -> np.ndarray:
    """Bits of each text: whether it has an odd number of shingles of each hashed class."""
    bits = np.bincount(
        of * (64 * words) + (mix(hashes + _STEP) % np.uint64(64 * words)).astype(np.int64),
        count, texts * 64 * words,
    ).astype(np.int64) & 1
    packed = np.packbits(bits.reshape(texts, -1).astype(np.uint8), axis=1)
    return packed.view(np.int64)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, two sums that name the multiset, its size, ``bands`` if any, and parities."""
    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )

    def work(part: pa.RecordBatch) -> dict:
        n = part.num_rows
        hashes, of, count = counted(
            *shingle_hashes(*word_hashes(part.column("text").to_pylist()), short=True)
        )
        keys = np.zeros((2, n), np.uint64)
        for i, salt in enumerate((np.uint64(1), np.uint64(2))):
            np.add.at(keys[i], of, mix(hashes + salt) * count.astype(np.uint64))
        bands = band_keys(signatures(hashes, of, count, n))
        known = np.zeros(n, bool)
        known[of] = True
        return {
            "doc_id": part.column("doc_id"),
            "key1": keys[0].view(np.int64), "key2": keys[1].view(np.int64),
            "bands": [b if k else None for b, k in zip(bands, known, strict=True)],
            "n": np.bincount(of, count, n).astype(np.int64),
            "parity": list(parities(hashes, of, count, n)),
        }

    return sliced(
        read, "text", work,
        "doc_id bigint, key1 bigint, key2 bigint, bands array<bigint>, n bigint,"
        " parity array<bigint>",
    )


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard coefficient of the shingles of each pair of texts."""
    sides = []
    for texts in (left, right):
        hashes, of, count = counted(*shingle_hashes(*word_hashes(texts), short=True))
        sides.append((mix(hashes + mix(of.astype(np.uint64))), of, count))
    (a, of_a, count_a), (b, of_b, count_b) = sides
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.bincount(of_a[at_a], np.minimum(count_a[at_a], count_b[at_b]), len(left))
    total = np.bincount(of_a, count_a, len(left)) + np.bincount(of_b, count_b, len(left))
    return both / np.maximum(total - both, 1)


def linked(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by whole texts."""
    joined = pairs.join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(part: pa.RecordBatch) -> dict:
        like = overlaps(
            part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
        ) >= threshold - 1e-12
        return {c: part.column(c).filter(pa.array(like)) for c in ("a", "b")}

    return sliced(joined.select("a", "b", "text_a", "text_b"), "text_a", work, "a bigint, b bigint")


def may_link(threshold: float = THRESHOLD) -> Column:
    """Whether two texts may be similar: what they share is bounded by the bits that differ."""
    differ = sum(
        (F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_")[i])) for i in range(WORDS)),
        start=F.lit(0),
    )
    both = F.col("n") + F.col("n_")
    differ = F.greatest(differ, F.abs(F.col("n") - F.col("n_")))
    return (1 + threshold) * (both - differ) / 2 >= threshold * both - 1e-9


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` of every row."""
    rows = stored(signed(docs, doc_id, text), "signatures")
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("bands").isNotNull())
    distinct = stored(
        known.groupBy("key1", "key2").agg(
            F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("parity").alias("parity"),
        ),
        "distinct-texts",
    )
    members = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = stored(waves.shared_buckets(members), "shared-buckets")
    read = docs.select(column(doc_id).cast("bigint").alias("id"), column(text).alias("text"))
    texts = stored(waves.texts_of(read, shared.select("id").distinct()), "candidate-texts")
    facts = distinct.select(
        "id", "n", "parity", F.transform("bands", waves.low_half).alias("buckets")
    )
    labels = waves.connected(shared, facts, may_link(), lambda pairs: linked(pairs, texts))
    named = stored(
        distinct.join(labels, "id", "left").select(
            "key1", "key2", F.coalesce("label", "id").alias("class_id")
        ),
        "classes",
    )
    found = rows.join(named, ["key1", "key2"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), None)
        .otherwise(F.coalesce(F.when(F.col("bands").isNotNull(), F.col("class_id")), "doc_id"))
        .alias("class_id"),
    )


def first_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest document of each class, with all their columns.

    Rows without an id stay. Of rows equal in id and text one stays, the one whose columns
    have the smallest hash; rows of one id whose texts differ are all kept.
    """
    ids = column(doc_id).cast("bigint")
    mark = unused(docs, "gone")
    dropped = classes(docs, doc_id, text).filter(F.col("doc_id") != F.col("class_id"))
    gone = stored(dropped.select(F.col("doc_id").alias(mark)).distinct(), "copies")
    kept = docs.join(gone, ids == F.col(mark), "left_anti")
    repeated = stored(
        docs.select(ids.alias("id"), column(text).alias("text")).filter("id IS NOT NULL")
        .groupBy("id", "text").agg(F.count("*").alias("rows")).filter("rows > 1")
        .select(F.col("id").alias(mark)).distinct(),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, ids == F.col(mark), "left_anti")
    row = F.struct(*(column(c) for c in docs.columns))
    hashed = [column(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    several = (
        kept.join(repeated, ids == F.col(mark), "left_semi")
        .groupBy(column(doc_id), column(text)).agg(F.min_by(row, F.xxhash64(*hashed)).alias("row"))
    )
    return once.unionAll(several.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
