"""Alignment of two tokenizers' tokens over whole documents, and how often ids meet.

Both sides encode the same bytes: a space and the text. Tokens are cut into groups at the
byte offsets where a token of either side ends; tokens of a group are linked with each other.

1. Diagonal run skipping. While tokens agree one to one, the arrays of end offsets are
   equal at the current shift of indices: slices of doubling length are compared, then of
   halving length, which jumps a whole stretch in a few steps. Where ends differ, the side
   that is behind goes on until both end together: that is one irregular group, and the
   shift is what it is from there on.
2. Each document's distinct links, with how often they occur in it, are written with the
   document. The documents that hold a link are counted over the whole corpus.
3. Counts return to the documents in two ways, both exact. The commonest links, at most
   ``COMMON`` of them, are broadcast; so is the highest count of each id of the first
   side, of which there are no more than its vocabulary has. All other links, by then
   rare ones, are joined by their ids, so no key of that join is a hot one.

Special tokens are never added, and their strings inside texts are plain text. Null and
empty texts have no tokens, nor have texts of which either side's bytes, joined, differ
from the input (signs that a vocabulary cannot write); all their counts are zero and
their digest is empty. Every row of the table is a document of its own, rows with one
doc_id, or none, included. A long group of many tokens is folded by its distinct ids, so
its links are never listed one by one. An empty table gives no rows. Columns besides the
named two are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import column, sliced
from fleetgauge.llm.tokens import _byte_signs, vocabulary
from fleetgauge.session import stored

#: The two vocabularies of the query.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Links whose counts are broadcast, at most.
COMMON = 1 << 18

#: Links of one group that are listed one by one, at most.
LISTED = 1 << 12

#: Tokens compared one by one before slices are.
PROBE = 4

#: How the byte-level vocabulary cuts a text into words; fixed value.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: Runs of blanks that only the slower of two equal encoders takes.
_BLANKS = re.compile(r"\s{500}")


class ByteSide:
    """Ids of a byte-level vocabulary in a ``tokenizers`` file, and the bytes of each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        special = {t.content for t in self._whole.get_added_tokens_decoder().values()}
        of = {chr(sign): byte for byte, sign in _byte_signs().items()}
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        ranks = {
            bytes(of[c] for c in token): i for token, i in entries.items() if token not in special
        }
        self.bytes = [b""] * (max(entries.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # Merges of such a vocabulary go by id, so this faster encoder gives equal ids.
        self._fast = tiktoken.Encoding(
            "bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self._whole.encode(" " + t, add_special_tokens=False).ids if _BLANKS.search(t)
            else self._fast.encode_ordinary(" " + t)
            for t in texts
        ]


class PieceSide:
    """Ids of a ``sentencepiece`` model, which puts the space itself, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            if self._model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif self._model.is_control(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Sides:
    """Two encoders, with what is looked up by id."""

    def __init__(self, first, second):
        self.sides = first, second
        self.size = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        self.bytes = [np.array(s.bytes, object) for s in self.sides]
        # Every id with the sign that follows it: inside and at the end of its side's group.
        self.signs = np.array(
            [f"{i}{sign}" for side, end in zip(self.sides, "|;", strict=True)
             for sign in ("," + end) for i in range(len(side.bytes))], object)
        self.at = np.cumsum([0, *(len(s.bytes) for s in self.sides for _ in range(2))])


@cache
def _sides(first: str, second: str) -> Sides:
    return Sides(ByteSide(first), PieceSide(second))


def groups(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side are used up at the end of each group.

    Both lists rise strictly from above zero and end with the same offset.
    """
    a, b = [*ends_a, -1], [*ends_b, -2]  # never equal, so no run goes past the last token
    i, j, n = 0, 0, len(ends_a)
    start, stretches = 0, []
    while True:
        step = 0
        while a[i] == b[j]:
            i, j, step = i + 1, j + 1, step + 1
            if step == PROBE:
                while a[i : i + step] == b[j : j + step]:
                    i, j, step = i + step, j + step, step * 2
                while step > 1:
                    step //= 2
                    if a[i : i + step] == b[j : j + step]:
                        i, j = i + step, j + step
                break
        stretches.append((start, i, j - i))
        if i >= n:
            break
        end_a, end_b = a[i], b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = a[i]
            else:
                j += 1
                end_b = b[j]
        # The group's last tokens end together, so the next stretch begins with them.
        start, i, j = i, i + 1, j + 1
    first, last, shift = np.array(stretches, np.int64).T
    size = last - first
    used_a = np.arange(1, size.sum() + 1) + np.repeat(first - (np.cumsum(size) - size), size)
    return used_a, used_a + np.repeat(shift, size)


def links(
    a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of ids, the first one in the upper half, and how often each occurs."""
    from_a, from_b = np.append(0, used_a[:-1]), np.append(0, used_b[:-1])
    size_a, size_b = used_a - from_a, used_b - from_b
    few = size_a * size_b <= LISTED
    taken = np.repeat(few, size_a)
    times = np.repeat(size_b, size_a)[taken]
    left = np.repeat(a[taken], times)
    right = b[
        np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        + np.repeat(np.repeat(from_b, size_a)[taken], times)
    ]
    found, counts = np.unique((left << 32) | right, return_counts=True)
    for g in np.flatnonzero(~few):
        x, n_x = np.unique(a[from_a[g] : used_a[g]], return_counts=True)
        y, n_y = np.unique(b[from_b[g] : used_b[g]], return_counts=True)
        both, index = np.unique(
            np.append(found, ((x << 32)[:, None] | y).ravel()), return_inverse=True
        )
        every = np.append(counts, np.outer(n_x, n_y).ravel())
        counts = np.zeros(len(both), np.int64)
        np.add.at(counts, index, every)
        found = both
    return found, counts


def written(sides: Sides, a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray) -> str:
    """Groups as text: ids of a side with commas, sides with a bar, groups with semicolons."""
    size_a, size_b = np.diff(used_a, prepend=0), np.diff(used_b, prepend=0)
    before_b, before_a = np.append(0, used_b[:-1]), used_a
    signs = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[used_a - 1], last_b[used_b - 1] = 1, 1
    signs[np.arange(len(a)) + np.repeat(before_b, size_a)] = a + sides.at[last_a]
    signs[np.arange(len(b)) + np.repeat(before_a, size_b)] = b + sides.at[2 + last_b]
    return "".join(sides.signs[signs].tolist())[:-1]


_NONE = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}


def aligned_texts(sides: Sides, texts: list[str | None]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Of each text its counts and digest, its distinct links, and how often each occurs."""
    nothing = np.zeros(0, np.int64)
    known = [t or "" for t in texts]
    coded = [side.encode(known) for side in sides.sides]
    for text, ids_a, ids_b in zip(known, *coded, strict=True):
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        want = (" " + text).encode("utf-8", "replace")
        same = text and len(a) and len(b) and all(
            b"".join(table[ids].tolist()) == want for table, ids in zip(sides.bytes, (a, b), strict=True)
        )
        if not same:
            yield dict(_NONE), nothing, nothing
            continue
        ends = [np.cumsum(size[ids]) for size, ids in zip(sides.size, (a, b), strict=True)]
        used_a, used_b = groups(ends[0].tolist(), ends[1].tolist())
        found, counts = links(a, b, used_a, used_b)
        yield {
            "n_a": len(a), "n_b": len(b), "n_groups": len(used_a), "n_links": int(counts.sum()),
            "groups_sha256": hashlib.sha256(
                written(sides, a, b, used_a, used_b).encode()).hexdigest(),
        }, found, counts


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None,
    second: str | None = None,
) -> DataFrame:
    """Counts and digest of every document, its distinct ``links`` and ``times`` of each."""
    paths = first or vocabulary(BYTES), second or vocabulary(PIECES)
    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )

    def work(part: pa.RecordBatch) -> dict:
        rows = list(aligned_texts(_sides(*paths), part.column("text").to_pylist()))
        sizes = np.cumsum([0, *(len(r[1]) for r in rows)])
        flat = [np.concatenate([r[k] for r in rows]) for k in (1, 2)]
        return {"doc_id": part.column("doc_id")} | {
            name: [r[0][name] for r in rows] for name in _NONE
        } | {
            name: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))
            for name, values in zip(("links", "times"), flat, strict=True)
        }

    return sliced(read, "text", work, f"{_DOC}, links array<bigint>, times array<bigint>")


def link_counts(rows: DataFrame) -> DataFrame:
    """``link`` and ``docs``, the number of documents that hold it."""
    return rows.select(F.explode("links").alias("link")).groupBy("link").agg(
        F.count("*").alias("docs")
    )


def commonest(counts: DataFrame, most: int = COMMON) -> int:
    """A count that so few links reach that there are no more than ``most`` of them.

    By a histogram over a scale of eighths of a doubling, which has few rows at any size.
    """
    step = F.floor(F.log2(F.col("docs")) * 8).cast("bigint")
    steps = counts.groupBy(step.alias("step")).agg(
        F.count("*").alias("links"), F.min("docs").alias("least")
    ).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for row in steps:
        total += row.links
        if total > most:
            break
        least = row.least
    return least


def summed(rows: DataFrame, counts: DataFrame, most: int = COMMON) -> DataFrame:
    """The documents of :func:`aligned`, with ``n_best`` and ``count_sum`` instead of lists.

    Both inputs are written tables.
    """
    spark = rows.sparkSession
    highest = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("docs").alias("top"))
    least = commonest(counts, most)
    common = counts.filter(F.col("docs") >= least).toArrow()
    top = highest.toArrow()  # one row for each id of the first side at most
    link = common.column("link").to_numpy()
    order = np.argsort(link)
    tops = np.zeros(int(max(top.column("a").to_numpy(), default=0)) + 1, np.int64)
    tops[top.column("a").to_numpy()] = top.column("top").to_numpy()
    known = spark.sparkContext.broadcast(
        (link[order], common.column("docs").to_numpy()[order], tops)
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, docs, tops = known.value
        for batch in batches:
            lists = batch.column("links")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(link, own), max(len(link) - 1, 0))
            hit = link[at] == own if len(link) else np.zeros(len(own), bool)
            count = np.where(hit, docs[at], 0) if len(link) else np.zeros(len(own), np.int64)
            best = np.where(hit & (count == tops[own >> 32]), times, 0)
            sums = [np.append(0, np.cumsum(x)) for x in (best, times * count, ~hit)]
            of_rest = pa.array(sums[2][offsets], pa.int32())
            columns = {
                name: batch.column(name) for name in batch.schema.names if name not in ("links", "times")
            } | {
                name: pa.array(x[offsets[1:]] - x[offsets[:-1]])
                for name, x in zip(("n_best", "count_sum"), sums, strict=False)
            } | {
                name: pa.ListArray.from_arrays(of_rest, pa.array(x[~hit]))
                for name, x in (("links", own), ("times", times))
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    looked = stored(
        rows.withColumn("row", F.monotonically_increasing_id())
        .select("row", *(c for c in rows.columns))
        .mapInArrow(
            look_up, f"row bigint, {_DOC}, n_best bigint, count_sum bigint,"
            " links array<bigint>, times array<bigint>"),
        "looked-up",
    )
    rare = counts.filter(F.col("docs") < least).join(
        highest, F.shiftright("link", 32) == F.col("a")
    ).select("link", "docs", (F.col("docs") == F.col("top")).alias("best"))
    rest = (
        looked.filter(F.size("links") > 0)
        .select("row", F.explode(F.arrays_zip("links", "times")).alias("own"))
        .select("row", F.col("own.links").alias("link"), F.col("own.times").alias("times"))
        .join(rare, "link").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("docs")).alias("more_sum"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return looked.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256",
    )


def document_links(docs: DataFrame) -> DataFrame:
    """Every document's alignment, weighed by the links of the whole corpus."""
    rows = stored(aligned(docs), "aligned")
    return summed(rows, stored(link_counts(rows), "link-counts"))
