"""Self-join of documents by the Jaccard coefficient of their sets of word n-grams.

Two sets are linked if a hundred times their intersection is ninety times their union or
more. Prefix filtering under several global orders: of a set of n shingles, linked sets
share one among the n - ceil(0.9 n) + 1 first ones, whatever the order, as long as all
sets go by it.

1. The first order puts shingles that one set alone has before all others. A set whose
   whole prefix is made of such shingles is linked with nothing. They are counted per
   set, of a share ``SAMPLED`` of all shingles by hash, which takes two shuffles of
   hashes. That a set has many such shingles is all that is kept of this order.
2. The remaining sets are dealt by hash into more parts than linked sets of their size
   class differ in shingles, so some parts of theirs are equal. Of m parts, where sets
   differ in k shingles at most, m - k are equal at least, so one is left if each set
   leaves out its m - k - 1 smallest. The kept parts are buckets: a bucket's sets have
   several shingles in common, not one, so that it stays small however large the input is.
   A set goes by its own size class and by the one below, as linked sets are of the same
   class or of neighbours.
3. Other orders go by hashes of the shingles. A pair must share a prefix token under each
   of them, and pass the bounds on sizes and on parities: each set has 512 bits, the
   parities of its shingles by hash, and sets differ in at least as many shingles as bits.
4. Equal sets are one. Pairs that pass all filters are verified on the whole texts. Pairs
   are made in waves (``waves``), because only components are wanted: texts that
   already hang together are never paired, so a large group of near copies costs a few
   pairs for each of its members, and no link between different components is lost.

Words are runs of anything but the six ASCII blanks, with A-Z in lower case. A text of
one or two words is one shingle; null texts, and those without words, have none, and are
linked with nothing. Rows with one doc_id are one document, whose texts' components are
one; each row tells the size of its own set. Rows without a doc_id are in no component.
An empty table gives no rows. Columns besides the named two are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import column, sliced, slices
from fleetgauge.llm.near_dedup import parities
from fleetgauge.llm.text import mix, powers, prefix_hash
from fleetgauge.llm.waves import (
    components,
    connected,
    likely,
    low_half,
    marked,
    met,
    place,
    shared_buckets,
    texts_of,
)
from fleetgauge.session import stored

#: Words to a shingle, and the least share of the union that linked sets have in common.
SHINGLE, PERCENT = 3, 90

#: Share of all shingles, by hash, of which it is known whether one set alone has them.
SAMPLED = 0.3

#: Orders by hash, and words of parity bits of each set.
ORDERS, PARITY_WORDS = 3, 8

#: Words of the parity bits that pairs are held against before their texts are read.
WIDE = 64

#: Texts whose many parity bits are counted at once.
PARITY_TEXTS = 128

_SALT = 0xA0761D6478BD642F

#: Least sizes of the size classes. Of linked sets the larger one, which has at most ten
#: ninths of the other's size, is of the same class or of the next.
CLASSES = [1]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(-(-10 * CLASSES[-1] // 9))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of the text it stands in."""
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    data = np.frombuffer(b" ".join(b" ".join(words) for words in split), np.uint8)
    counts = np.array([len(words) for words in split], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = data != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    hashes = (sums[end] - sums[start]) * inverse[start]
    return (
        mix(hashes + (end - start).astype(np.uint64)),
        np.repeat(np.arange(len(texts)), counts),
    )


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, and their texts, sorted by text, then shingle."""
    words, text = word_hashes(texts)
    n = len(words)
    total = np.zeros(n, np.uint64)
    size = np.bincount(text, minlength=len(texts))[text] if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.searchsorted(text, text)
    for j in range(SHINGLE):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        there = np.flatnonzero(place + j < size)
        total[there] += words[there + j] * factor
    # A short text's words make one shingle, which its number of words tells from others.
    starts = place <= np.maximum(size - SHINGLE, 0)
    hashes = mix(total + np.minimum(size, SHINGLE).astype(np.uint64))[starts]
    of = text[starts]
    order = np.lexsort([hashes, of])
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n hold one that any linked set has too."""
    return np.where(n > 0, n - -(-PERCENT * n // 100) + 1, 0)


def first_of(
    hashes: np.ndarray, of: np.ndarray, sizes: np.ndarray, order: int
) -> tuple[np.ndarray, np.ndarray]:
    """The first ``sizes`` shingles of every text under an order, and their texts.

    Those of one text come sorted, so shingles whose hashes agree in the bits looked at
    are in one order everywhere.
    """
    key = mix(hashes + np.uint64(order * _SALT % (1 << 64))) >> np.uint64(20)
    at = np.argsort((of.astype(np.uint64) << np.uint64(44)) | key, kind="stable")
    own = of[at]
    kept = at[np.arange(len(own)) - np.searchsorted(own, own) < sizes[own]]
    return hashes[kept], of[kept]


def differing(size_class: np.ndarray) -> np.ndarray:
    """In how many shingles linked sets can differ, the smaller of which is of the class.

    Sets of a and b shingles are linked if they differ in at most (a + b) / 19 of them.
    """
    largest = np.array(CLASSES, np.int64)[size_class + 1] - 1  # of the class
    return (100 - PERCENT) * (largest + 100 * largest // PERCENT) // (100 + PERCENT)


def equal_parts(
    hashes: np.ndarray, of: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Sums that name parts of every text's set, and their texts, sorted by text.

    Linked sets that are not equal share one at least.
    """
    own = np.searchsorted(CLASSES, size, "right") - 1
    found = []
    for below in (0, 1):
        classes = own - below
        may = differing(np.maximum(classes, 0))
        dealt = (classes >= 0) & (may > 0)
        kept = np.where(dealt, may + 1, 0)
        parts = np.where(dealt, kept + 1 + kept // 4, 0)
        first = np.cumsum(parts) - parts
        text = np.repeat(np.arange(len(size)), parts)
        place = np.arange(len(text)) - first[text]
        there = dealt[of]
        h, t = hashes[there], of[there]
        slot = first[t] + (mix(h + np.uint64(_SALT)) % parts[t].astype(np.uint64)).astype(np.int64)
        members = np.bincount(slot, minlength=len(text))
        sums = mix((classes[text].astype(np.uint64) << np.uint64(44)) + place.astype(np.uint64))
        np.add.at(sums, slot, mix(h))
        # The smallest parts are left out; equal parts are equally large and in one place.
        order = np.lexsort([place, -members, text])
        order = order[place < kept[text]]
        found.append((mix(sums[order]), text[order]))
    names, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(text, kind="stable")
    return names[order], text[order]


def set_keys(hashes: np.ndarray, of: np.ndarray, texts: int, salt: int) -> np.ndarray:
    """A sum that names each text's set."""
    keys = np.zeros(texts, np.uint64)
    np.add.at(keys, of, mix(hashes + np.uint64(salt)))
    return keys.view(np.int64)


def _lists(values: np.ndarray, of: np.ndarray, texts: int) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def sole_shingles(docs: DataFrame, text: str = "text", sampled: float = SAMPLED) -> DataFrame:
    """``key1`` and ``sole``, how many of the sampled shingles the set alone has."""
    limit = np.uint64(int(sampled * 2**64))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, of = shingles(part.column("text").to_pylist())
            keys = set_keys(hashes, of, part.num_rows, 1)
            taken = mix(hashes ^ np.uint64(_SALT)) < limit
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[taken].view(np.int64)), pa.array(keys[of[taken]])],
                names=["shingle", "key1"],
            )

    return (
        docs.select(column(text).alias("text")).mapInArrow(some, "shingle bigint, key1 bigint")
        .groupBy("shingle").agg(F.min("key1").alias("key1"), F.max("key1").alias("last"))
        .filter(F.col("key1") == F.col("last"))
        .groupBy("key1").agg(F.count("*").alias("sole"))
    )


def named(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row its set's size and two sums that name it."""
    read = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")
    )

    def work(part: pa.RecordBatch) -> dict:
        n = part.num_rows
        hashes, of = shingles(part.column("text").to_pylist())
        return {
            "doc_id": part.column("doc_id"), "n": np.bincount(of, minlength=n),
            "key1": set_keys(hashes, of, n, 1), "key2": set_keys(hashes, of, n, 2),
        }

    return sliced(read, "text", work, "doc_id bigint, n bigint, key1 bigint, key2 bigint")


def wide_parities(hashes: np.ndarray, of: np.ndarray, texts: int) -> list[np.ndarray]:
    """The many parity bits of every text, for a few texts at a time."""
    found = []
    for first in range(0, texts, PARITY_TEXTS):
        some = min(PARITY_TEXTS, texts - first)
        a, b = np.searchsorted(of, [first, first + some])
        found += list(parities(hashes[a:b], of[a:b] - first, np.ones(b - a), some, WIDE))
    return found


def signed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the rows (id, text) whose id is in ``ids``, and a few others, their set's size
    and names, its parities, parts and prefixes."""

    def work(part: pa.RecordBatch) -> dict:
        n = part.num_rows
        hashes, of = shingles(part.column("text").to_pylist())
        size = np.bincount(of, minlength=n)
        made = {
            "id": part.column("id"), "n": size,
            "key1": set_keys(hashes, of, n, 1), "key2": set_keys(hashes, of, n, 2),
            "parity": list(parities(hashes, of, np.ones(len(of)), n, PARITY_WORDS)),
            "wide": wide_parities(hashes, of, n),
        }
        names, text_of = equal_parts(hashes, of, size)
        made["buckets"] = _lists(names.view(np.int64), text_of, n)
        for order in range(ORDERS):
            tokens, text_of = first_of(hashes, of, prefix_sizes(size), order)
            made[f"prefix{order}"] = _lists(tokens.astype(np.uint32).view(np.int32), text_of, n)
        return made

    prefixes = ", ".join(f"prefix{k} array<int>" for k in range(ORDERS))
    return sliced(
        docs.filter("id IS NOT NULL").select("id", "text", place("id")), "text", work,
        "id bigint, n bigint, key1 bigint, key2 bigint, parity array<bigint>,"
        f" wide array<bigint>, buckets array<bigint>, {prefixes}",
        marked(ids),
    )


def bound(bits: str = "parity", words: int = PARITY_WORDS) -> Column:
    """Whether sets may be linked, by their sizes and parities."""
    both = F.col("n") + F.col("n_")
    differ = sum(
        (F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(f"{bits}_")[i])) for i in range(words)),
        start=F.lit(0),
    )
    differ = F.greatest(F.abs(F.col("n") - F.col("n_")), differ)
    return differ * (100 + PERCENT) <= both * (100 - PERCENT)


def other_orders() -> Column:
    """Whether sets share a prefix token under every order by hash, and pass the wide bound."""
    passed = bound("wide", WIDE)
    for k in range(ORDERS):
        passed = passed & F.arrays_overlap(f"prefix{k}", f"prefix{k}_")
    return passed


def verified(left: list[str], right: list[str]) -> np.ndarray:
    """Whether the sets of each pair of texts are linked."""
    sides = []
    for texts in (left, right):
        hashes, of = shingles(texts)
        sides.append((mix(hashes + mix(of.astype(np.uint64))), of))
    (a, of_a), (b, of_b) = sides
    _, at, _ = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    n = len(left)
    both = np.bincount(of_a[at], minlength=n)
    union = np.bincount(of_a, minlength=n) + np.bincount(of_b, minlength=n) - both
    return (100 * both >= PERCENT * union) & (both > 0)


def linked(pairs: DataFrame, prefixes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that pass the further orders, then the whole texts."""
    # Few sets may be left in a wave, so only theirs are shuffled.
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    pairs = stored(pairs, "made-pairs")
    pairs = stored(likely(pairs, met(prefixes, ends(pairs)), other_orders()), "likely-pairs")
    read = met(texts, ends(pairs))
    both = pairs.join(
        read.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(read.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(part: pa.RecordBatch) -> dict:
        like = verified(part.column("text_a").to_pylist(), part.column("text_b").to_pylist())
        return {c: part.column(c).filter(pa.array(like)) for c in ("a", "b")}

    return sliced(both.select("a", "b", "text_a", "text_b"), "text_a", work, "a bigint, b bigint")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = stored(named(docs, doc_id, text), "sets")
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # A set goes by the smallest document that has it.
    of_set = stored(
        known.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")),
        "names-of-sets",
    )
    # Sets that have too many shingles for themselves to be linked with any other.
    sole = sole_shingles(docs, text)
    prefix = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1
    open_sets = stored(
        of_set.join(sole, "key1", "left").filter(F.coalesce("sole", F.lit(0)) < prefix)
        .select("id", "key1", "key2"),
        "open-sets",
    )
    read = docs.select(column(doc_id).cast("bigint").alias("id"), column(text).alias("text"))
    # Parities, parts and prefixes are large; they are worked out for these sets only.
    some = signed(read, open_sets).join(open_sets, ["id", "key1", "key2"], "left_semi")
    of_sets = ["n", "parity", "wide", "buckets", *(f"prefix{k}" for k in range(ORDERS))]
    sets = stored(
        some.groupBy("id", "key1", "key2").agg(*(F.first(c).alias(c) for c in of_sets)),
        "distinct-sets",
    )
    shared = stored(
        shared_buckets(sets.select("id", F.explode("buckets").alias("bucket"))), "shared-buckets"
    )
    texts = stored(texts_of(read, shared.select("id").distinct()), "candidate-texts")
    # Sets that share no part with any other are linked with nothing.
    candidates = stored(met(sets.drop("buckets"), shared.select("id")), "candidates")
    in_buckets = shared.groupBy("id").agg(F.collect_list(low_half(F.col("bucket"))).alias("buckets"))
    facts = stored(candidates.select("id", "n", "parity").join(in_buckets, "id"), "facts")
    prefixes = candidates.select("id", "n", "wide", *(f"prefix{k}" for k in range(ORDERS)))
    labels = connected(shared, facts, bound(), lambda pairs: linked(pairs, prefixes, texts))
    # Documents with several sets tie these together.
    several = known.select("doc_id", "key1", "key2").join(of_set, ["key1", "key2"]).groupBy("doc_id").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.collect_set("id").alias("ids")
    ).filter("low < high").select(F.col("low").alias("a"), F.explode("ids").alias("b")).filter("a < b")
    ties = stored(several, "ties")
    if not ties.isEmpty():
        labels = components(
            ties.unionAll(labels.filter("id > label").select(F.col("label").alias("a"), F.col("id").alias("b")))
        )
    names = stored(
        of_set.join(labels, "id", "left").select(
            "key1", "key2", F.coalesce("label", "id").alias("component_id")
        ),
        "components",
    )
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(names, ["key1", "key2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
    )


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""
