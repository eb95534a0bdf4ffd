"""Components of similar rows in buckets, without making all pairs of a bucket.

Rows that may be alike share a bucket. Only which rows hang together is wanted, so a pair
of rows that already do is never made:

1. The first wave pairs each row once, with the hub that most of its buckets name. Links
   are checked and give components, which takes in nearly all of a group of near copies.
2. Further waves pair rows of one bucket but different components, where a bound leaves
   them a chance. The first of them look at each row in its largest bucket only, if that
   has more than ``FIRST`` rows, and make the pairs whose hash falls in one of ``share``
   classes; each makes ``FACTOR`` times as many as the one before. A row that is like many
   others has found one of them long before most pairs are made, and has left by then. So
   a row makes few pairs in each wave, and the waves grow with the logarithm of the
   largest bucket. The last wave makes all pairs that are left, in all buckets, so nothing
   is missed.
3. The links of a wave join components, so each link is looked at in its own wave only.

Every wave is written, so no plan grows and lost executors cost little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import stored

#: Rows of a bucket that one row may meet in the first cross wave, about, and how many
#: times as many pairs each further wave makes.
FIRST, FACTOR = 64, 16

#: Bits of the map of wanted ids.
BITS = 26


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id that links lead to, for every id in a link.

    Each round takes the smallest label of the neighbours, then the label's own label,
    so that chains shorten by half. Every round is written.
    """
    edges = stored(
        links.select("a", "b").unionAll(links.select("b", "a")).distinct(), "links"
    )
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(
            F.min("label").alias("near")
        )
        lower = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = stored(
            lower.join(own, "label").select(
                "id", F.least("label", "next").alias("label"), "before"
            ),
            "labels",
        )
        labels = new.select("id", "label")
        if new.filter(F.col("label") != F.col("before")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``id, label`` after further links (a, b), found on the components' names."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b")
    )
    named = stored(named, "named-links")
    joined = components(named.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    ends = named.select("a", "label_a").unionAll(named.select("b", "label_b")).toDF("id", "label")
    every = labels.select("id", "label").unionAll(ends).distinct()
    new = joined.select(F.col("id").alias("label"), F.col("label").alias("new"))
    return stored(
        every.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label")),
        "labels",
    )


def shared_buckets(members: DataFrame) -> DataFrame:
    """``bucket, id`` of buckets with several rows, with ``hub``: one of them, by hash."""
    hubs = members.groupBy("bucket").agg(
        F.min("id").alias("low"), F.max("id").alias("high"),
        F.min_by("id", F.xxhash64("id")).alias("hub"),
    ).filter(F.col("low") != F.col("high")).select("bucket", "hub")
    return members.join(hubs, "bucket")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """Every row with the hub that most of its buckets name, the smaller one in a tie."""
    named = shared.filter(F.col("id") != F.col("hub")).groupBy("id", "hub").agg(
        F.count("*").alias("times")
    )
    return named.groupBy("id").agg(F.min_by("hub", F.struct(-F.col("times"), "hub")).alias("hub")).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    ).distinct()


def likely(pairs: DataFrame, facts: DataFrame, may_link: Column) -> DataFrame:
    """Pairs (a, b) that ``may_link`` leaves a chance."""
    left = facts.select(F.col("id").alias("a"), *(c for c in facts.columns if c != "id"))
    right = facts.select(
        F.col("id").alias("b"), *(F.col(c).alias(f"{c}_") for c in facts.columns if c != "id")
    )
    return pairs.join(left, "a").join(right, "b").filter(may_link).select("a", "b")


def place(x: str) -> Column:
    """The place of an id in the map of :func:`marked`."""
    return F.xxhash64(x).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit")


def marked(ids: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What keeps rows, by their ``bit`` (:func:`place`), whose id is in ``ids``, and a few others.

    They are looked up in a bitmap where they are read, without a shuffle. It has 512 bits
    for each id or more, up to a fixed size.
    """
    marks = (
        ids.select(place("id")).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
        .toArrow()  # as many rows as the map has words, at most
    )
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    while len(bitmap) > max(1 << 10, 16 * marks.num_rows):
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    last = 64 * len(bitmap) - 1
    known = ids.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy() & last
            hit = (known.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.drop_columns(["bit"]).filter(pa.array(hit.astype(bool)))

    return keep


def met(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids``, and a few others (:func:`marked`)."""
    return rows.filter("id IS NOT NULL").select("*", place("id")).mapInArrow(marked(ids), rows.schema)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows of ``docs`` (id, text) whose id is in ``ids``.

    Hardly any other text is shuffled (:func:`met`).
    """
    # The merge hint keeps one plan at every size: ids grow with the documents.
    return met(docs.select("id", "text"), ids).join(
        ids.select("id").distinct().hint("merge"), "id", "left_semi"
    )


def open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, id, label) of buckets that still hold several components."""
    placed = stored(
        shared.select("bucket", "id").join(labels, "id", "left").select(
            "bucket", "id", F.coalesce("label", "id").alias("label")
        ),
        "placed",
    )
    apart = placed.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")
    ).filter(F.col("low") != F.col("high")).select("bucket", "members")
    return stored(placed.join(apart, "bucket"), "open-rows")


def cross_pairs(rows: DataFrame, facts: DataFrame, bound: Column, share: int) -> DataFrame:
    """Pairs of one bucket but different components, of one in ``share`` hash classes.

    Rows of a bucket's largest component meet those outside only. With several classes a
    row counts in its largest bucket alone, if that is large; with one, in all of them.
    ``facts`` has ``id``, ``buckets`` (the lower halves of all of a row's buckets) and what
    ``bound`` looks at, where the other row's columns end in ``_``.
    """
    if share > 1:
        rows = (
            rows.filter(F.col("members") > FIRST)
            .groupBy("id").agg(F.max(F.struct("members", "bucket", "label")).alias("own"))
            .select("own.bucket", "id", "own.label")
        )
    rows = rows.select("bucket", "id", "label")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    told = rows.join(main, "bucket").join(facts, "id")
    outside = told.filter(F.col("label") != F.col("main"))
    others = told.select(
        "bucket", *(F.col(c).alias(f"{c}_") for c in told.columns if c != "bucket")
    )
    inner = F.col("label_") != F.col("main_")  # both outside: one of the two orders will do
    wanted = (F.col("label") != F.col("label_")) & (~inner | (F.col("id") < F.col("id_")))
    if share > 1:
        pair = F.xxhash64(F.least("id", "id_"), F.greatest("id", "id_"))
        wanted = wanted & (F.pmod(pair, F.lit(share)) == 0) & bound
    else:
        # Near copies share most of their buckets; a pair is made in the first of these.
        first = F.array_min(F.array_intersect("buckets", "buckets_"))
        wanted = wanted & bound & (low_half(outside["bucket"]) == first)
    same = outside.join(others, (outside["bucket"] == others["bucket"]) & wanted)
    return same.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def low_half(bucket: Column) -> Column:
    """The lower 32 bits of a bucket."""
    return F.shiftright(F.shiftleft(bucket, 32), 32).cast("int")


def connected(
    shared: DataFrame, facts: DataFrame, bound: Column,
    linked: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``id, label``: the smallest id of the component of every row that has a link.

    ``shared`` is :func:`shared_buckets`; ``linked`` keeps those of the pairs (a, b) that
    are links. ``bound`` and ``facts`` are as for :func:`cross_pairs`. All inputs are
    written tables.
    """
    labels = components(
        stored(linked(likely(hub_pairs(shared), facts.drop("buckets"), bound)), "links")
    )
    rows = open_rows(shared, labels)
    largest = rows.agg(F.max("members")).first()[0]
    if largest is None:
        return labels
    share = 1
    while share * FIRST < largest:
        share *= FACTOR
    while True:
        pairs = stored(cross_pairs(rows, facts, bound, share), "open-pairs")
        if not pairs.isEmpty():
            more = stored(linked(pairs), "links")
            if not more.isEmpty():
                labels = merged(labels, more)
        if share == 1:
            return labels
        rows = open_rows(shared, labels)
        share //= FACTOR
