"""Node lists as ranges equal their names written out."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import nodelists
from fleetgauge.operators import noderanges as ops

TEXTS = [
    "n[1-3]", "n[08-11,7]", "n1[2-3]", "n12", "a", "", None, "x[5]", "x[9-8]", "r01[099-101]",
    '["n1","n1","b007"]', '{"allocation":[{"name":"q9"},{"name":""}]}', '{"list":"n[1-2]"}', "n[a-b]",
    "7", "[3-5]", "n[1-2]x", "cab[1]c[2]", "n000[0-1]", "00[998-1002]",
]


def lists(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "id long, nodes string")


def test_ranges_stand_for_the_same_names(spark):
    df = lists(spark, TEXTS)
    want = [
        (r.id, n) for r in df.select("id", nodelists.normalise(F.col("nodes")).alias("n")).collect()
        for n in r.n or []
    ]
    got = ops.written_out(ops.exploded(df, ["id"]), ["id"], piece=2).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    counts = df.select("id", nodelists.count_nodes(nodelists.ranges(F.col("nodes"))).alias("n"))
    names = df.select("id", F.size(nodelists.normalise(F.col("nodes"))).alias("n"))
    sizes = {r.id: r.n for r in names.collect()}
    assert {r.id: r.n for r in counts.collect()} == sizes


@pytest.mark.parametrize("text, want", [
    ("n[1-3000000000]", 3_000_000_000), ("n[0-999999999999999998]", 10**18 - 1),
    ("n[1-3000000000,5-6]", 3_000_000_002), ("n[1-9999999999999999999]", None),
])
def test_wide_lists_are_counted_and_end_no_query(spark, text, want):
    df = lists(spark, [text, "n[1-2]"])
    got = df.select(
        nodelists.count_nodes(nodelists.ranges(F.col("nodes"))), F.size(nodelists.normalise(F.col("nodes")))
    ).collect()
    assert tuple(got[0]) == (want, None) and tuple(got[1]) == (2, 2)


def names_of(spark, ranges, key):
    found = {}
    for r in ops.written_out(ranges, [key]).collect():
        found.setdefault(r[key], []).append(r.name)
    return found


def test_differences_and_cover_by_sweep(spark):
    rng = random.Random(3)

    def some(n):
        return [
            (k, rng.choice(["a", "b"]), 2, low, low + rng.randrange(6))
            for k in range(5) for low in [rng.randrange(40) for _ in range(n)]
        ]

    schema = "id long, prefix string, width int, low long, high long"
    left, right = some(8), some(5)
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rest, cover = ops.difference(a, b, ["id"]), ops.covered(a, ["id"])

    def names(rows, key):
        return {f"{p}{i:02d}" for k, p, _, low, high in rows if k == key for i in range(low, high + 1)}

    for frame, other in ((rest, right), (cover, [])):
        got = names_of(spark, frame, "id")
        for key in range(5):
            want = names(left, key) - names(other, key)
            assert sorted(got.get(key, [])) == sorted(want)  # disjoint, so no name twice
    edges = sorted((r.id, r.prefix, r.low, r.high) for r in cover.collect())
    assert all(x[:2] != y[:2] or x[3] + 1 < y[2] for x, y in zip(edges, edges[1:]))


def test_members_of_wide_and_narrow_ranges(spark):
    texts = ["n[1-3000000000]", "n[10-12]", "n[010-012]", "n1[1-2]", "m", "n[7]", "n[9-10]"]
    ranges = ops.exploded(lists(spark, texts), ["id"])
    names = ["n10", "n010", "n7", "n12", "m", "m1", "n3000000001", "n2999999999", "n0"]
    found = ops.members(spark.createDataFrame([(n,) for n in names], "name string"), ranges).collect()
    assert sorted(map(tuple, found)) == sorted([
        ("n10", 0), ("n7", 0), ("n12", 0), ("n2999999999", 0), ("n10", 1), ("n12", 1), ("n010", 2),
        ("n12", 3), ("m", 4), ("n7", 5), ("n10", 6)])


def test_no_ranges_have_no_members(spark):
    names = spark.createDataFrame([("a",)], "name string")
    assert ops.members(names, ops.exploded(lists(spark, [None, ""]), ["id"])).collect() == []
