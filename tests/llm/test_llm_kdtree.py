import math
import random

import pytest

from fleetgauge.llm import kdtree

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, every):
    usable = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scored = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df, k, every):
    return sorted(tuple(r) for r in kdtree.nearest(df, k, every).collect())


@pytest.mark.parametrize("leaf, tree, block", [(256, 1 << 16, 8192), (4, 70, 8192), (16, 1 << 16, 3)])
def test_equals_brute_force(spark, frame, monkeypatch, leaf, tree, block):
    for name, value in (("LEAF", leaf), ("TREE", tree)):
        monkeypatch.setattr(kdtree, name, value)
    draw = random.Random(5)
    rows = [(i, [float(draw.choice([-1, -0.5, 0, 0.25, 1])) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    df = frame([(i, [x for x in v]) for i, v in rows], SCHEMA)
    singles = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    vectors = kdtree.integer_vectors(df)
    got = kdtree.top_k(vectors, vectors.filter("id % 20 = 0"), 7, block)
    assert sorted(tuple(r) for r in got.collect()) == plain(singles, 7, 20)


ODD = [
    (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
    (80, [float("inf"), 1.0]), (100, []), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]),
    (3, [1.0]), (4, [5.0, -7.0, 9.0]), (None, [9.0, 9.0]), (5, [-1.0, -0.001]),
]


def test_edges(spark, frame):
    assert found(frame(ODD, SCHEMA), 20, 20) == plain(ODD, 20, 20)
    assert found(frame(ODD, SCHEMA), 2, 20) == plain(ODD, 2, 20)


def test_large_numbers_are_exact(spark, frame):
    rows = [(i, [1e6 + i, -1e6, 12345.0 * i]) for i in range(40)]
    df = frame(rows, "vec_id bigint, embedding array<double>")
    assert found(df, 5, 20) == plain(rows, 5, 20)


def test_empty_table(spark, frame):
    assert found(frame([], SCHEMA), 20, 20) == []


@pytest.mark.parametrize("rows", [
    [(0, [1e300, 1.0]), (1, [1.0, 1.0])], [(0, [1e9, 1e9]), (1, [1e9, 1e9])],
])
def test_scores_that_would_overflow_are_refused(spark, frame, rows):
    with pytest.raises(Exception, match="too large|63 bits"):
        kdtree.nearest(frame(rows, "vec_id bigint, embedding array<double>")).collect()
