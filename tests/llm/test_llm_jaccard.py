import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def own_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < 3:
        return {tuple(words)}
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def plain(rows):
    """Rows (doc_id, size, component) by comparing all pairs; rows of one id are one."""
    sets = [own_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(
        ((doc, len(s), least[root(i)] if s and doc is not None else doc)
         for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " \t\v\f\r\n "), (4, "one two"), (5, "ONE\x0btwo "), (6, "one"),
    (7, "one two three"), (8, "Ünder Ä words"), (9, "ünder Ä words"), (None, "one two"),
    (10, "word " * 200_000), (11, "word " * 3), (12, "a b c d e f"), (12, "a b c d e f"),
    (12, "one"), (13, "one two three four"), (14, "one two three four"),
]


def test_odd_rows_equal_brute_force(spark, frame):
    assert found(frame(ODD, SCHEMA).repartition(3)) == plain(ODD)


def test_empty_table(spark, frame):
    assert found(frame([], SCHEMA)) == []


def test_groups_passages_and_chains(spark, frame):
    """Near copies with ever more edits, a chain, and a passage in many unlike texts."""
    def words(seed, n):
        draw = random.Random(seed)
        return ["".join(draw.choices("abcdefg", k=5)) for _ in range(n)]

    rows, base, passage = [], words(0, 120), words(1, 90)
    for i in range(220):
        draw, text = random.Random(i), list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 2, 2, 3, 4])):
            text[draw.randrange(120)] = f"edit{draw.randrange(40)}"
        rows.append((i, " ".join(text)))
    for i in range(150):
        rows.append((1000 + i, " ".join(words(100 + i, 30 + i % 20) + passage + words(300 + i, 9))))
    for i in range(60):  # nothing of their own but the passage and a word or two
        rows.append((2000 + i, " ".join(passage[i % 7 :] + words(500 + i, i % 3))))
    drift = words(2, 100)
    for i in range(20):
        drift = [*drift[2:], f"new{i}", f"more{i}"]
        rows.append((3000 + i, " ".join(drift)))
    expected = plain(rows)
    assert found(frame(rows, SCHEMA)) == expected
    assert len({c for _, _, c in expected}) > 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=40), min_size=2, max_size=6), st.randoms())
def test_linked_sets_pass_every_filter(texts, draw):
    """A shared prefix token under every order, and too few shingles of their own."""
    hashes, of = jaccard.shingles([" ".join(t) for t in texts])
    sets = [set(hashes[of == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(own_set(" ".join(t))) for t in texts]
    sizes = jaccard.prefix_sizes(np.bincount(of, minlength=len(texts)))
    sampled = {h for h in hashes.tolist() if draw.random() < 0.5}
    sole = [len({h for h in s & sampled if not any(h in o for o in sets if o != s)}) for s in sets]
    for order in range(jaccard.ORDERS):
        tokens, text = jaccard.first_of(hashes, of, sizes, order)
        heads = [set(tokens[text == i].tolist()) for i in range(len(texts))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and a != b and 100 * len(a & b) >= 90 * len(a | b):
                    assert heads[i] & heads[j]
                    assert sole[i] < sizes[i] and sole[j] < sizes[j]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 45), st.integers(0, 45), st.integers(0, 2**32))
def test_linked_sets_share_a_part(n, fewer, more, seed):
    """Sets that are linked, of any sizes, equal ones apart; those of one size class too."""
    draw = np.random.default_rng(seed)
    h = draw.integers(0, 2**64, n + more, np.uint64)
    sets = [set(h[:n].tolist()), set(h[min(fewer, n - 1):].tolist())]
    hashes = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in sets])
    size = np.array([len(s) for s in sets])
    names, text = jaccard.equal_parts(hashes, np.repeat([0, 1], size), size)
    assert (np.diff(text) >= 0).all()
    shared = set(names[text == 0].tolist()) & set(names[text == 1].tolist())
    both = len(sets[0] & sets[1])
    if sets[0] != sets[1] and 100 * both >= 90 * (sum(size) - both):
        assert shared
    if not both and size.min() > 20:
        assert not shared


def test_every_linked_pair_of_sizes_is_in_one_class_or_the_next():
    for a in range(1, 3000):
        low, high = np.searchsorted(jaccard.CLASSES, [a, 10 * a // 9], "right") - 1
        assert high - low <= 1
        assert jaccard.differing(low) >= (a + 10 * a // 9) // 19


def test_unlike_sets_cost_nothing_after_they_are_named(spark, frame, monkeypatch):
    """Texts of sentences that others have too, but no two texts alike: no set has shingles
    of its own, and none is in a bucket for one shingle it shares."""
    draw = random.Random(7)
    pool = [" ".join(draw.choices("abcdefghijklm", k=12)) for _ in range(60)]
    rows = [(i, " . ".join(draw.sample(pool, 12))) for i in range(150)]
    rows += [(1000 + i, f"text {i} is all its own " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(50)]
    rows.append((2000, rows[0][1] + " end"))
    written = {}

    def stored(df, name, real=jaccard.stored):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(jaccard, "stored", stored)
    assert found(frame(rows, SCHEMA)) == plain(rows)
    assert written["sets"].columns == ["doc_id", "n", "key1", "key2"]
    assert 100 < written["distinct-sets"].count() < 180
    assert written["shared-buckets"].count() < 4 * 151
    assert written["candidate-texts"].count() < 60


def test_sole_shingles(spark, frame):
    rows = [(i, f"common words here own{i} text{i % 4}") for i in range(8)] + [(9, "a b c"), (10, "A B c")]
    found = {r.key1: r.sole for r in jaccard.sole_shingles(frame(rows, SCHEMA), sampled=1 - 1e-12).collect()}
    hashes, of = jaccard.shingles([t for _, t in rows])
    keys = jaccard.set_keys(hashes, of, len(rows), 1).tolist()
    assert [found[k] for k in keys] == [2] * 8 + [1, 1] and len(found) == 9


@pytest.mark.parametrize("left, right, like", [
    ("a b c", "a b c", True), ("a b", "a b", True), ("", "", False), ("a", "a b", False),
    ("A b c", "a B C", True),
])
def test_verified(left, right, like):
    assert jaccard.verified([left], [right]).tolist() == [like]
