from fleetgauge.llm import lengths

TEXTS = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "one two three four"), (5, "x " * 3000)]


def test_limits_equal_brute_force(spark, frame):
    docs = frame(TEXTS, "doc_id bigint, text string")
    counted = lengths.encoded_lengths(docs, id_column="doc_id")
    sizes = [r.tokens for r in counted.collect()]
    assert sorted(sizes) == [0, 0, 3, 3, 4, 3000]
    found = lengths.context_limits(lengths.length_histogram(counted))
    rows = {r.context_limit: r for r in found.collect()}
    assert set(rows) == {*sizes, *lengths.LIMITS}
    for limit, r in rows.items():
        kept = sum(min(limit, n) for n in sizes)
        assert (r.tokens, r.tokens_kept, r.tokens_lost) == (sum(sizes), kept, sum(sizes) - kept)
        assert r.docs_that_fit == sum(n <= limit for n in sizes)
        assert r.docs_cut == sum(n > limit for n in sizes)
        assert r.docs_of_length == sizes.count(limit)
        assert r.share == r.docs_that_fit / len(sizes)
    for share in (0.1, 0.5, 0.9, 1.0):
        want = min(n for n in sizes if sum(m <= n for m in sizes) >= share * len(sizes))
        assert lengths.quantile(found, share).first().length == want


def test_empty_table(spark, frame):
    docs = frame([], "doc_id bigint, text string")
    found = lengths.context_limits(lengths.length_histogram(lengths.encoded_lengths(docs)))
    rows = found.collect()
    assert sorted(r.context_limit for r in rows) == lengths.LIMITS
    assert all(r.tokens == r.tokens_kept == r.docs_that_fit == 0 and r.share is None for r in rows)


def test_query_counts_every_document(spark):
    from fleetgauge.llm.queries import QUERIES
    from fleetgauge.sources.tables import table

    rows = QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()
    n = table(spark, "/root/testdata/sf0.001", "documents").count()
    assert sum(r.docs_of_length for r in rows) == n
    assert {r.docs_that_fit + r.docs_cut for r in rows} == {n}
