from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import classes, contained, covered, left
from fleetgauge.llm import quality
from fleetgauge.llm.tokens import vocabulary
from fleetgauge.sources.tables import table

SF = "/root/testdata/sf0.001"


def plain(spark, docs):
    """Rows (doc_id, text) after each stage but the last."""
    source = table(spark, SF, "documents")
    voters = quality.fit(source, table(spark, SF, "labels"))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [(d, t) for d, t in docs if voters.scores([t])[0] >= quality.GOOD]
    yield docs
    docs = [(d, t) for (d, t), c in zip(docs, classes(docs)) if d == c]
    yield docs
    docs = [(d, left(t, f).decode("utf-8", "ignore")) for (d, t), f in zip(docs, covered(docs))]
    yield docs
    hit = {d for d, *_ in contained(docs, items)}
    yield [(d, t) for d, t in docs if d not in hit]


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    steps = plain(spark, [(r.doc_id, r.text) for r in docs.collect()])
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        docs = spark.createDataFrame(
            stage(spark, docs, SF).collect(), docs.schema)
        rows = docs.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in rows) or name != "suffix_dedup"
    whole = Tokenizer.from_file(vocabulary())
    sizes = Counter({
        r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()})
    found = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id] += r.length
    assert found == sizes


def test_stages_take_odd_rows(spark, frame):
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words of a text", "en", "s", 1),
        (3, "clean prose of the usual kind, " * 9, "en", None, 7),
        (3, "clean prose of the usual kind, " * 9, "en", None, 7), (4, "long " * 100_000, "en", "s", 5),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (frame(rows, schema), frame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    kept = corpus_pipeline.near_dedup(spark, frame(rows, schema), SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]
    cut = corpus_pipeline.suffix_dedup(spark, frame(rows, schema), SF)
    assert {r.text for r in cut.filter(F.col("doc_id").isin(1, 2)).collect()} == {None, ""}


def test_stages_take_any_column_names(spark):
    rows = [(i, f"some clean prose of the usual kind number {i}, " * 12, "x", 1, 2, {"k": 1}, (3,)) for i in range(4)]
    rows.append((3, rows[3][1].upper(), "y", 5, 6, None, None))
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, `my col` string, `a.b` int, `a:b` int, gone map<string,int>,"
        " column_2_ struct<`x y:z`: int>")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "pack" or out.dtypes == docs.dtypes, name
        assert out.count() <= docs.count() or name == "pack"
    odd = docs.withColumnRenamed("my col", "Text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = {r[0] for r in stage(spark, odd, SF).collect()}
        assert found == {r[0] for r in stage(spark, docs, SF).collect()}, name


def test_unlike_texts_of_one_id_are_all_kept(spark, frame):
    texts = ["one text about ships and the sea, long ago", "other words of a recipe for bread and salt",
             "third and last, on stars seen at night in winter"]
    rows = [(8, t) for t in texts] + [(8, texts[0]), (9, texts[1])]
    kept = corpus_pipeline.near_dedup(spark, frame(rows, "doc_id bigint, text string"), SF).collect()
    assert sorted(r.text for r in kept if r.doc_id == 8) == sorted(texts)
