"""Nulls, empty and very long texts, repeated rows, empty tables and columns
with clashing names go through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvine.llm import ann, language, mixing, near_dup, packing, quality, rules, secrets, toxicity, warc
from corvine.llm.common import run_folder, written

TEXT = "the cat sat on the mat and the dog ran over the hill to find a bone "
ROWS = [
    (1, TEXT * 3, "en", "a", 1, "x"),
    (2, TEXT * 3, "en", "a", 1, "x"),
    (2, TEXT * 3, "en", "a", 1, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, "x"),
    (5, "   \n\t ", "de", "b", 3, "x"),
    (6, "der hund und die katze sind in dem haus mit der maus " * 4000, "de", None, 7, "x"),
    (None, "un chat et le chien sont dans la maison avec token = abcdef123456", "fr", "b", 9, "x"),
    (7, "é ü ß 日本語 \U0001f600 <|endoftext|> \x1c á", "fr", "", 9, "x"),
]
#: Column names that operators use inside themselves.
EXTRA = "key string, size string, start string, n string, score string, kept string, host string, label string, queue string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    return df.select("*", *[F.lit("clash").alias(x.split()[0]) for x in EXTRA.split(", ")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x"), (6, 0, 1, "x"), (7, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")


def outputs(docs, labels):
    yield "mixing", mixing.mixed_documents(docs), docs.columns
    yield "packing", packing.packed_digest(packing.pack(docs, packing.default_tokenizer())), None
    yield "secrets", secrets.redact_secrets(docs), docs.columns
    yield "found", secrets.find_secrets(docs), None
    yield "near", near_dup.near_duplicates(docs, 3, 85), None
    yield "dropped", near_dup.drop_near_duplicates(docs), docs.columns
    yield "language", language.predict(docs, language.learn(docs)), None
    yield "quality", quality.rate(docs, quality.learn(docs, labels.withColumnRenamed("quality", "grade"))), None
    yield "rules", rules.quality_rules(docs), None
    yield "toxicity", toxicity.score(docs, toxicity.learn(docs, labels)), None
    yield "clean", toxicity.drop_toxic(docs, toxicity.learn(docs, labels)), docs.columns


def test_awkward_rows(docs, labels):
    n = docs.count()
    for name, out, columns in outputs(docs, labels):
        rows = out.collect()
        assert columns is None or out.columns == columns, name
        if name in ("secrets", "found", "near", "language", "quality", "rules", "toxicity"):
            assert len(rows) == n, name
        if name == "packing":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
        if name == "language":
            assert {r.doc_id: r.lang_pred for r in rows}[3] == "und"
        if name == "dropped":
            assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "6", "7", "None"]


def test_empty_tables(docs, labels):
    for name, out, columns in outputs(docs.limit(0), labels.limit(0)):
        assert out.count() == 0, name


def test_pipeline_stages_on_awkward_rows(spark, docs, labels):
    folder = run_folder(spark, "edges")
    labels.write.parquet(f"{folder}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            table = written(out, name)
            if name != "packing":
                assert table.columns == docs.columns


def test_awkward_vectors_and_pages(spark):
    nan, inf = float("nan"), float("inf")
    vs = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0]), (100, [1.0, None]), (120, [inf, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 2.0]), (None, [1.0, 1.0]), (3, [0.5, 2.0])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ann.nearest(twice, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1, 3.0), (0, 1, 1, 4.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    pages = spark.createDataFrame([(1, "u", "x", "e"), (2, None, "x", "e"), (3, "u", None, "e"), (4, "u", "", "e"), (None, "u", "x", "e")], "page_id long, url string, html string, shard string")
    for table, want in ((pages, 5), (pages.limit(0), 0)):
        folder = run_folder(spark, "edges")
        warc.write_warc(table, folder)
        rows = warc.read_warc(spark, folder).collect()
        assert len(rows) == want
    assert {(r.page_id, r.refers_to) for r in rows} == set()
