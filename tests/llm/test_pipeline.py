"""The pipeline's stages against what their operators and a brute-force version say."""

import pytest

import corpus_pipeline
from tagloom.llm import ngram_join, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns_of_documents(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, SF), name)
        assert at.dtypes == docs.dtypes, name
        assert at.where("n_chars <> char_length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == at.count()


def test_one_of_each_group_stays(spark, docs):
    placed = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs.union(docs.limit(5)), SF).select("doc_id").collect()]
    assert sorted(kept) == sorted(d for d, c in placed.items() if c == d)


def test_redaction_leaves_clean_texts(spark, docs):
    before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in corpus_pipeline.redact_secrets(spark, docs, SF).select("doc_id", "text").collect():
        found = secret_scan.spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not found)


def test_stages_on_nothing(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_and_null_ids_and_clashing_columns(spark, docs):
    """The same row of equal doc_id stays in every run; rows without a doc_id stay; columns named like the operators' own do no harm."""
    from pyspark.sql import functions as F

    few = docs.limit(40).withColumns({"component_id": F.lit("x"), "r": F.lit(1), "row": F.lit(2.5), "taken": F.lit(None).cast("string"), "spans": F.lit("y")})
    other = few.limit(6).withColumn("text", F.concat(F.lit("another text altogether, with words of its own "), F.col("doc_id").cast("string")))
    null = few.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    rows = few.union(other).union(null)
    seen = []
    for parts in (1, 6):
        kept = corpus_pipeline.one_of_each_group(spark, rows.repartition(parts, "text"), SF)
        assert kept.columns == rows.columns
        seen.append(sorted(map(str, kept.collect())))
        assert kept.where("doc_id is null").count() == 3 and kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    assert seen[0] == seen[1]
    at = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, SF), name)
        assert at.columns == rows.columns, name
