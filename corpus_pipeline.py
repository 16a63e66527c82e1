"""Corpus pipeline: toxicity, near duplicates, secrets, mixing and SentencePiece pieces, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last returns doc_id, lang, source, ids, n_tokens and round_trip.

Defined cases, beside those of the operators: rows with a null doc_id are in no group
of near copies and stay; of rows with equal doc_id the first by content stays; n_chars follows the text
where the table has it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import mixing, ngram_join, pieces, secret_scan, toxicity
from tagloom.llm.common import materialize, table

#: Ids (8 bytes each) of dropped documents up to which they are broadcast.
BROADCAST_IDS = 2_000_000


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by their shingles the one with the smallest doc_id stays."""
    placed = materialize(ngram_join.ngram_components(docs).where("doc_id is not null").select("doc_id", "component_id"), "placed")
    dropped = materialize(placed.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    repeated = placed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    # of rows with equal doc_id the same one in every run: the first by its whole content
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("r")).select("r.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; other texts stay as they are."""
    return _counted(secret_scan.redact(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it; a copy taken in part has its first words."""
    return _counted(mixing.mixed(docs)).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of the tokenizer's model."""
    return pieces.encode_column(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: A learnt model, components of a similarity join and a seeded draw are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
