"""Corpus pipeline: documents in five stages, each written as Parquet and read again as the next one's input.

    toxicity      documents whose expected severity is too high go
    near_dedup    one document of each group of near duplicates stays: the one with the smallest doc_id
    passages      passages of 50 words or more that an earlier document has are cut out
    mix           documents are taken as often as their source's target asks for
    encode        ids and decoded text by the SentencePiece vocabulary

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing, passages, pieces, simhash, toxicity
from tidemark.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model, and the severity from which a document goes, are fitted on the labelled documents of the input.

    Null and empty texts stay, long ones are judged whole; equal rows have the same fate; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    return toxicity.graded(docs, docs, labels).filter(~F.col("rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document that names its component; rows that repeat its doc_id and text go as well.

    Near duplicates have fingerprints of three-word shingles that differ in three bits at most.  Of documents without words
    one stays.  A row with a null doc_id stays only if no other document links to it.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), shingle=3, bits=3)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep_id")).distinct()
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id")).join(keep, F.col("own_id").eqNullSafe(F.col("keep_id")), "left_semi")
    once = Window.partitionBy("own_id", F.md5("row.text")).orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay as they are; see ``passages.without_passages``."""
    return passages.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are taken, the last copy cut at the source's budget; see ``mixing.mixed``."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the documents with the decoded text, plus n_tokens, ids and the digests of both."""
    return pieces.encode_documents(docs, pieces.read_model(pieces.model_path()), ids=True, remembered=120_000)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("passages", cut_passages), ("mix", mix_sources), ("encode", encode)]

#: Fitting a model, connected components, alignments and encoding are beyond SQL; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
