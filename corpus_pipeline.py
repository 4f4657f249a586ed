"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each
stage's rows to the shared folder and reads them for the next one. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kithmark.llm import langid, line_dedup, mixing, near_copies, piece_codec
from kithmark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters go."""
    found = langid.predict(docs, langid.learn(docs), whole=True)
    return found.filter(found["lang_pred"] != langid.UND).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of their source's boilerplate lines."""
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingle sets with a Jaccard similarity of 0.8 or more, all of them."""
    return near_copies.one_of_copies(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, decoded text and spans of each document, as digests."""
    return piece_codec.encode_documents(docs, piece_codec.default_model(), spans=True)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL has no SentencePiece; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
