"""The corpus pipeline: five stages over the documents, each from one operator of lumenframe.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. Stages 1 to 4 return the columns of `docs`, unchanged and in
order; the last returns one row for each document of the mixture with its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, language_id, mixing, quality, simhash
from lumenframe.llm.common import cut_lineage, table

#: A document stays if some language has at least this probability and the text has a letter.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; `und` and undecided ones go."""
    return language_id.filtered(docs, LEAST_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as class 1."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return simhash.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that their sources have their target weights, in shuffled order."""
    return mixing.mixed(docs).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the tokens and of the decoded text of each document."""
    return bpe.coded(docs, bpe.vocabulary(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained models and SimHash have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`; what one stage returns is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
