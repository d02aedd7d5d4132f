"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  What a stage decides takes effect: rejected rows and lines are gone for the
next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annospark.llm import bpe, decontaminate, langid, minhash, templates
from annospark.llm.common import crc_mod, read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, that no learned language speaks for, or in another language than their label says, go."""
    return langid.accepted(docs, langid.train(docs.filter(crc_mod("doc_id", 5) != 0)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that has them."""
    return templates.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by five-word Jaccard 0.8 or more the document of smallest id stays.

    Candidates meet in SimHash blocks and pass the Hamming check.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of each document that is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_round_trip),
]

#: Byte contexts, minima of hashes and merges have no SQL; the tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
