"""The corpus pipeline: documents through five of the training-data operators, stage by stage."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from brevia.llm import bpe, decontamination, ngram_join, pii, quality
from brevia.llm.common import cut, delete, recorded, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the others lose lines that too many documents share."""
    return quality.filtered(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return ngram_join.deduplicated(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked."""
    return pii.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids; all other columns stay."""
    return bpe.encode_documents(docs)


#: Tables that the stage before wrote on its way. Its result has been written when the next stage begins.
_left_over: list[str] = []


def alone(stage):
    """The stage, which first deletes what the one before has left in the shared folder."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left_over:
            delete(spark, _left_over.pop())
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _left_over.extend(paths)
        return out

    return call


STAGES = [
    ("quality rules", alone(quality_stage)),
    ("n-gram Jaccard join", alone(dedup_stage)),
    ("benchmark decontamination", alone(decontamination_stage)),
    ("PII", alone(pii_stage)),
    ("BPE encoding", alone(encode_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hash-based candidate search and trained models can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None
