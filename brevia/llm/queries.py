"""The thin contract queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, html_text, lexical, lm, merkle, ngram_join, pii, quality, sharding, toxicity, warc
from .common import pick, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = pick(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    said = F.lit("</s>[INST] ok [/INST]").alias("content")
    messages = F.array(*[F.struct(F.lit(role).alias("role"), said) for role in ("user", "assistant")])
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), messages.alias("messages"))
    return chat.digests(chat.format_conversations(turns, extra))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="long", source="string", text="string")
    return quality.judge(docs).select("doc_id", *quality.METRICS, "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("path")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10, repeats=False)


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_warc, op4_chat, op5_ngram_join, op6_bpe, op7_quality, op8_sharding, op9_decontamination, op10_html, op11_merkle, op12_lexical, op13_lm)
}
ORACLES = {"op3_warc": warc.ORACLE, "op4_chat": chat.ORACLE, "op7_quality": quality.ORACLE, "op11_merkle": merkle.ORACLE, "op12_lexical": lexical.ORACLE}
