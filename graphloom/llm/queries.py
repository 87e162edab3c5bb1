"""The registered queries of this subpackage: each operator over its whole table, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, decontaminate, language_id, media_ts, ngram_join, oracles, quality, secret_scan, sentencepiece_codec, substring_dedup, token_counts
from graphloom.llm.common import load

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(load(spark, sf_dir, "documents")).drop("version", "class_version")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), MODEL)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_columns(load(spark, sf_dir, "documents"), outputs=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty ledger, in two commits: the second scans only what the first has not seen."""
    return secret_scan.digest(load(spark, sf_dir, "documents"), commits=2)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their posteriors."""
    docs = load(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")), columns=["doc_id", "source", "lang"])
    return scored.filter("__keep").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("__p_toxic").alias("p_toxic"), F.col("__p_low").alias("p_low"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(load(spark, sf_dir, "documents"), MODEL, outputs=False)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_chats(chats.unionByName(tricky), outputs=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), outputs=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_media_columns, op4_secret_scan, op5_quality_classifier, op6_decontaminate, op7_sentencepiece, op8_chat_format, op9_substring_dedup, op10_language_id)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op4_secret_scan": oracles.SECRET_SCAN,
    "op8_chat_format": oracles.CHAT_FORMAT,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
}
