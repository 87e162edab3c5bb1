"""The training-data pipeline: documents in, encoded documents out; see STAGES for the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, ngram_join, quality, secret_scan, sentencepiece_codec
from graphloom.llm.common import cut, load, quoted, text_of, unused
from graphloom.llm.queries import MODEL


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; a null or empty text is judged as one without
    words; repeated rows are judged alike."""
    return quality.keep(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id, and of that id's texts in the group the
    one of least version; repeated rows of it are one. Of an id with unrelated texts each text stays.
    Rows without id and texts without words are in no group: the former all stay, of the latter one
    row of each id and text."""
    found = ngram_join.ngram_join(docs).filter("doc_id is not null and doc_id = class_id and version = class_version")
    id_, version = unused(docs, "id", "version")
    stay = found.select(F.col("doc_id").alias(id_), F.col("version").alias(version)).groupBy(id_, version).agg(F.count("*").alias("n"))
    stay = cut(stay, "stay")
    rows = docs.withColumns({id_: quoted("doc_id").cast("long"), version: F.xxhash64(text_of(docs))})
    kept = rows.join(stay.select(id_, version).hint("shuffle_hash"), [id_, version], "left_semi")
    if not stay.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_, version])
    columns = [quoted(c) for c in docs.columns]
    return kept.select(*columns).unionByName(rows.filter(F.col(id_).isNull()).select(*columns))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; a null or empty text leaks none."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked through the ledger; null texts stay null."""
    return secret_scan.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round-trip digests of what is left; a null text counts as the empty one."""
    return sentencepiece_codec.encode_decode(docs, MODEL, outputs=False)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", clean_of_benchmark),
    ("secret_scan", without_secrets),
    ("sentencepiece", encode),
]

#: The stages learn, sample paths and call a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
