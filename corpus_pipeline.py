"""Corpus pipeline: quality classifier, near-dedup, substring dedup, decontamination, source mixing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.  The last adds mix_epoch (from 0) and mix_words to the rows that it
takes, once for each epoch, instead of any columns of these names.

Defined results, in every stage: rows with null ids, texts, languages, sources or lengths are judged like others and keep their
nulls; rows that share an id are rows of their own; further columns of any name pass through; an empty table gives an empty
result.  What a stage does with empty texts and ties is told in its operator's module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import cotraining, decontamination, mixing, simhash, substring_dedup
from tidewell.llm._common import mark, release, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels of both kinds none does."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8) stays: that with the smallest id; texts without words are one group."""
    return simhash.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in a document of smaller id go; n_chars follows the text (null for a null text)."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source up to its target weight."""
    out = mixing.mix(docs.drop("mix_epoch", "mix_words"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).withColumnsRenamed({"_mix_epoch": "mix_epoch", "_mix_words": "mix_words"})


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: The classifier, the fingerprints and the search of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's tables are deleted once its result is written, and that once the next one's is; the last result stays until ``release``."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        release(since, keep=1)
    return docs
