"""The corpus pipeline: STAGES applied to documents, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import langid, mixing, packing, secrets, simhash
from tidelog.llm.common import table
from tidelog.llm.queries import in_small_batches, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: without a letter, or below the calibrated confidence."""
    return langid.accepted(docs, langid.train(table(spark, sf_dir, "documents")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same expected share of the documents; they come shuffled."""
    return mixing.mixed(docs, mark=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of 1024."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [(name, in_small_batches(f)) for name, f in (("language", language), ("near_dedup", near_dedup), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed))]
#: SQL can't express the fingerprints' components or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
