"""A corpus pipeline: documents through five operators of deskloom.llm, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskloom.llm import language
from deskloom.llm.bpe import bpe_digests
from deskloom.llm.mixing import mixed_rows
from deskloom.llm.ngram_join import without_copies
from deskloom.llm.quality import passing
from deskloom.llm.queries import VOCABULARY
from deskloom.llm.shared import documents, small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned: rejected are und, and texts that no language's statistics fit."""
    small_batches(spark)
    model = language.train(docs.where(~language.held_out()))
    return language.in_a_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    small_batches(spark)
    return without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every copy, as digests."""
    small_batches(spark)
    return bpe_digests(docs, VOCABULARY)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The language model has no SQL; the tests hold the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each one's result written and read as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
