"""The corpus pipeline: stages of the training-data operators over documents.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of documents, whatever else docs calls its columns. Null and empty texts and null ids go through every stage: they are
never toxic, near copies or contaminated, and pack as their end id alone. Rows that repeat an id or a text are judged
alike, each for itself. An empty table gives an empty one. No stage can be expressed in SQL as a whole (the first holds a
trained model), so that ORACLE_SQL is None and the stages are tested against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import Scratch, read_table
from tidewater.llm.decontaminate import decontaminate
from tidewater.llm.linededup import without_boilerplate
from tidewater.llm.ngram_join import keep_one
from tidewater.llm.packing import pack
from tidewater.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all stay if labels of one kind are missing."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first place; documents stay, as do null texts."""
    return without_boilerplate(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays (all its rows, if it repeats), and every
    document without words or id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go; without a benchmark all stay."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces of the documents left, a document of its end id alone for a null or empty text."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
