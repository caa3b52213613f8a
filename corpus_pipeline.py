"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and is written as Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import common, decontam, langid, linededup, mixing, ngramjoin


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more repeat."""
    return linededup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return ngramjoin.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, without its passages."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root source weights, in a global random order; ``copy`` numbers repeats."""
    return mixing.mixed_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: Rank-order profiles, the suffix automaton and component search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, read from where it was written; a stage's rows are deleted once the next has been."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        folder = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            common.remove_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
