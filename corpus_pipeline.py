"""A training corpus from raw documents: five stages, each over all that the one before kept.

    run(spark, sf_dir)

Language identification, line deduplication, near-duplicate removal, benchmark
decontamination, and the mix of what is left.  Every stage takes (spark, docs, sf_dir);
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceframe.llm import decontaminate, language, lines, minhash, mixing
from raceframe.llm.common import prepare, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus is labelled with; texts without one go."""
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line, or nearly do from 24 bytes on.

    Short lines go as exact repeats alone: two edits turn many of them into another word.
    """
    return lines.dedup_lines(docs, exact_bytes=1, characters=True).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: 5-word shingles, similarity 0.8 and more."""
    return minhash.keep_first(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_free", benchmark_free),
    ("source_mix", source_mix),
]

# A trained model and hashed bands decide in the first and third stage: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
